"""Subsequence kernel and decisions against plain enumeration; the machine by held-out accuracy."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm.toxicity import (
    DECAY,
    GAP,
    LETTERS,
    LONGEST,
    SPAN,
    Nystroem,
    _best_cut,
    chosen_landmarks,
    fitted,
    kernels,
    pieces,
    subsequences,
    tokens,
    toxicity,
    trained,
    unit,
    variants,
)
from tests.llm.conftest import AWKWARD

LABELS = "doc_id long, quality int, toxic int"
WORDS = [w for x in ["idiot", "i\0d\0i\0o\0t", "aaaaaa", "x", "clown", "clowns", "ab\0c", "straße"] for w in pieces(x)]


def enumerated(word):
    """Weight of every subsequence, by all choices of places."""
    found = defaultdict(float)
    for places in combinations(range(len(word)), LETTERS):
        span = places[-1] - places[0] + 1
        if span <= SPAN and GAP not in (letters := "".join(word[i] for i in places)):
            found[letters] += DECAY ** (span - LETTERS)
    return found


def kernel(a, b):
    x, y = enumerated(a), enumerated(b)
    lengths = np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items() if k in y) / lengths if lengths else 0.0


def test_kernel_equals_enumeration():
    expected = [[kernel(a, b) for b in WORDS] for a in WORDS]
    assert np.allclose(kernels(WORDS, WORDS), expected)
    assert kernel(WORDS[0], WORDS[1]) > 0.5 > kernel(WORDS[0], WORDS[4])


def test_decision_is_that_of_the_nystroem_features():
    space = Nystroem(chosen_landmarks(WORDS, 4))
    assert len(space.landmarks) == 4
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=4), 0.3
    by_hand = np.array([[kernel(w, x) for x in space.landmarks] for w in WORDS]) @ space.whitening @ weights + bias
    assert np.allclose(space.machine(weights, bias).decisions(WORDS), by_hand)
    # Whitened features of the landmarks have their kernels as products.
    own = space.features(space.landmarks)
    assert np.allclose(own @ own.T, kernels(space.landmarks, space.landmarks), atol=1e-6)


def test_units():
    assert unit("--Id1-iOt!!") == "id\0iot" and unit("42") == "" and unit("Straße.") == "straße"
    assert "i\0d\0i\0o\0t" in {unit(t) for t in tokens("you i d i o t there")}
    long = pieces("abc" * 500)
    assert all(len(p) <= LONGEST for p in long) and len(long) > 50
    assert all(any("abc" * 500 in p or p in "\1" + "abc" * 500 + "\2" for p in [x]) for x in long)
    owner, code, weight = subsequences(long)
    assert np.allclose(np.bincount(owner, weight * weight), 1)


def test_cut_prefers_clean_documents():
    assert _best_cut([(0, 0.0), (0, 0.1), (1, 0.9), (1, 1.0)]) == pytest.approx(0.5)
    assert _best_cut([(0, 0.0)] * 9 + [(0, 0.5), (1, 0.4)] + [(1, 1.0)] * 9) == pytest.approx(0.75)
    assert _best_cut([(1, 1.0), (0, 1.0)]) > 1


def test_fit_equals_a_dense_fit(spark):
    """Sums by task give the solution at which the gradient of the whole table vanishes."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 3))
    label = np.where(rows @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=300) > 0.1, 1.0, -1.0)
    table = spark.createDataFrame([(float(y), 1 / 300, x.tolist()) for y, x in zip(label, rows)], "label double, weight double, features array<double>")
    weights = fitted(table.repartition(4), 3)
    full = np.column_stack([rows, np.ones(300)])
    short = np.maximum(1 - label * (full @ weights), 0)
    gradient = np.array([1e-4, 1e-4, 1e-4, 1e-7]) * weights - 2 / 300 * full.T @ (label * short)
    assert np.abs(gradient).max() < 1e-9


@pytest.fixture(scope="module")
def insults(spark):
    """Texts of invented words; toxic ones have one of three insults."""
    rng = np.random.default_rng(7)
    syllables = ["ta", "ne", "ro", "mi", "lu", "sa", "ke", "po", "di", "va"]
    rows = []
    for i in range(400):
        words = ["".join(rng.choice(syllables, 3)) for _ in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[int(rng.integers(30))] = ["idiot", "scoundrel", "blockhead"][i % 3]
        rows.append((i, " ".join(words[:15]) + ".\n" + " ".join(words[15:]), toxic))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, sentence int")
    return docs.repartition(3), spark.createDataFrame([(i, 1, t) for i, _, t in rows], LABELS)


def test_gapped_and_stretched_insults(insults):
    docs, labels = insults
    machine = trained(docs, labels)
    found = machine.of_texts(["tanero idiot mimi", "tanero i-d-i-o-t mimi", "s c o u n d r e l", "scoun-drel", "blockkhead", "BLOCKHEAD!!", "tanero mimi", "", "12 34"])
    assert found[-1] is None and found[-2] is None
    assert all(x > machine.cut for x in found[:6]) and found[6] < machine.cut
    assert len(variants("\1ab\2")) == 2


def test_held_out_accuracy_and_held_out_labels(insults):
    docs, labels = insults
    judged = toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in judged if r["held_out"]]
    assert len(held) > 100 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in judged)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["doc_id"], round(r["score"], 6)) for r in toxicity(docs, turned).collect()} == {(r["doc_id"], round(r["score"], 6)) for r in judged}


def test_awkward_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, 0, None), (9, 1, 1), (13, 1, 1)], LABELS)
    rows = toxicity(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert toxicity(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity(awkward, labels.where("false")).collect()} == {0.0}
