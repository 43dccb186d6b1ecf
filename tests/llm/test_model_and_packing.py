"""Language model, packing, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoplens.llm import packing
from shoplens.llm.mixing import KEEP, REST, TARGETS, TEMPER, calibrated, draw_of, mix_sources, rake, sampled
from shoplens.llm.packing import CAPACITY, best_fit, goes_up, pack_documents, sequences, word_ids
from shoplens.llm.ppm import ppm_scores
from shoplens.llm.quality_rules import quality_rules
from tests.llm.conftest import AWKWARD, LOWER, frame, words
from tests.llm.test_dedup import components, kept_lines

ORDER = 5


def out_of(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n == 0


def symbols(text):
    return [0xFF] * ORDER + list((text or "").translate(LOWER).encode()) + [0xFE]


class Trie:
    def __init__(self, texts):
        self.seen = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for text in texts:
            own = symbols(text)
            for i in range(ORDER, len(own)):
                for k in range(ORDER + 1):
                    self.seen[k][tuple(own[i - k : i])][own[i]] += 1

    def probability(self, history, symbol):
        p, excluded = 1.0, set()
        for k in range(ORDER, -1, -1):
            here = {s: n for s, n in self.seen[k].get(tuple(history[ORDER - k :]), {}).items() if s not in excluded}
            if not here:
                continue
            total = 2 * sum(here.values())
            if symbol in here:
                return p * (2 * here[symbol] - 1) / total
            p *= len(here) / total
            excluded |= set(here)
        return p / (255 - len(excluded))


@pytest.mark.parametrize("sizes", [(64 << 20, 4 << 20), (2_000, 500)])
def test_scores_equal_brute_force(spark, sizes):
    rows = [r for r in AWKWARD if r[0] not in (9, 10, 16)] + [(300 + i, f"some text number {i} of a few", "en", "s") for i in range(40)]
    trained = [t for i, t, *_ in rows if not out_of(i, 10)]
    trie = Trie(trained)
    count = Counter()
    for t in trained:
        count.update(words((t or "").translate(LOWER)))
        count["\0end"] += 1
    total, types = sum(count.values()), len(count)
    expected = []
    for i, t, *_ in rows:
        own = [*words((t or "").translate(LOWER)), "\0end"]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        s = symbols(t)
        score = sum(math.log10(trie.probability(s[p - ORDER : p], s[p])) for p in range(ORDER, len(s)))
        expected.append((i, out_of(i, 10), len(own), sum(count[w] > 0 for w in own), total, round(base, 7), round(score, 7)))
    found = [(*r[:5], round(r["base_score"], 7), round(r["score"], 7)) for r in ppm_scores(frame(spark, rows), *sizes).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    history = symbols("the text")[-6:-1]
    assert sum(trie.probability(history, s) for s in range(255)) == pytest.approx(1)


def test_scores_of_little(spark, nothing):
    assert ppm_scores(nothing).count() == 0
    held = next(i for i in range(100) if out_of(i, 10))
    row = ppm_scores(frame(spark, [(held, "ab", "en", "s")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (2, 0, 0)
    assert row["score"] == pytest.approx(3 * math.log10(1 / 255)) and row["base_score"] == pytest.approx(0)


def pieces_of(text):
    ids = np.array(word_ids(None).tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    return [(n, s, len(ids[s : s + CAPACITY]), zlib.crc32(ids[s : s + CAPACITY].tobytes())) for n, s in enumerate(range(0, len(ids), CAPACITY))]


def check_places(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= CAPACITY
    return len(by)


def test_pieces_and_places(spark, nothing):
    rows = AWKWARD + [(100 + i, "word " * (i * 37 % 900), "en", "s") for i in range(200)]
    docs = frame(spark, rows).repartition(20)
    packed = pack_documents(docs, with_ids=True)
    found = packed.collect()
    expected = sorted([(i, *p) for i, t, *_ in rows for p in pieces_of(t)], key=str)
    assert sorted([tuple(r[:5]) for r in found], key=str) == expected
    count = check_places(found)
    total = sum(r["length"] for r in found)
    assert count <= 1.03 * -(-total // CAPACITY)
    whole = sequences(packed).collect()
    assert sum(r["length"] for r in whole) == total and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    one = whole[0]["sequence_id"]
    parts = sorted((r["offset"], bytes(r["ids"])) for r in found if r["sequence_id"] == one)
    assert bytes(whole[0]["ids"]) == b"".join(p for _, p in parts)
    assert pack_documents(nothing).count() == 0


def test_words_have_the_ids_of_whole_texts():
    rng = random.Random(1)
    letters = list("abZÀ.,!'s tm<|>1½́éΣσς中\n\t😀#-_İ\x1c\xa0")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own = word_ids(None)
    found = list(own.of([t.encode() for t in texts]))
    for text, raw in zip(texts, found):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_letters_are_tokenized_once_whatever_marks_follow():
    own = word_ids(None)
    own.forget()
    texts = ["some Some*** some%%% SOME, some.", "", "éa### ÉA éa$", "x=1 " * 3]
    found = list(own.of([t.encode() for t in texts]))
    assert set(own.known) == {"", "some", "***", "%%%", ",", ".", "éa", "###", "$", "x=1", "Éa"}
    for text, raw in zip(texts, found):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_words_are_put_together_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_TOGETHER", 3)
    own = word_ids(None)
    texts = ["a b", "", "c d e f g", " h ", "i", "j"]
    for text, raw in zip(texts, own.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(5))
def test_what_stays_below_is_of_no_use_above(seed):
    """A node packs as well from the bins that its children send as from all their bins."""
    rng = np.random.default_rng(seed)
    children = [best_fit(rng.choice([40, 700, 1100, 1500, 1990], 300), 2048)[2] for _ in range(4)]
    every = len(best_fit(np.concatenate(children), 2048)[2])
    sent = [goes_up(c, 2048, 4) for c in children]
    some = len(best_fit(np.concatenate([c[u] for c, u in zip(children, sent)]), 2048)[2])
    assert every == some + sum((~u).sum() for u in sent)


def test_rake_meets_every_marginal():
    tokens = np.random.default_rng(0).integers(1, 100, (3, 4, 2)).astype(float)
    targets = [np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    raked = rake(tokens, targets, 0.1) / (0.1 * tokens.sum())
    for axis, wanted in enumerate(targets):
        others = tuple(i for i in range(3) if i != axis)
        assert raked.sum(axis=others) == pytest.approx(wanted, abs=1e-9)
    # Raking leaves odds ratios as they are.
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert odds(raked) == pytest.approx(odds(tokens))


def test_full_cells_give_all_they_have():
    tokens = np.array([[1.0, 999.0], [500.0, 500.0]])
    taken = rake(tokens, [np.array([0.5, 0.5]), np.array([0.4, 0.6])], 0.6)
    assert taken[0, 0] == 1.0 and (taken <= tokens).all()
    assert taken.sum(axis=1) == pytest.approx([600, 600], rel=1e-6) and taken.sum(axis=0) == pytest.approx([480, 720], rel=1e-6)
    # Targets that contradict the data end as well, within what there is.
    beyond = rake(tokens, [np.array([0.9, 0.1]), np.array([0.5, 0.5])], 0.9)
    assert (beyond <= tokens).all() and (beyond >= 0).all()
    assert rake(np.zeros((2, 2)), [np.ones(2), np.ones(2)], 0.5).sum() == 0


def test_targets_that_contradict_each_other_are_moved_until_a_sample_meets_them():
    tokens = np.array([[500.0, 0.0], [0.0, 500.0]])
    taken = rake(tokens, [np.array([0.6, 0.4]), np.array([0.4, 0.6])], 0.5)
    assert taken.sum() == pytest.approx(500) and (taken <= tokens).all()
    assert taken.sum(axis=0) == pytest.approx(taken.sum(axis=1)) and taken.sum(axis=0) == pytest.approx([250, 250])
    none = rake(np.array([[5.0, 9.0], [5.0, 5.0]]), [np.array([0.0, 1.0]), np.array([0.5, 0.5])], 0.9)
    assert none.tolist() == [[0, 0], [5, 5]]


def test_production_marginals(spark):
    """Notes and licensed texts hold less than their share of the production targets; all other marginals are met nevertheless."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    info = calibrated(docs).select("source", "lang", "mix.*").withColumn("taken", F.col("probability") * F.col("n_tokens"))
    rows = info.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("held"), F.sum("taken").alias("taken")).collect()
    total, kept = sum(r["held"] for r in rows), sum(r["taken"] for r in rows)
    assert kept == pytest.approx(KEEP * total, rel=1e-8)
    for axis in ("source", "lang", "topic"):
        held, taken = Counter(), Counter()
        for r in rows:
            held[r[axis]] += r["held"]
            taken[r[axis]] += r["taken"]
        given = {k: v for k, v in TARGETS[axis].items() if v is not None}
        power = {k: (n / total) ** TEMPER for k, n in held.items() if k not in given}
        share = {k: n * (1 - sum(given.values())) / sum(power.values()) for k, n in power.items()}
        full = {k for k in share if share[k] * kept > held[k]}
        assert full == ({"note", "licensed"} if axis == "topic" else set())
        left = 1 - sum(given.values()) - sum(held[k] for k in full) / kept
        share = {k: held[k] / kept if k in full else share[k] * left / sum(share[x] for x in share if x not in full) for k in share}
        for k, wanted in (share | given).items():
            assert taken[k] / kept == pytest.approx(wanted, abs=1e-8), k


def test_mixture(spark, nothing):
    rows = AWKWARD + [(1000 + i, "w " * (20 + i % 300), ["en", "de"][i % 5 == 0], f"src{i % 3}") for i in range(4000)]
    docs = frame(spark, rows)
    targets = {"source": {"src0": 0.5, "src1": 0.3, REST: 0.2}, "lang": {"de": 0.4, "en": None}, "topic": {"note": 0.3, REST: 0.7}}
    found = calibrated(docs, targets, 0.3).select("doc_id", "text", "source", "lang", "mix.*").collect()
    assert len(found) == len(rows) and [r["n_tokens"] for r in found] == [len(words(r["text"])) for r in found]
    total = sum(r["n_tokens"] for r in found)
    share = lambda keep: sum(r["weight"] * r["n_tokens"] for r in found if keep(r)) / total
    assert share(lambda r: r["source"] == "src0") == pytest.approx(0.5, abs=1e-6)
    assert share(lambda r: r["source"] not in ("src0", "src1")) == pytest.approx(0.2, abs=1e-6)
    assert share(lambda r: r["lang"] == "de") == pytest.approx(0.4, abs=1e-6)
    assert share(lambda r: r["topic"] == "note") == pytest.approx(0.3, abs=1e-6)
    assert max(r["probability"] for r in found) <= 1 and all(r["sampled"] == (r["draw"] < r["probability"]) for r in found)
    drawn = sum(r["n_tokens"] for r in found if r["sampled"])
    assert sum(r["n_tokens"] for r in found if r["sampled"] and r["lang"] == "de") / drawn == pytest.approx(0.4, abs=0.06)
    kept = sampled(docs, targets, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(r["sampled"] for r in found)
    assert mix_sources(docs).count() == len(rows) and mix_sources(nothing).count() == 0


def test_sources_and_languages_come_from_the_data(spark):
    """Sources and languages of any name are raked one by one: small ones are lifted, a hot one gives."""
    rows = [(n, "w " * 50, f"lang{n % 7}" if n % 7 else None, "hot" if n % 2 else f"site{n // 2 % 150}") for n in range(6000)]
    found = calibrated(frame(spark, rows), keep=0.3).select("source", "lang", "mix.*").collect()
    assert len(found) == len(rows)
    for axis in ("source", "lang"):
        held, taken = Counter(), Counter()
        for r in found:
            held[r[axis]] += r["n_tokens"]
            taken[r[axis]] += r["probability"] * r["n_tokens"]
        power = {k: n**TEMPER for k, n in held.items()}
        assert len(held) == (151 if axis == "source" else 7)
        for k in held:
            assert taken[k] / sum(taken.values()) == pytest.approx(power[k] / sum(power.values()), abs=1e-8), k


def test_a_given_topic_is_used(spark):
    docs = frame(spark, AWKWARD).withColumn("topic", F.lit("mine"))
    assert {r["topic"] for r in mix_sources(docs).collect()} == {"mine"}


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    """Every stage of run() against a plain computation on what the stage before kept."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1000 + i, " ".join(base[:-1] + [f"tail{i % 7}"]) + "\nA passage that very many documents share\n" + f"closing line of number {i % 25}", "en", f"src{i % 3}") for i in range(120)]
    rows += [r for r in AWKWARD if r[0] not in (9, 10)]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = {(r["doc_id"], r["n_words"]) for r in quality_rules(docs).where("kept").collect()}
    left = [r for r in rows if (r[0], len(words(r[1]))) in good]
    lines = {i: t for i, t, *_ in kept_lines(left)}
    left = [(i, lines[i], lang, source) for i, _, lang, source in left]
    first = {c for _, _, c in components(left)}
    left = [r for r in left if r[0] in first]
    frames = frame(spark, left)
    chosen = {r["doc_id"] for r in calibrated(frames).where("mix.sampled").collect()}
    expected = sorted((i, *p) for i, t, *_ in left if i in chosen for p in pieces_of(t))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r[:5]) for r in found) == expected and len(expected) > 0
    check_places(found)


def test_stages_return_the_columns_of_documents(spark):
    docs = frame(spark, AWKWARD)
    for empty in (False, True):
        rows = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            done = stage(spark, rows, "")
            assert done.columns == docs.columns and done.dtypes == docs.dtypes, name
            assert done.count() <= rows.count()
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, rows, "").columns


def test_draws_depend_on_the_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    draws = [r["d"] for r in df.select(draw_of("doc_id", "text").alias("d")).collect()]
    assert draws[0] == draws[1] and len(set(draws)) == 4 and all(0 <= d < 1 for d in draws)
