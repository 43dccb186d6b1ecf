"""Rule ledger against a per-text computation and SQL, ranking by held-out accuracy."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoplens.llm.measures import repeated_windows
from shoplens.llm.oracles import ORACLES
from shoplens.llm.quality_ranking import FEATURES, fit, quality_ranking, with_features
from shoplens.llm.quality_rules import BASE, POLICIES, RULES, ablations, apply_policies, mask_of, quality_rules, reject_low_quality
from shoplens.llm.registry import QUERIES
from tests.llm.conftest import AWKWARD, equals_sql, words

SMALL = "/root/testdata/sf0.001"


def measured(text):
    text = text or ""
    own = words(text)
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(own) < 20 or 100 * len(inside) > 30 * len(own),
    }


def test_ledger_equals_brute_force(awkward):
    rows = quality_rules(awkward).collect()
    expected = sorted([(i, *measured(t).values()) for i, t, *_ in AWKWARD], key=str)
    names = list(measured(""))
    assert sorted([(r["doc_id"], *[r[n] for n in names]) for r in rows], key=str) == expected
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert all(r["kept"] == (r["fail_bits"] == 0) for r in rows)


@pytest.mark.parametrize("length", [0, 7, 8, 9, 16, 40])
def test_repeated_windows_of_periodic_texts(length):
    texts = [[b"%d" % (i % p) for i in range(length)] for p in (1, 3, 8, 100)]
    expected = [measured(b" ".join(t).decode())["n_repeat_words"] for t in texts]
    assert repeated_windows(texts).tolist() == expected


@pytest.mark.parametrize("query", ["op4_quality_rules", "rule_ablations"])
def test_ledger_equals_sql(spark, query):
    equals_sql(QUERIES[query](spark, SMALL), ORACLES[query], documents=SMALL)


def test_policies_and_ablations_need_the_ledger_only(awkward):
    ledger = quality_rules(awkward).select("doc_id", "fail_bits")
    rows = apply_policies(ledger).collect()
    for version, rules in POLICIES.items():
        assert [r[f"kept_{version}"] for r in rows] == [r["fail_bits"] & mask_of(rules) == 0 for r in rows]
    found = {r["rule"]: (r["failed"], r["rejected_by_it_alone"]) for r in ablations(ledger).collect()}
    order = list(RULES)
    for rule in RULES:
        bit = 1 << order.index(rule)
        assert found[rule] == (sum(r["fail_bits"] & bit > 0 for r in rows), sum(r["fail_bits"] == bit for r in rows))
    assert mask_of(BASE) == 3


def test_registered_queries_run_all_versions(spark):
    rows = QUERIES["op4_quality_rules"](spark, SMALL).collect()
    for version, rules in POLICIES.items():
        assert [r[f"kept_{version}"] for r in rows] == [r["fail_bits"] & mask_of(rules) == 0 for r in rows]
    found = {(r["version"], r["rule"]): (r["failed"], r["rejected_by_it_alone"]) for r in QUERIES["rule_ablations"](spark, SMALL).collect()}
    bits = [r["fail_bits"] for r in rows]
    assert found == {
        (version, rule): (sum(b & mask_of([rule]) > 0 for b in bits), sum(b & mask_of(rules) == mask_of([rule]) for b in bits))
        for version, rules in POLICIES.items()
        for rule in rules
    }


def test_stage_keeps_columns(awkward, nothing):
    kept = reject_low_quality(awkward)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_rules(awkward).where("kept").collect()}
    assert reject_low_quality(nothing).count() == 0 and quality_rules(nothing).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality_ranking(docs, labels)
    rows = judged.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in judged.collect())
    # A bad document ranks below a good one.
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    first, second = (quality_ranking(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert first == second


def test_ranking_without_pairs(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_ranking(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and {round(r["score"], 9) for r in rows} == {0.7}
    assert quality_ranking(nothing, labels).count() == 0
    assert quality_ranking(awkward, labels.where("false")).count() == len(AWKWARD)
    both = with_features(awkward.drop("features")).where("doc_id in (9, 11)").select("doc_id", (F.col("doc_id") == 9).cast("int").alias("quality"), "features")
    assert len(fit(both).weights) == len(FEATURES)
