"""Ranks, quantiles and score bins against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.functions.columns import rfm_segment
from shoplens.operators.order_stats import (
    SortedRows,
    grouped_quantiles,
    quantile,
    rank_bins,
    row_rank,
    value_bins,
)


def frame(spark, values, partitions=3):
    pdf = pd.DataFrame({"customer_id": np.arange(len(values)), "x": values})
    return spark.createDataFrame(pdf).repartition(partitions)


def binned(df, expression):
    return [r["b"] for r in df.withColumn("b", expression).orderBy("customer_id").collect()]


@pytest.mark.parametrize("n", [5, 6, 7, 9, 11, 23, 101, 998])
def test_rank_bins_equal_qcut_of_rank(spark, store, n):
    values = np.random.default_rng(n).integers(0, 6, n)
    df = frame(spark, values)
    expected = pd.qcut(pd.Series(values).rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert binned(df, rank_bins(df, "x", "customer_id", store)) == expected


def test_rank_bins_of_seven_and_one(spark, store):
    df = frame(spark, np.arange(7))
    assert binned(df, rank_bins(df, "x", "customer_id", store)) == [1, 1, 2, 3, 4, 5, 5]
    one = frame(spark, np.array([3]))
    assert binned(one, rank_bins(one, "x", "customer_id", store)) == [1]


def test_rank_with_text_keys_and_one_value(spark, store):
    df = spark.createDataFrame([(f"C{i}", 7) for i in range(5)], "customer_id string, x int")
    assert binned(df, rank_bins(df, "x", "customer_id", store)) == [1, 2, 3, 4, 5]
    assert [r["r"] for r in row_rank(df, "x", "customer_id", "r", store).orderBy("customer_id").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", range(4))
def test_value_bins_equal_qcut(spark, store, seed):
    values = np.random.default_rng(seed).integers(0, 400, 300 + seed)
    df = frame(spark, values)
    expected = pd.qcut(values, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert binned(df, value_bins(df, "x", store)) == expected


def test_value_bins_cases(spark, store):
    df = frame(spark, np.arange(10))
    assert binned(df, F.lit(6) - value_bins(df, "x", store)) == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    repeated = frame(spark, np.array([0, 0, 0, 1, 2, 3, 4, 5, 6, 7]))
    with pytest.raises(ValueError, match="unique"):
        value_bins(repeated, "x", store, strict=True)
    assert binned(repeated, F.lit(6) - value_bins(repeated, "x", store)) == [5, 5, 5, 4, 3, 3, 2, 2, 1, 1]


def hot_values(n, seed=1):
    """A third of all rows share one value."""
    rng = np.random.default_rng(seed)
    values = np.round(rng.gamma(2.0, 100.0, n), 2)
    values[rng.random(n) < 1 / 3] = 42.0
    return values


def test_ranks_over_several_partitions(spark, store):
    values = hot_values(5000)
    df = frame(spark, values)
    expected = pd.Series(values).rank(method="first").astype(int).tolist()
    # Small sort partitions, which adaptive execution would otherwise merge into one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = row_rank(df, "x", "customer_id", "r", store)
        assert [r["r"] for r in ranked.orderBy("customer_id").collect()] == expected
        sorted_rows = SortedRows(df, ["x", "customer_id"], store)
        assert sorted_rows.rows.select(sorted_rows._part).distinct().count() > 1
        # The shared value does not pile up in one sort partition.
        sizes = [r["n"] for r in sorted_rows.rows.groupBy(sorted_rows._part).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 5000 * 0.5
        picked = sorted_rows.pick(lambda n: [0, 1, n // 2, n - 1])
        order = np.sort(values)
        assert [r["x"] for r in picked] == [order[0], order[1], order[2500], order[4999]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 2, 9, 10, 1001])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_quantile_equals_numpy(spark, store, n, share):
    values = hot_values(n)
    assert quantile(frame(spark, values), "x", share, store) == pytest.approx(np.quantile(values, share), rel=1e-12)


def test_quantile_of_nothing(spark, store):
    df = spark.createDataFrame([(1, None)], "customer_id int, x double")
    assert quantile(df, "x", 0.5, store) is None


def test_grouped_quantiles_equal_numpy(spark, store):
    """Over many sort partitions, with a group that holds most rows and a value that a third share."""
    n = 3000
    values = hot_values(n)
    groups = np.random.default_rng(2).choice([1, 2, 3], n, p=[0.8, 0.1, 0.1])
    pdf = pd.DataFrame({"customer_id": np.arange(n), "g": groups, "x": values, "y": np.arange(n) % 17})
    df = spark.createDataFrame(pdf).repartition(4).withColumn("none", F.lit(None).cast("int"))
    shares = [0.25, 0.5, 0.75]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r["g"]: r for r in grouped_quantiles(df, ["g"], ["x", "y", "none"], shares, store).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 3
    for g, rows in pdf.groupby("g"):
        assert found[g]["x"] == pytest.approx(np.quantile(rows["x"], shares), rel=1e-12)
        assert found[g]["y"] == pytest.approx(np.quantile(rows["y"], shares), rel=1e-12)
        assert found[g]["none"] == []


def test_segment_of_every_code(spark):
    codes = spark.range(125).select(
        (F.floor(F.col("id") / 25) + 1).alias("r"),
        (F.floor(F.col("id") / 5) % 5 + 1).alias("f"),
        (F.col("id") % 5 + 1).alias("m"),
    )
    named = codes.select("r", "f", "m", rfm_segment(F.col("r"), F.col("f"), F.col("m")).alias("s"))
    counts = {r["s"]: r["count"] for r in named.groupBy("s").count().collect()}
    assert counts == {
        "Champions": 8,
        "Loyalists": 19,
        "Potential Loyalists": 14,
        "New Customers": 18,
        "Can't Lose Them": 8,
        "At Risk": 24,
        "Hibernating": 34,
    }
    picked = {(r["r"], r["f"], r["m"]): r["s"] for r in named.collect()}
    assert picked[(4, 5, 4)] == "Champions" and picked[(3, 2, 5)] == "Hibernating"
    assert picked[(5, 1, 5)] == "New Customers" and picked[(2, 4, 2)] == "At Risk"
