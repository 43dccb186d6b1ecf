"""Histogram, density curve and box-plot statistics of one numeric column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from shoplens.operators.order_stats import grouped_quantiles
from shoplens.sources.stages import StageStore

# Fixed values of the charts.
EXPLORATION_BINS = 20
DASHBOARD_BINS = 15
DENSITY_POINTS = 200
WHISKER_REACH = 1.5


def _numbers(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum, empty bins included.

    Bins are closed on the left, the last one on both sides. Each task sends one count per bin.
    The bounds are looked up first, so pass a table that is cheap to read twice.
    """
    numbers = _numbers(df, column)
    low, high = numbers.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = float("nan")
    if low == high:
        # A single value gets a range of one around it.
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins

    def edge(i: Column) -> Column:
        return i * F.lit(width) + F.lit(low)

    # The division may land next to the bin whose edges enclose the value; the edges decide.
    guess = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    placed = (
        numbers.withColumn("_g", guess)
        .withColumn(
            "bin",
            F.when(F.col("x") < edge(F.col("_g")), F.col("_g") - 1)
            .when((F.col("x") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
            .otherwise(F.col("_g")),
        )
        .select("bin", F.lit(1).cast("bigint").alias("one"))
    )
    every_bin = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("one")
    )
    return (
        placed.unionByName(every_bin)
        .groupBy("bin")
        .agg(F.sum("one").alias("customers"))
        .select(
            "bin",
            edge(F.col("bin")).alias("bin_start"),
            F.when(F.col("bin") == bins - 1, high).otherwise(edge(F.col("bin") + 1)).alias("bin_end"),
            "customers",
        )
        .orderBy("bin")
    )


def density_curve(df: DataFrame, column: str, bins: int, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density between minimum and maximum, bandwidth by Scott's rule.

    ``scaled`` is the density in units of the histogram with ``bins`` bins. Equal values are
    counted first; every distinct value then adds to the fixed number of points, and each task
    sends one partial sum per point. No curve is drawn through fewer than two distinct values.
    """
    numbers = _numbers(df, column)
    n, low, high, deviation = numbers.agg(
        F.count("x"), F.min("x"), F.max("x"), F.stddev_samp("x")
    ).first()
    if not deviation:
        return df.sparkSession.range(0).selectExpr(
            "cast(id as int) AS point", "0D AS x", "0D AS density", "0D AS scaled"
        )
    bandwidth = deviation * n**-0.2
    step = (high - low) / (points - 1)

    def at(i: Column) -> Column:
        return i * F.lit(step) + F.lit(low)

    distance = (at(F.col("point")) - F.col("x")) / F.lit(bandwidth)
    return (
        numbers.groupBy("x")
        .agg(F.count("*").alias("times"))
        .select("x", "times", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy("point")
        .agg(F.sum(F.col("times") * F.exp(-0.5 * distance * distance)).alias("mass"))
        .withColumn("density", F.col("mass") / F.lit(n * bandwidth * math.sqrt(2 * math.pi)))
        .select(
            "point",
            F.round(at(F.col("point")), 6).alias("x"),
            F.round("density", 6).alias("density"),
            F.round(F.col("density") * F.lit(n * ((high - low) / bins)), 6).alias("scaled"),
        )
        .orderBy("point")
    )


def box_statistics(df: DataFrame, by: str, value: str, store: StageStore) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group.

    Whiskers reach to the farthest value within 1.5 quartile ranges of the box, and at least to
    the box itself.
    """
    shares = [0.25, 0.5, 0.75]
    quartiles = grouped_quantiles(df, [by], [value], shares, store)
    boxes = quartiles.select(by, *[F.col(value)[i].alias(name) for i, name in enumerate(["q1", "median", "q3"])])
    x = F.col(value)
    reach = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        df.select(by, x.cast("double").alias(value))
        .where(x.isNotNull())
        .join(boxes, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count("*").alias("customers"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
            F.min(F.when(inside, x)).alias("_low"),
            F.max(F.when(inside, x)).alias("_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(
            by,
            "customers",
            "lowest",
            F.least("_low", "q1").alias("whisker_low"),
            "q1",
            "median",
            "q3",
            F.greatest("_high", "q3").alias("whisker_high"),
            "highest",
            "outliers",
        )
        .orderBy(by)
    )
