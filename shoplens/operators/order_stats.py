"""Exact order statistics over any number of rows: ranks, quantiles and quintile bins.

A window without partition keys moves all rows to one task, and the exact percentile aggregate
keeps one counter per distinct value in one buffer. Here rows, or counted values, are sorted once by
range partitions and written, so that every later look-up agrees on the numbering.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from shoplens.sources.stages import StageStore

# monotonically_increasing_id(): partition number above these bits, row number in them.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1

class SortedRows:
    """Rows in a total order, addressable by their position from 0."""

    def __init__(self, df: DataFrame, order: list[str], store: StageStore):
        """``order`` must identify rows: the unique last column also splits a frequent value."""
        numbered = df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id())
        self.columns = df.columns
        self.rows = store.scratch("sorted", numbered)
        self._part = F.shiftright("_seq", _ROW_BITS)
        # One line per sort partition.
        self._sizes = self.rows.groupBy(self._part.alias("_part")).agg(F.count("*").alias("_n"))

    def pick(self, positions_of) -> list[Row]:
        """Rows at the few positions that ``positions_of(row_count)`` returns, in that order."""
        sizes = sorted((r["_part"], r["_n"]) for r in self._sizes.collect())
        ends = list(accumulate(n for _, n in sizes))
        wanted = positions_of(ends[-1] if ends else 0)
        seqs = []
        for position in wanted:
            i = bisect_right(ends, position)
            part, n = sizes[i]
            seqs.append((part << _ROW_BITS) + position - (ends[i] - n))
        if not seqs:
            return []
        # The pushed-down IN list skips every row group that holds none of the positions.
        found = {r["_seq"]: r for r in self.rows.where(F.col("_seq").isin(seqs)).collect()}
        return [found[seq] for seq in seqs]

    def positions(self) -> DataFrame:
        """All rows with ``_pos``, their 0-based position."""
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = self._sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        # As many lines as the sort had partitions, whatever the number of rows.
        return (
            self.rows.withColumn("_part", self._part)
            .join(F.broadcast(starts), "_part")
            .select(*self.columns, (F.col("_start") + F.col("_seq").bitwiseAND(_ROW_MASK)).alias("_pos"))
        )


def row_rank(df: DataFrame, value: str, key: str, name: str, store: StageStore) -> DataFrame:
    """1-based rank of every row by ``value``, ties in ``key`` order: ``(key, name)``."""
    ranked = SortedRows(df.select(value, key), [value, key], store).positions()
    return ranked.select(key, (F.col("_pos") + 1).alias(name))


def rank_bins(df: DataFrame, value: str, key: str, store: StageStore, bins: int = 5) -> Column:
    """Column expression: equal-frequency bin 1..``bins`` of the unique rank by ``value``.

    Bin k ends at rank 1 + k (n - 1) / bins, so only the rows at those ends are looked up and a
    row is placed by comparing it with them; no rank is joined back.
    """
    cuts = SortedRows(df.select(value, key), [value, key], store).pick(
        lambda n: [k * (n - 1) // bins for k in range(1, bins)] if n else []
    )
    bin_number = F.lit(1)
    for cut in cuts:
        above = (F.col(value) > F.lit(cut[value])) | (
            (F.col(value) == F.lit(cut[value])) & (F.col(key) > F.lit(cut[key]))
        )
        bin_number = bin_number + above.cast("int")
    return bin_number


def _positions(shares: list[float], n: Column) -> Column:
    """Array of (share number, position, weight): two neighbours for every share of ``n`` sorted rows."""
    found = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (n - 1)
        low = F.floor(at)
        for position, weight in ((low, 1 - (at - low)), (F.least(low + 1, n - 1), at - low)):
            found.append(F.struct(F.lit(i).alias("i"), position.alias("pos"), weight.alias("weight")))
    return F.array(*found)


def grouped_quantiles(df: DataFrame, by: list[str], values: list[str], shares: list[float], store: StageStore) -> DataFrame:
    """Exact interpolated quantiles of several columns in one pass: ``by`` and, per value column, an array by share.

    Rows are melted to (group, column, value), equal ones counted first, which spreads over all tasks, and the
    counts sorted once by range and written: the only table. One line per group, column and sort partition
    says how many rows come before it, so each wanted position is known by its partition, and only the
    partitions that have one are added up value by value. Groups and values that are null don't count; a
    column without values in a group has an empty array.
    """
    keys = [*by, "_c"]
    melted = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)])
    rows = df.select(*by, F.inline(melted))
    for column in [*by, "_v"]:
        rows = rows.where(F.col(column).isNotNull())
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_times"))
    counted = store.scratch("counted", counted.orderBy(*keys, "_v").withColumn("_part", F.spark_partition_id()))

    # No more lines than groups and sort partitions together, since the order goes by group.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        counted.groupBy(*keys, "_part")
        .agg(F.sum("_times").alias("_held"))
        .withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0)))
        .withColumn("_n", F.sum("_held").over(Window.partitionBy(*keys)))
    )
    here = F.filter(
        _positions(shares, F.col("_n")),
        lambda x: (x["pos"] >= F.col("_before")) & (x["pos"] < F.col("_before") + F.col("_held")),
    )
    targets = parts.select(*keys, "_part", "_before", here.alias("_wanted")).where(F.size("_wanted") > 0)
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.join(targets, [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_times").over(upto))
    hit = F.filter("_wanted", lambda x: (x["pos"] < F.col("_upto")) & (x["pos"] >= F.col("_upto") - F.col("_times")))
    found = (
        reached.select(*keys, "_v", F.inline(hit))
        .groupBy(*keys, "i")
        .agg(F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(F.sum(F.col("weight") * F.col("_v"))).alias("_q"))
    )

    def of_column(i: int) -> Column:
        own = F.collect_list(F.when(F.col("_c") == i, F.struct("i", "_q")))
        return F.transform(F.array_sort(own), lambda x: x["_q"])

    return found.groupBy(*by).agg(*[of_column(i).alias(v) for i, v in enumerate(values)])


def quantiles_of(df: DataFrame, values: list[str], shares: list[float], store: StageStore) -> dict[str, list[float]]:
    """Exact interpolated quantiles of the non-null values of several columns, from one pass; an empty list without values."""
    return grouped_quantiles(df, [], values, shares, store).first().asDict()


def quantiles(df: DataFrame, value: str, shares: list[float], store: StageStore) -> list[float] | None:
    return quantiles_of(df, [value], shares, store)[value] or None


def quantile(df: DataFrame, value: str, share: float, store: StageStore) -> float | None:
    found = quantiles(df, value, [share], store)
    return found[0] if found else None


def value_bins(df: DataFrame, value: str, store: StageStore, bins: int = 5, strict: bool = False) -> Column:
    """Column expression: bin 1..``bins`` between interpolated quantiles, each closed on the right.

    Equal neighbouring edges leave a bin empty, or raise if ``strict``.
    """
    ends = quantiles(df, value, [k / bins for k in range(bins + 1)], store)
    if strict and ends and any(a == b for a, b in zip(ends, ends[1:])):
        raise ValueError(f"quantile edges of {value} must be unique: {ends}")
    bin_number = F.lit(1)
    for edge in (ends or [])[1:-1]:
        bin_number = bin_number + (F.col(value) > F.lit(edge)).cast("int")
    return bin_number
