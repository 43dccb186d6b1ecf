"""Data-quality profiles: gaps, repeated keys, shape and types. One pass per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def column_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Type, filled values and rows per column, from one aggregate per table."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
        types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
        parts.append(
            counts.unpivot(["_rows"], df.columns, "column_name", "non_null_count").select(
                F.lit(name).alias("table_name"),
                "column_name",
                types[F.col("column_name")].alias("data_type"),
                "non_null_count",
                F.col("_rows").alias("row_count"),
                F.lit(len(df.columns)).alias("column_count"),
            )
        )
    return _union(parts)


def null_profile(counts: DataFrame) -> DataFrame:
    """Missing values per column, from :func:`column_counts`."""
    return counts.select("table_name", "column_name", (F.col("row_count") - F.col("non_null_count")).alias("null_count"))


def duplicate_profile(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows beyond the first of their key; rows without a key repeat each other."""
    parts = []
    for name, (df, key) in keys.items():
        distinct = F.countDistinct(key) + F.max(F.col(key).isNull().cast("int"))
        parts.append(
            df.agg(
                F.count("*").alias("row_count"),
                F.coalesce(F.count("*") - distinct, F.lit(0)).cast("bigint").alias("duplicate_rows"),
            ).select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "row_count", "duplicate_rows")
        )
    return _union(parts)


def table_profile(counts: DataFrame) -> DataFrame:
    """Shape of each table, and type and filled values of each column, from :func:`column_counts`."""
    return counts.select("table_name", "column_name", "data_type", "non_null_count", "row_count", "column_count")


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
