"""Filling of missing customer attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoplens.operators.order_stats import quantiles_of
from shoplens.sources.stages import StageStore


def fill_int(column: str, default: float | None) -> Column:
    """Missing values replaced, then the fraction cut off."""
    return F.coalesce(F.col(column), F.lit(default)).cast("int").alias(column)


def median_fills(df: DataFrame, columns: list[str], store: StageStore) -> dict[str, Column]:
    """Each column filled with its median; all medians come from one pass."""
    medians = quantiles_of(df, columns, [0.5], store)
    return {c: fill_int(c, medians[c][0] if medians[c] else None) for c in columns}
