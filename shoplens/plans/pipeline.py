"""From raw files to the three stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoplens.plans.processing import clean_and_process
from shoplens.plans.segmentation import segment
from shoplens.sources.readers import read_customers, read_transactions
from shoplens.sources.schemas import PROFILES
from shoplens.sources.stages import StageStore


def process_files(spark: SparkSession, raw_dir: str, store: StageStore, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Read ``customers.<fmt>`` and ``transactions.<fmt>`` below ``raw_dir`` and write two stages."""
    return clean_and_process(
        read_customers(spark, f"{raw_dir}/customers.{fmt}", fmt),
        read_transactions(spark, f"{raw_dir}/transactions.{fmt}", fmt),
        store,
    )


def segment_files(store: StageStore, order_by: list[str] | None = None) -> DataFrame:
    """Read the stage ``customer_profiles`` and write the stage ``segmented_customers``, sorted if ``order_by`` is given."""
    profiles = store.read("customer_profiles", PROFILES, "process_files")
    return store.write("segmented_customers", segment(profiles, store), order_by=order_by)
