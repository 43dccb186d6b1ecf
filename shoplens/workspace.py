"""The retail pipeline over one star-schema folder, stage by stage."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from shoplens.operators.clustering import nearest_centre
from shoplens.operators.slicing import DashboardFilter, filtered_sales
from shoplens.plans.dashboard import SALES_KEYS
from shoplens.plans.processing import (
    customer_profiles,
    derive_features,
    fill_customers,
    unique_customers,
    with_month,
)
from shoplens.plans.quality import column_counts
from shoplens.plans.reports import sales_summary
from shoplens.plans.segmentation import segment
from shoplens.sources import star_schema
from shoplens.sources.schemas import CUSTOMERS_RAW
from shoplens.sources.stages import StageStore, fingerprint

# Scaled recency, frequency and spend of four typical customers, for reproducible labels.
TYPICAL_CENTRES = [(-0.8, 0.9, 0.9), (0.5, 0.4, 0.4), (-0.3, -0.7, -0.7), (1.0, -2.0, -2.2)]


class Workspace:
    """Stages are built when first asked for and then read, by every report, from their tables.

    A workspace keeps its stages for good: make a new one when ``inputs()`` changes.
    ``status`` restricts transactions to orders of one status.
    """

    def __init__(self, spark: SparkSession, folder: str, store: StageStore | None = None, status: str | None = None):
        self.spark = spark
        self.folder = folder
        self.store = store or StageStore(spark)
        self.status = status

    @staticmethod
    def inputs(spark: SparkSession, folder: str) -> str:
        """Fingerprint of the tables that the stages are made from."""
        return fingerprint(spark, [f"{folder}/{name}.parquet" for name in star_schema.TABLES])

    def raw_customers(self) -> DataFrame:
        return star_schema.customers(self.spark, self.folder)

    def raw_transactions(self) -> DataFrame:
        """Raw transactions, written once for the quality profiles that read them column by column."""
        return self.store.table(
            "raw_transactions", lambda: star_schema.transactions(self.spark, self.folder, self.status)
        )

    def column_counts(self) -> DataFrame:
        """Rows and filled values of each raw column, from one pass per table."""
        raw = {"customers": self.raw_customers(), "transactions": self.raw_transactions()}
        return self.store.table("column_counts", lambda: column_counts(raw))

    def unique_transactions(self) -> DataFrame:
        return star_schema.unique_transactions(self.spark, self.folder, self.status)

    def unique_customers(self) -> DataFrame:
        # The star schema has no file order: of copies the one stays that comes first by its columns.
        order = [c for c in CUSTOMERS_RAW.fieldNames() if c != "customer_id"]
        return self.store.table("unique_customers", lambda: unique_customers(self.raw_customers(), order))

    def customers_clean(self) -> DataFrame:
        return fill_customers(self.unique_customers(), self.store)

    def transactions(self) -> DataFrame:
        return self.store.table(
            "cleaned_transactions",
            lambda: with_month(star_schema.unique_lines(self.spark, self.folder, self.status)),
            partition_by="year_month",
            derive=lambda lines: derive_features(star_schema.with_ids(lines)),
        )

    def customers(self) -> DataFrame:
        return self.store.table("customers", self.customers_clean)

    def profiles(self) -> DataFrame:
        return self.store.table(
            "customer_profiles", lambda: customer_profiles(self.customers(), self.transactions())
        )

    def sales_summary(self, name: str, choice: DashboardFilter) -> DataFrame:
        """Sales of one choice of filters, added up for every report in one scan of the transactions."""

        def build() -> DataFrame:
            return sales_summary(
                filtered_sales(self.transactions(), self.profiles(), choice, SALES_KEYS, ["location", "churn_status"])
            )

        return self.store.table(f"sales_summary_{name}", build, partition_by="report")

    def segmented(self) -> DataFrame:
        """Customers clustered by K-Means."""
        return self.store.table("segmented_customers", lambda: segment(self.profiles(), self.store))

    def segmented_by_centres(self) -> DataFrame:
        """Customers labelled with the nearest of the typical centres."""
        label = partial(nearest_centre, centres=TYPICAL_CENTRES)
        return self.store.table("customers_by_centre", lambda: segment(self.profiles(), self.store, assign=label))
