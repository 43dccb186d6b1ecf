"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import _QUERIES, CHOICE, queries, workspace
from shoplens.operators.clustering import SCALED, cluster_medians, lloyd_step, nearest_centre, scaled_features
from shoplens.operators.order_stats import quantile
from shoplens.operators.slicing import DashboardFilter, filtered_sales, filtered_transactions
from shoplens.plans.dashboard import SALES_KEYS
from shoplens.plans.processing import fill_customers
from shoplens.plans.segmentation import purchasers
from shoplens.workspace import TYPICAL_CENTRES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(_QUERIES))
def test_no_python_worker(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct", plan)


@pytest.mark.parametrize("name", ["transactions_dedup", "transactions_enriched"])
def test_copies_are_dropped_before_the_exchange(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert re.search(r"Exchange hashpartitioning\(l_orderkey.*\n.*WindowGroupLimit.*Partial", plan)


def test_no_single_partition_below_an_aggregate(spark):
    """Rows meet in one task only as partial aggregates or as one line per sort partition."""
    for name in ["customer_profile", "rfm_scores", "segmented_customers_fixed", "filtered_transactions", "purchase_rank"]:
        lines = plan_of(queries()[name](spark, FOLDER)).splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" in line:
                assert "HashAggregate" in lines[i + 1], name


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(queries()["filtered_transactions"](spark, FOLDER))
    assert re.search(r"PartitionFilters: \[[^\]]*year_month", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(transaction_date", plan)
    assert re.search(r"PushedFilters: \[[^\]]*In\(product_category", plan)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_reports_read_their_columns_only(spark):
    tx = workspace(spark, FOLDER).transactions()
    customers = workspace(spark, FOLDER).profiles()
    plan = filtered_sales(tx, customers, CHOICE, ["payment_method"])
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan._jdf.queryExecution().executedPlan().toString())
    assert all("product_name" not in s and "age" not in s for s in schemas)


def test_one_exchange_of_the_slice(spark):
    """Facts and customers are each moved once; nothing is added up by many keys before the join."""
    tx, customers = workspace(spark, FOLDER).transactions(), workspace(spark, FOLDER).profiles()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = plan_of(filtered_sales(tx, customers, CHOICE, SALES_KEYS, ["location", "churn_status"]))
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert plan.count("Exchange hashpartitioning") == 2 and "HashAggregate" not in plan


def test_no_buffer_takes_all_values(spark, store):
    """Quantiles add equal values up in the tasks and never fill a percentile buffer."""
    profiles = workspace(spark, FOLDER).profiles()
    for name in ["cluster_medians", "spend_by_satisfaction_box", "rfm_scores"]:
        assert "percentile" not in plan_of(queries()[name](spark, FOLDER))
    tables = counted_tables(store)
    quantile(profiles, "total_spend", 0.5, store)
    assert tables and not any("percentile" in plan or "SinglePartition" in plan for _, plan in tables)


def counted_tables(store):
    """The labels and plans of the tables that ``store`` writes from now on."""
    tables, scratch = [], store.scratch
    store.scratch = lambda label, df: (tables.append((label, plan_of(df))), scratch(label, df))[1]
    return tables


def test_one_table_for_all_quantiles(spark, store):
    """Medians of several columns and groups come from one sort, whose counts are the only table."""
    profiles = workspace(spark, FOLDER).profiles()
    tables = counted_tables(store)
    fill_customers(workspace(spark, FOLDER).unique_customers(), store).collect()
    assert [label for label, _ in tables] == ["counted"] and tables[0][1].count("rangepartitioning") == 1
    tables.clear()
    clustered = nearest_centre(scaled_features(purchasers(profiles)), TYPICAL_CENTRES)
    assert cluster_medians(clustered, store).count() == 4
    assert [label for label, _ in tables] == ["counted"]


def test_one_scan_for_all_starts(spark, store):
    """An iteration reads the features once and adds up once, however many starts still move."""
    points = store.scratch("points", scaled_features(purchasers(workspace(spark, FOLDER).profiles())).select(SCALED))
    starts = [[(float(s), 0.0, 0.0), (0.0, 1.0, float(-s)), (1.0, 1.0, 1.0), (-1.0, 0.5, 2.0)] for s in range(10)]
    plan = plan_of(lloyd_step(points, starts, set(range(10))))
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    found = {(r["start"], r["cluster"]): r["n"] for r in lloyd_step(points, starts, set(range(10))).collect()}
    assert {r["start"] for r in lloyd_step(points, starts, {2, 7}).collect()} == {2, 7}
    for s, centres in enumerate(starts):
        alone = nearest_centre(points, centres).groupBy("kmeans_cluster").count().collect()
        assert {(s, r["kmeans_cluster"]): r["count"] for r in alone} == {k: n for k, n in found.items() if k[0] == s}


def skewed(spark):
    """Half of all transactions belong to one customer."""
    tx = spark.range(0, 200_000, 1, 8).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("customer_id"),
        F.lit("2025-01-01").cast("timestamp_ntz").alias("transaction_date"),
        F.lit("A").alias("product_category"),
        F.lit(1).cast("decimal(18,4)").alias("revenue"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"),
    )
    customers = spark.range(5000).select(F.col("id").alias("customer_id"), F.lit("x").alias("location"))
    return tx, customers


def test_a_hot_month_is_split(spark, store):
    """A month that holds half of all rows is written by several tasks, a small one by one task."""
    tx, _ = skewed(spark)
    month = F.when(F.col("customer_id") == 7, "2025-01").otherwise(F.concat(F.lit("2024-0"), F.col("customer_id") % 9))
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB",
        "spark.sql.shuffle.partitions": "200",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        store.write("tx", tx.withColumn("year_month", month), partition_by="year_month")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = {
        folder: sum(f.endswith(".parquet") for f in os.listdir(f"{store.path('tx')}/{folder}"))
        for folder in os.listdir(store.path("tx"))
        if "=" in folder
    }
    assert files.pop("year_month=2025-01") > 1
    assert set(files.values()) == {1}


def test_a_hot_customer_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        tx, customers = skewed(spark)
        kept = filtered_transactions(tx, customers, DashboardFilter())
        assert len(kept.collect()) == 200_000
        assert "skew=true" in plan_of(kept)
        narrow = filtered_sales(tx, customers, DashboardFilter(), ["product_category"])
        assert narrow.agg(F.sum("rows")).first()[0] == 200_000
        # Without further keys the customer is added up first and leaves each task as one line.
        lines = filtered_sales(tx, customers, DashboardFilter())
        assert lines.agg(F.sum("rows")).first()[0] == 200_000
        assert re.search(r"Exchange hashpartitioning\(customer_id.*\n.*HashAggregate.*partial_sum", plan_of(lines))
    finally:
        for key in settings:
            spark.conf.unset(key)
