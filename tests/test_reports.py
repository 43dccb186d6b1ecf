"""Filters, key figures and report tables on small hand-made tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from shoplens import DashboardFilter, dashboard
from shoplens.functions.columns import calendar_columns
from shoplens.operators.slicing import filtered_customers, filtered_sales, filtered_transactions, sales
from shoplens.plans import reports
from shoplens.plans.quality import column_counts, duplicate_profile, null_profile, table_profile


@pytest.fixture(scope="module")
def tx(spark):
    rows = [
        ("T1", "C1", "2025-01-10 00:00:00", "A", "a1", 100.0, "Cash"),
        ("T2", "C1", "2025-03-31 23:00:00", "B", "b1", 50.0, "Card"),
        ("T3", "C2", "2025-03-31 08:00:00", "A", "a2", 10.0, "Cash"),
        ("T4", "C3", "2025-06-01 00:00:00", "A", "a1", 40.0, "Cash"),
        ("T5", "ghost", "2025-01-11 00:00:00", "A", "a1", 999.0, "Cash"),
        (None, "C2", "2025-01-12 00:00:00", None, "n1", 1.0, None),
    ]
    df = spark.createDataFrame(
        rows, "transaction_id string, customer_id string, t string, product_category string,"
        " product_name string, r double, payment_method string"
    )
    ts = F.col("t").cast("timestamp_ntz")
    calendar = [c.alias(n) for n, c in calendar_columns(ts).items()]
    return df.select(
        "transaction_id", "customer_id", ts.alias("transaction_date"), "product_category", "product_name",
        F.col("r").cast("decimal(18,4)").alias("revenue"), "payment_method", *calendar,
    ).persist()


@pytest.fixture(scope="module")
def customers(spark):
    rows = [
        ("C1", 30, 1000, "Texas", 5, 150.0, 2, "A", 10, "Active", "Champions", "VIP Spenders"),
        ("C2", 40, 2000, "Ohio", 3, 11.0, 2, "A", 200, "Churned", "At Risk", "Lost Customers"),
        ("C3", 50, 3000, "Texas", 3, 40.0, 1, "A", 0, "Active", "Loyalists", "VIP Spenders"),
        ("C4", 60, 4000, "Texas", 1, 0.0, 0, "None", 1095, "Churned", "Inactive", "Never Purchased"),
    ]
    return spark.createDataFrame(
        rows, "customer_id string, age int, annual_income int, location string, satisfaction_score int,"
        " total_spend double, total_transactions long, preferred_category string, recency_days long,"
        " churn_status string, rfm_segment string, cluster_name string"
    ).withColumn("avg_order_value", F.lit(1.0)).persist()


def ids(df, column="customer_id"):
    return sorted(r[column] for r in df.collect())


def kpis(tx, customers, choice):
    return reports.kpi_cards(filtered_sales(tx, customers, choice, attributes=["churn_status"])).first()


def test_no_filter_drops_unknown_customers_only(tx, customers):
    everything = DashboardFilter()
    assert ids(filtered_customers(tx, customers, everything)) == ["C1", "C2", "C3"]
    assert ids(filtered_transactions(tx, customers, everything)) == ["C1", "C1", "C2", "C2", "C3"]


def test_end_day_is_included_and_location_needs_a_sale(tx, customers):
    choice = DashboardFilter(date(2025, 3, 1), date(2025, 3, 31), locations=["Texas"])
    assert ids(filtered_customers(tx, customers, choice)) == ["C1"]
    assert ids(filtered_transactions(tx, customers, choice), "transaction_id") == ["T2"]


def test_category_filter(tx, customers):
    choice = DashboardFilter(categories=["B"])
    assert ids(filtered_customers(tx, customers, choice)) == ["C1"]
    nothing = DashboardFilter(categories=[])
    assert ids(filtered_customers(tx, customers, nothing)) == []


def test_kpis(tx, customers):
    row = kpis(tx, customers, DashboardFilter())
    assert (row["total_revenue"], row["active_customers"], row["total_orders"]) == (201.0, 3, 5)
    assert row["avg_order_value"] == 201.0 / 5
    assert row["churned_customers"] == 1 and row["churn_rate"] == pytest.approx(100 / 3) and row["churn_alert"]


def test_kpis_of_nothing(tx, customers):
    row = kpis(tx, customers, DashboardFilter(start=date(2030, 1, 1)))
    assert (row["total_revenue"], row["total_orders"], row["avg_order_value"], row["churn_rate"]) == (0, 0, 0, 0)
    assert row["active_customers"] == 0 and not row["churn_alert"]


def test_formatted_kpis(tx, customers):
    shown = reports.kpi_cards_formatted(
        filtered_sales(tx, customers, DashboardFilter(), attributes=["churn_status"])
    ).first()
    assert tuple(shown) == ("$201.00", "3", "$40.20", "33.3%", "1 customers at risk", True)


def test_months_without_sales_are_absent(tx):
    months = reports.monthly_revenue(sales(tx, ["year_month"])).collect()
    assert [(r["year_month"], r["revenue"]) for r in months] == [("2025-01", 1100.0), ("2025-03", 60.0), ("2025-06", 40.0)]


def test_missing_keys_are_dropped(tx):
    split = reports.payment_split(sales(tx, ["payment_method"])).collect()
    assert [r["payment_method"] for r in split] == ["Card", "Cash"]
    assert sum(r["share_pct"] for r in split) == pytest.approx(100)
    performance = reports.category_performance(sales(tx, ["product_category"])).collect()
    assert [(r["product_category"], r["orders"]) for r in performance] == [("A", 4), ("B", 1)]


def test_fewer_products_than_the_limit(tx):
    top = reports.top_products(sales(tx, ["product_category", "product_name"])).collect()
    assert [r["product_name"] for r in top] == ["a1", "b1", "a2"]


def test_sales_added_up_before_or_after_the_join_agree(tx, customers):
    rows = filtered_transactions(tx, customers, DashboardFilter())
    direct = reports.category_performance(sales(rows, ["product_category"])).collect()
    summed = filtered_sales(tx, customers, DashboardFilter(), ["product_category"])
    assert reports.category_performance(summed).collect() == direct


def test_revenue_by_location(tx, customers):
    found = reports.revenue_by_location(filtered_sales(tx, customers, DashboardFilter(), attributes=["location"]))
    assert [tuple(r) for r in found.collect()] == [("Ohio", 11.0), ("Texas", 190.0)]


def test_churn_columns_exist_without_churn(customers):
    active = customers.where("churn_status = 'Active'")
    assert [tuple(r) for r in reports.churn_by_location(active).collect()] == [("Texas", 100.0, 0.0)]
    rows = reports.churn_by_category(customers).collect()
    assert [r["preferred_category"] for r in rows] == ["A", "None"]
    assert all(r["active_pct"] + r["churned_pct"] == pytest.approx(100) for r in rows)


def test_cluster_tables(customers):
    shown = {r["cluster_name"]: tuple(r)[1:] for r in reports.cluster_profile_formatted(customers).collect()}
    assert shown["VIP Spenders"] == ("2", "$95.00", "1.5 orders", "5 days ago", "$2,000", "40.0 years", "4.00 / 5.0")
    assert ids(reports.cluster_scatter(customers)) == ["C1", "C2", "C3"]
    assert reports.cluster_distribution(customers).first()["cluster_name"] == "VIP Spenders"


def test_means_of_very_large_spends(spark, customers):
    rich = customers.withColumn("total_spend", F.lit(5e15))
    row = reports.cluster_profile(rich).first()
    assert row["avg_spend"] == 5e15


def test_mean_spend_is_not_rounded_before_it_is_added_up(spark, customers):
    spends = spark.createDataFrame([(0.00004,), (10.00003125,), (10.00003125,)], "total_spend double")
    rows = customers.limit(1).drop("total_spend").withColumn("cluster_name", F.lit("x")).crossJoin(spends)
    assert reports.cluster_profile(rows).first()["avg_spend"] == 20.0001025 / 3


def test_one_scan_for_all_sales_reports(tx, customers):
    """Sums by grouping sets give each report what its own sales lines give, with one scan of the transactions."""
    lines = filtered_sales(tx, customers, DashboardFilter(), ["year_month", "payment_method", "product_category", "product_name"], ["location", "churn_status"])
    summary = reports.sales_summary(lines)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2 and "Expand" in plan
    summary = summary.persist()
    for name, keys in reports.SALES_REPORTS.items():
        report = getattr(reports, name)
        alone = filtered_sales(tx, customers, DashboardFilter(), [k for k in keys if k in tx.columns and k != "customer_id"], ["location", "churn_status"])
        assert report(reports.of_report(summary, name)).collect() == report(alone).collect(), name


def test_number_formats_round_half_to_even(spark):
    from shoplens.functions.columns import dollars, plain_number

    df = spark.createDataFrame([(0.125, 1234567.5)], "a double, b double")
    assert tuple(df.select(plain_number(F.col("a"), 2), plain_number(F.col("b"), 1), dollars(F.col("b"))).first()) == (
        "0.12", "1234567.5", "$1,234,567.50",
    )


def test_quality_profiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), (None, 3)], "k string, v int")
    counts = column_counts({"t": df})
    assert [tuple(r) for r in null_profile(counts).collect()] == [("t", "k", 2), ("t", "v", 1)]
    assert tuple(duplicate_profile({"t": (df, "k")}).first()) == ("t", "k", 4, 2)
    assert [tuple(r) for r in table_profile(counts).collect()] == [
        ("t", "k", "string", 2, 4, 2), ("t", "v", "int", 3, 4, 2),
    ]
    empty = df.where("false")
    assert tuple(duplicate_profile({"t": (empty, "k")}).first()) == ("t", "k", 0, 0)


def test_dashboard_tables_agree_with_each_other(tx, customers, store):
    tables = dashboard(tx, customers, DashboardFilter(start=date(2025, 1, 1), end=date(2025, 5, 31)), store)
    kpi = tables["kpi_cards"].first()
    for name in ["monthly_revenue", "revenue_by_location"]:
        assert sum(r["revenue"] for r in tables[name].collect()) == kpi["total_revenue"]
    assert tables["filtered_transactions"].count() == kpi["total_orders"]
    for name in ["rfm_distribution", "satisfaction_distribution", "age_histogram", "spend_by_satisfaction"]:
        assert sum(r["customers"] for r in tables[name].collect()) == kpi["active_customers"]
    assert [r["value"] for r in tables["filter_options"].where("kind = 'location'").collect()] == ["Ohio", "Texas"]
    for table in tables.values():
        table.collect()
