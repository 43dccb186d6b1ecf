"""All report tables of one dashboard request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplens.operators.distributions import DASHBOARD_BINS, box_statistics, histogram
from shoplens.operators.slicing import (
    DashboardFilter,
    filtered_customers,
    filtered_sales,
    filtered_transactions,
)
from shoplens.plans import reports
from shoplens.sources.schemas import SEGMENTED, TRANSACTIONS_CLEAN
from shoplens.sources.stages import StageStore, pinned


def load_stages(store: StageStore, pin: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two stage tables that the reports read.

    ``pin`` keeps the customers loaded between requests; the facts stay files, of which each request
    reads the months and columns it needs.
    """
    transactions = store.read("cleaned_transactions", TRANSACTIONS_CLEAN, "clean_and_process")
    customers = store.read("segmented_customers", SEGMENTED, "segment")
    return (transactions, *pinned(customers)) if pin else (transactions, customers)


def spend_by_satisfaction(profiles: DataFrame, store: StageStore) -> DataFrame:
    """Box statistics of customers' lifetime spend per satisfaction score."""
    return box_statistics(profiles, "satisfaction_score", "total_spend", store)


def purchasers_spend(customers: DataFrame, transactions: DataFrame, store: StageStore) -> DataFrame:
    """Spend and satisfaction of customers with a transaction, written as several passes read it."""
    spend = (
        transactions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.sum("revenue").cast("double").alias("total_spend"))
        .fillna({"total_spend": 0.0})
    )
    return store.scratch("spend", spend.join(customers.select("customer_id", "satisfaction_score"), "customer_id"))


# Every key that a sales table of the dashboard groups by.
SALES_KEYS = ["year_month", "payment_method", "product_category", "product_name"]


def dashboard(
    transactions: DataFrame, segmented: DataFrame, choice: DashboardFilter, store: StageStore
) -> dict[str, DataFrame]:
    """Every table of the dashboard for one choice of filters.

    The filtered customers are written once, since about ten tables read them. The facts are scanned and
    joined once for all sales tables, which read the written sums by the keys of each. The tables read
    scratch tables of ``store``, so give a request a store of its own: ``with store.request() as own``.
    """
    customers = store.scratch("filtered-customers", filtered_customers(transactions, segmented, choice))
    lines = filtered_sales(transactions, segmented, choice, SALES_KEYS, ["location", "churn_status"])
    summary = store.scratch("sales-summary", reports.sales_summary(lines), partition_by="report")

    def sales(report: str) -> DataFrame:
        return reports.of_report(summary, report)

    return {
        "filter_options": reports.filter_options(transactions, segmented),
        "filtered_transactions": filtered_transactions(transactions, segmented, choice),
        "filtered_customers": customers,
        "kpi_cards": reports.kpi_cards(sales("kpi_cards")),
        "kpi_cards_formatted": reports.kpi_cards_formatted(sales("kpi_cards")),
        "monthly_revenue": reports.monthly_revenue(sales("monthly_revenue")),
        "payment_split": reports.payment_split(sales("payment_split")),
        "age_histogram": histogram(customers, "age", DASHBOARD_BINS),
        "income_histogram": histogram(customers, "annual_income", DASHBOARD_BINS),
        "revenue_by_location": reports.revenue_by_location(sales("revenue_by_location")),
        "category_performance": reports.category_performance(sales("category_performance")),
        "category_table": reports.category_table(sales("category_performance")),
        "top_products": reports.top_products(sales("top_products")),
        "rfm_distribution": reports.rfm_distribution(customers),
        "cluster_scatter": reports.cluster_scatter(customers),
        "cluster_profile": reports.cluster_profile(customers),
        "cluster_profile_formatted": reports.cluster_profile_formatted(customers),
        "satisfaction_distribution": reports.satisfaction_distribution(customers),
        "spend_by_satisfaction": spend_by_satisfaction(customers, store),
        "churn_by_category": reports.churn_by_category(customers),
        "churn_by_location": reports.churn_by_location(customers),
    }
