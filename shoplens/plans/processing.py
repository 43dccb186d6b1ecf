"""Cleaning, transaction features and one behavioural profile per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoplens.functions.columns import (
    DEFAULT_SATISFACTION,
    NEVER_PURCHASED_RECENCY,
    NO_CATEGORY,
    calendar_columns,
    churn_status,
    money_sum,
    net_revenue,
    whole_days,
)
from shoplens.operators.impute import fill_int, median_fills
from shoplens.operators.keep_first import keep_first
from shoplens.sources.readers import INPUT_ORDER
from shoplens.sources.schemas import CUSTOMERS_CLEAN, TRANSACTIONS_CLEAN, TRANSACTIONS_RAW
from shoplens.sources.stages import StageStore


def unique_customers(customers: DataFrame, order: list[str] = INPUT_ORDER) -> DataFrame:
    return keep_first(customers, ["customer_id"], order)


def unique_transactions(transactions: DataFrame, order: list[str] = INPUT_ORDER) -> DataFrame:
    return keep_first(transactions, ["transaction_id"], order).select(TRANSACTIONS_RAW.fieldNames())


def fill_customers(unique: DataFrame, store: StageStore) -> DataFrame:
    """Gaps of unique customers filled: medians for age and income, 3 for satisfaction.

    The medians are looked up first, so pass a written table.
    """
    filled = median_fills(unique, ["age", "annual_income"], store)
    filled["satisfaction_score"] = fill_int("satisfaction_score", DEFAULT_SATISFACTION)
    return unique.select([filled.get(name, F.col(name)) for name in CUSTOMERS_CLEAN.fieldNames()])


def clean_customers(customers: DataFrame, store: StageStore, order: list[str] = INPUT_ORDER) -> DataFrame:
    """One row per customer with gaps filled."""
    return fill_customers(store.scratch("unique-customers", unique_customers(customers, order)), store)


def with_month(transactions: DataFrame) -> DataFrame:
    """The month by which the stage of transactions is partitioned."""
    return transactions.withColumn("year_month", calendar_columns(F.col("transaction_date"))["year_month"])


def derive_features(transactions: DataFrame) -> DataFrame:
    """Transactions that have their month with net revenue and the other calendar features, 16 columns."""
    calendar = calendar_columns(F.col("transaction_date"))
    features = {
        "revenue": net_revenue(F.col("price"), F.col("quantity"), F.col("discount_applied")),
        **{name: column for name, column in calendar.items() if name != "year_month"},
    }
    return transactions.withColumns(features).select(TRANSACTIONS_CLEAN.fieldNames())


def enrich_transactions(transactions: DataFrame) -> DataFrame:
    """Add net revenue and calendar features to unique transactions, 16 columns."""
    return derive_features(with_month(transactions))


def date_bounds(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.min("transaction_date").alias("min_date"), F.max("transaction_date").alias("max_date")
    )


def category_totals(transactions: DataFrame) -> DataFrame:
    """All that a profile needs, added up per customer and category.

    Partial sums leave the map tasks, so a customer with a large share of all rows reaches the
    reducers as one line per task and category.
    """
    return (
        transactions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "product_category")
        .agg(
            money_sum(F.col("revenue")).alias("spend"),
            F.count("transaction_id").alias("orders"),
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("items"),
            F.sum("discount_applied").alias("discounts"),
            F.count("discount_applied").alias("discounts_known"),
            F.max("transaction_date").alias("newest"),
            F.min("transaction_date").alias("oldest"),
        )
    )


def category_spend(transactions: DataFrame) -> DataFrame:
    """Spend per customer and category."""
    return category_totals(transactions).where(F.col("product_category").isNotNull()).select(
        "customer_id", "product_category", "spend"
    )


def _favourite() -> Column:
    """Category of the largest spend, the alphabetically first among equals; ignores no category."""
    ranked = F.when(F.col("product_category").isNotNull(), F.struct(-F.col("spend"), F.col("product_category")))
    return F.min(ranked)["product_category"]


def preferred_category(transactions: DataFrame) -> DataFrame:
    return category_spend(transactions).groupBy("customer_id").agg(_favourite().alias("preferred_category"))


def customer_metrics(transactions: DataFrame) -> DataFrame:
    """Spend, frequency, discount, dates and favourite category of each purchasing customer."""
    return (
        category_totals(transactions)
        .groupBy("customer_id")
        .agg(
            F.sum("spend").cast("double").alias("total_spend"),
            F.sum("orders").alias("total_transactions"),
            F.sum("items").alias("total_items_purchased"),
            F.try_divide(F.sum("discounts").cast("double"), F.sum("discounts_known").cast("double")).alias(
                "avg_discount_received"
            ),
            F.max("newest").alias("last_purchase_date"),
            F.min("oldest").alias("first_purchase_date"),
            F.try_divide(F.sum("spend").cast("double"), F.sum("orders").cast("double")).alias("avg_order_value"),
            _favourite().alias("preferred_category"),
        )
    )


def customer_profiles(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Clean customers with their metrics and derived behaviour, 19 columns.

    Recency and tenure refer to the newest transaction of all, a scalar subquery that reads one
    column; pass a written stage table to keep it from repeating the work behind it.
    """
    newest = date_bounds(transactions).select("max_date").scalar()
    joined = customers.join(customer_metrics(transactions), "customer_id", "left").fillna(
        {
            "total_spend": 0.0,
            "total_transactions": 0,
            "total_items_purchased": 0,
            "avg_discount_received": 0.0,
            "avg_order_value": 0.0,
            "preferred_category": NO_CATEGORY,
        }
    )
    recency = F.coalesce(whole_days(F.col("last_purchase_date"), newest), F.lit(NEVER_PURCHASED_RECENCY))
    tenure = F.greatest(whole_days(F.col("join_date").cast("timestamp_ntz"), newest), F.lit(1))
    return (
        joined.withColumns({"recency_days": recency.cast("bigint"), "tenure_days": tenure.cast("bigint")})
        .withColumn("purchase_frequency_normalized", F.col("total_transactions") / F.col("tenure_days") * 100)
        .withColumn("churn_status", churn_status(F.col("recency_days")))
    )


def clean_and_process(
    customers: DataFrame,
    transactions: DataFrame,
    store: StageStore,
    customer_order: list[str] = INPUT_ORDER,
    transaction_order: list[str] = INPUT_ORDER,
) -> tuple[DataFrame, DataFrame]:
    """Write the stages ``cleaned_transactions`` and ``customer_profiles`` and return both.

    Transactions are partitioned by month, so that date filters read the months they name.
    """
    clean_tx = store.write(
        "cleaned_transactions",
        with_month(unique_transactions(transactions, transaction_order)),
        partition_by="year_month",
        derive=derive_features,
    )
    profiles = store.write(
        "customer_profiles",
        customer_profiles(clean_customers(customers, store, customer_order), clean_tx),
    )
    return clean_tx, profiles
