"""The dashboard's filters on dates, categories and locations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, functions as F

from shoplens.functions.columns import money_sum


@dataclass(frozen=True)
class DashboardFilter:
    """Days are inclusive on both ends; ``None`` leaves a dimension unfiltered."""

    start: date | None = None
    end: date | None = None
    categories: Sequence[str] | None = None
    locations: Sequence[str] | None = None


def slice_transactions(transactions: DataFrame, choice: DashboardFilter) -> DataFrame:
    """Transactions of the chosen days and categories.

    The bounds are plain comparisons with the stored timestamp, which reach the scan, and the
    month bounds they imply prune the partitions of the stage table.
    """
    df = transactions
    if choice.start is not None:
        first = datetime.combine(choice.start, time())
        df = df.where(F.col("transaction_date") >= F.lit(first).cast("timestamp_ntz"))
        df = df.where(F.col("year_month") >= choice.start.strftime("%Y-%m"))
    if choice.end is not None:
        after = datetime.combine(choice.end + timedelta(days=1), time())
        df = df.where(F.col("transaction_date") < F.lit(after).cast("timestamp_ntz"))
        df = df.where(F.col("year_month") <= choice.end.strftime("%Y-%m"))
    if choice.categories is not None:
        df = df.where(F.col("product_category").isin(list(choice.categories)))
    return df


def customers_of_locations(customers: DataFrame, choice: DashboardFilter) -> DataFrame:
    if choice.locations is None:
        return customers
    return customers.where(F.col("location").isin(list(choice.locations)))


def filtered_customers(transactions: DataFrame, customers: DataFrame, choice: DashboardFilter) -> DataFrame:
    """Customers of the locations with a transaction in the slice; their lifetime values stay."""
    # Distinct first: each task sends a customer once, however many transactions it has.
    buyers = slice_transactions(transactions, choice).select("customer_id").distinct()
    return customers_of_locations(customers, choice).join(buyers, "customer_id", "left_semi")


def filtered_transactions(transactions: DataFrame, customers: DataFrame, choice: DashboardFilter) -> DataFrame:
    """Transactions of the slice whose customer is among the filtered customers.

    A customer of the locations passes the filter through the very transaction in question, so
    the semi join needs the location list only.
    """
    chosen = customers_of_locations(customers, choice).select("customer_id")
    return slice_transactions(transactions, choice).join(chosen, "customer_id", "left_semi")


def filtered_sales(
    transactions: DataFrame,
    customers: DataFrame,
    choice: DashboardFilter,
    keys: Sequence[str] = (),
    attributes: Sequence[str] = (),
) -> DataFrame:
    """The filtered transactions as narrow sales lines with ``keys`` and customer ``attributes``.

    With keys the lines are joined as they are, in one exchange, since few of them agree in customer
    and keys; adaptive execution splits a hot customer. Without keys the customer is the only key:
    adding up first reduces each customer to one line per task.
    """
    sliced = slice_transactions(transactions, choice)
    chosen = customers_of_locations(customers, choice).select("customer_id", *attributes)
    if keys:
        return sales(sliced, ["customer_id", *keys]).join(chosen, "customer_id")
    sums = sliced.groupBy("customer_id").agg(
        money_sum(F.col("revenue")).alias("revenue"),
        F.count("transaction_id").alias("orders"),
        F.count("*").alias("rows"),
    )
    return sums.join(chosen, "customer_id")


def sales(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Transactions in the shape that :func:`filtered_sales` gives, not added up."""
    return transactions.select(
        *keys,
        F.col("revenue"),
        F.col("transaction_id").isNotNull().cast("bigint").alias("orders"),
        F.lit(1).cast("bigint").alias("rows"),
    )
