"""Retail inputs derived from an order-processing star schema.

Every line of an order is a transaction; ``status`` keeps the orders of one status only. Attributes
that the schema lacks follow from the keys by a rule, with gaps, so that every cleaning step has work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shoplens.operators.keep_first import keep_first
from shoplens.sources.readers import exact
from shoplens.sources.schemas import DISCOUNT, PRICE, TRANSACTIONS_RAW

TABLES = ["customer", "nation", "lineitem", "orders", "part"]
# Order of the copies of one transaction.
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LINE_KEY = ["l_orderkey", "l_linenumber"]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Raw customers, 7 columns."""
    key = F.col("c_custkey")
    return (
        _table(spark, folder, "customer")
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("customer_id"),
            F.when(key % 19 != 0, 18 + key % 63).cast("double").alias("age"),
            F.col("c_mktsegment").alias("gender"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("annual_income"),
            F.col("n_name").alias("location"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 2500).cast("int")).alias("join_date"),
            F.when(key % 17 != 0, 1 + key % 5).cast("double").alias("satisfaction_score"),
        )
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").select(*LINE_KEY, *LINE_ORDER, "l_quantity", "l_discount")


def _as_transactions(spark: SparkSession, folder: str, lines: DataFrame, status: str | None) -> DataFrame:
    orders = _table(spark, folder, "orders")
    if status is not None:
        orders = orders.where(F.col("o_orderstatus") == status)
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            *LINE_KEY,
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("transaction_date"),
            F.col("p_type").alias("product_category"),
            F.col("p_name").alias("product_name"),
            exact("l_quantity", T.IntegerType()).alias("quantity"),
            exact("p_retailprice", PRICE).alias("price"),
            exact("l_discount", DISCOUNT).alias("discount_applied"),
            F.col("o_orderpriority").alias("payment_method"),
        )
    )


def transactions(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Raw transactions, 9 columns, with their copies."""
    return with_ids(_as_transactions(spark, folder, _lines(spark, folder), status))


def with_ids(lines: DataFrame) -> DataFrame:
    """Transactions with the text that identifies each in place of the key of its line."""
    rest = [c for c in lines.columns if c not in LINE_KEY]
    return lines.select(F.format_string("%d-%d", *LINE_KEY).alias("transaction_id"), *rest)


def unique_lines(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Raw transactions without copies, with the key of their line instead of ``transaction_id``.

    The key of a transaction is the key of its line, so copies go before the look-ups of order
    and product: two integers are compared instead of a text, and less is joined.
    """
    lines = keep_first(_lines(spark, folder), LINE_KEY, LINE_ORDER)
    return _as_transactions(spark, folder, lines, status)


def unique_transactions(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Raw transactions without copies."""
    return with_ids(unique_lines(spark, folder, status)).select(TRANSACTIONS_RAW.fieldNames())
