"""Fixed schemas of the five tables the stages exchange; nothing is inferred on read.

Nullable numeric customer columns are read as DOUBLE, because a CSV writer prints an integer
column that holds gaps as ``42.0``; cleaning turns them into integers.
"""

from __future__ import annotations

from pyspark.sql import types as T

# A product of price, whole quantity and one less discount needs the decimals of both, so revenue is
# exact. 18 digits are the most that Spark keeps in one long number; a value that does not fit raises.
PRICE = T.DecimalType(14, 4)
DISCOUNT = T.DecimalType(5, 4)
MONEY = T.DecimalType(18, 8)


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


CUSTOMERS_RAW = _struct(
    ("customer_id", T.StringType()),
    ("age", T.DoubleType()),
    ("gender", T.StringType()),
    ("annual_income", T.DoubleType()),
    ("location", T.StringType()),
    ("join_date", T.DateType()),
    ("satisfaction_score", T.DoubleType()),
)

TRANSACTIONS_RAW = _struct(
    ("transaction_id", T.StringType()),
    ("customer_id", T.StringType()),
    ("transaction_date", T.TimestampNTZType()),
    ("product_category", T.StringType()),
    ("product_name", T.StringType()),
    ("quantity", T.IntegerType()),
    ("price", PRICE),
    ("discount_applied", DISCOUNT),
    ("payment_method", T.StringType()),
)

TRANSACTIONS_CLEAN = _struct(
    *[(f.name, f.dataType) for f in TRANSACTIONS_RAW],
    ("revenue", MONEY),
    ("year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("quarter", T.IntegerType()),
    ("day_of_week", T.StringType()),
    ("year_month", T.StringType()),
    ("season", T.StringType()),
)

CUSTOMERS_CLEAN = _struct(
    ("customer_id", T.StringType()),
    ("age", T.IntegerType()),
    ("gender", T.StringType()),
    ("annual_income", T.IntegerType()),
    ("location", T.StringType()),
    ("join_date", T.DateType()),
    ("satisfaction_score", T.IntegerType()),
)

PROFILES = _struct(
    *[(f.name, f.dataType) for f in CUSTOMERS_CLEAN],
    ("total_spend", T.DoubleType()),
    ("total_transactions", T.LongType()),
    ("total_items_purchased", T.LongType()),
    ("avg_discount_received", T.DoubleType()),
    ("last_purchase_date", T.TimestampNTZType()),
    ("first_purchase_date", T.TimestampNTZType()),
    ("avg_order_value", T.DoubleType()),
    ("preferred_category", T.StringType()),
    ("recency_days", T.LongType()),
    ("tenure_days", T.LongType()),
    ("purchase_frequency_normalized", T.DoubleType()),
    ("churn_status", T.StringType()),
)

SEGMENTED = _struct(
    *[(f.name, f.dataType) for f in PROFILES],
    ("R_Score", T.IntegerType()),
    ("F_Score", T.IntegerType()),
    ("M_Score", T.IntegerType()),
    ("RFM_Score", T.StringType()),
    ("rfm_segment", T.StringType()),
    ("kmeans_cluster", T.IntegerType()),
    ("cluster_name", T.StringType()),
)


def with_customer_key(schema: T.StructType, key_type: T.DataType) -> T.StructType:
    """The same schema for sources whose ``customer_id`` is not a string."""
    return T.StructType(
        [T.StructField(f.name, key_type if f.name == "customer_id" else f.dataType, True) for f in schema]
    )
