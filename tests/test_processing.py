"""Hand-computed cleaning and profile cases, from CSV files to the profile table."""

from __future__ import annotations

import csv
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.functions.columns import calendar_columns, season
from shoplens.operators.keep_first import keep_first
from shoplens.plans.pipeline import process_files, segment_files
from shoplens.plans.processing import category_spend, enrich_transactions, preferred_category
from shoplens.sources.readers import read_customers, read_transactions
from shoplens.sources.schemas import CUSTOMERS_RAW, PROFILES, TRANSACTIONS_CLEAN

CUSTOMERS = """customer_id,age,gender,annual_income,location,join_date,satisfaction_score
C1,30,Female,50000,Texas,2023-01-01,5
C2,,Male,,Ohio,2024-03-15,
C3,41.0,Male,60001,Texas,2025-06-30,2
C3,99,Male,1,Ohio,2020-01-01,1
C4,50,Female,70000,Ohio,2025-12-31,4
C5,44,Non-binary,80000,Florida,2024-01-01,1
"""

TRANSACTIONS = """transaction_id,customer_id,transaction_date,product_category,product_name,quantity,price,discount_applied,payment_method
T1,C1,2025-01-10,A,a1,2,10.00,0.10,Cash
T2,C1,2025-07-01 00:00:00,B,b1,1,100.00,0.00,Cash
T2,C1,2025-07-02 00:00:00,B,b1,9,100.00,0.00,Cash
T3,C2,2025-12-31 23:00:00,A,a1,1,10.00,0.50,Card
T4,C2,2025-12-31 00:00:00,B,b1,1,5.00,0.00,Card
T5,C3,2025-07-04 00:00:00,A,a1,1,20.00,0.25,Cash
T6,C5,2025-07-03 23:30:00,C,c1,1,20.00,0.00,Card
"""


@pytest.fixture
def raw_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "customers.csv").write_text(CUSTOMERS)
    (folder / "transactions.csv").write_text(TRANSACTIONS)
    return str(folder)


def test_profiles(spark, store, raw_dir):
    tx, profiles = process_files(spark, raw_dir, store)
    assert tx.count() == 6
    assert profiles.columns == PROFILES.fieldNames()
    columns = [
        "age", "annual_income", "satisfaction_score", "total_spend", "total_transactions",
        "total_items_purchased", "avg_discount_received", "avg_order_value", "preferred_category",
        "recency_days", "tenure_days", "churn_status",
    ]
    found = {r["customer_id"]: tuple(r[c] for c in columns) for r in profiles.collect()}
    assert found == {
        "C1": (30, 50000, 5, 118.0, 2, 3, 0.05, 59.0, "B", 183, 1095, "Churned"),
        "C2": (42, 65000, 3, 10.0, 2, 2, 0.25, 5.0, "A", 0, 656, "Active"),
        "C3": (41, 60001, 2, 15.0, 1, 1, 0.25, 15.0, "A", 180, 184, "Active"),
        "C4": (50, 70000, 4, 0.0, 0, 0, 0.0, 0.0, "None", 1095, 1, "Churned"),
        "C5": (44, 80000, 1, 20.0, 1, 1, 0.0, 20.0, "C", 180, 730, "Active"),
    }
    dates = {r["customer_id"]: (r["first_purchase_date"], r["last_purchase_date"]) for r in profiles.collect()}
    assert dates["C4"] == (None, None)
    assert str(dates["C1"][0]) == "2025-01-10 00:00:00"
    frequency = {r["customer_id"]: r["purchase_frequency_normalized"] for r in profiles.collect()}
    assert frequency["C1"] == pytest.approx(2 / 1095 * 100) and frequency["C4"] == 0.0


def test_first_row_wins_across_files(spark, tmp_path):
    """File order decides, whatever the packing of files and splits into tasks."""
    folder = tmp_path / "many"
    folder.mkdir()
    header = CUSTOMERS.splitlines()[0]
    for part in range(5):
        lines = [f"K{i},{part * 10 + 1},x,1,y,2024-01-01,3" for i in range(200)]
        lines += [f"K{i},{part * 10 + 2},x,1,y,2024-01-01,3" for i in range(200)]
        (folder / f"part-{part}.csv").write_text("\n".join([header, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        raw = read_customers(spark, str(folder))
        assert raw.rdd.getNumPartitions() > 5
        kept = keep_first(raw, ["customer_id"], ["_file", "_block", "_row"])
        assert [r["age"] for r in kept.select("age").distinct().collect()] == [1.0]
        assert kept.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_missing_keys_are_one_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, o int")
    assert sorted(r["o"] for r in keep_first(df, ["k"], ["o"]).collect()) == [1, 3]


def test_malformed_date_fails(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(CUSTOMERS.replace("2024-03-15", "soon"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_customers(spark, str(tmp_path / "customers.csv")).collect()


AWKWARD = [
    # id, date, product, quantity, price, discount
    ("T1", "2025-01-10", 'Lamp 12" red', "2", "10.005", "0.125"),
    ("T2", "2025-01-10 10:00:00.5", "Chair, blue", "2.0", "10.014", "0.004"),
    ("T3", "2025-01-10T10:00:00", " spaced ", "", "", "0"),
    ("T4", "2025-01-10 10:00", "line\nbreak", "1", "99999999.9999", "0.9999"),
]


def _awkward_rows():
    return [(i, "C1", day, "A", product, n, price, discount, "Cash") for i, day, product, n, price, discount in AWKWARD]


@pytest.mark.parametrize("writer", ["csv", "pandas"])
def test_awkward_fields_are_read_as_written(spark, tmp_path, writer):
    path = str(tmp_path / "transactions.csv")
    header = TRANSACTIONS.splitlines()[0].split(",")
    if writer == "csv":
        with open(path, "w", newline="") as out:
            csv.writer(out).writerows([header, *_awkward_rows()])
    else:
        pd.DataFrame(_awkward_rows(), columns=header).to_csv(path, index=False)
    rows = read_transactions(spark, path, multi_line=True).orderBy("transaction_id").collect()
    assert [r["product_name"] for r in rows] == [product for _, _, product, *_ in AWKWARD]
    assert [r["quantity"] for r in rows] == [2, 2, None, 1]
    assert [str(r["transaction_date"]) for r in rows] == [
        "2025-01-10 00:00:00", "2025-01-10 10:00:00.500000", "2025-01-10 10:00:00", "2025-01-10 10:00:00",
    ]
    tx = enrich_transactions(read_transactions(spark, path, multi_line=True)).orderBy("transaction_id").collect()
    assert [r["revenue"] for r in tx] == [Decimal("17.50875000"), Decimal("19.94788800"), None, Decimal("9999.99999999")]


@pytest.mark.parametrize("column, value", [("10.00", "10.00001"), ("0.10", "0.10001"), (",2,", ",2.5,")])
def test_values_that_would_be_rounded_raise(spark, tmp_path, column, value):
    path = tmp_path / "transactions.csv"
    path.write_text(TRANSACTIONS.replace(column, value, 1))
    with pytest.raises(Exception, match="does not fit"):
        read_transactions(spark, str(path)).collect()


def test_join_date_may_have_a_time(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(CUSTOMERS.replace("2024-03-15", "2024-03-15 08:30:00"))
    rows = {r["customer_id"]: str(r["join_date"]) for r in read_customers(spark, str(path)).collect()}
    assert rows["C2"] == "2024-03-15"


def test_missing_input_names_the_step(spark, store, tmp_path):
    with pytest.raises(FileNotFoundError, match="transaction extract"):
        read_transactions(spark, str(tmp_path / "transactions.csv"))
    with pytest.raises(FileNotFoundError, match="process_files"):
        segment_files(store)


def test_nan_becomes_null(spark, store):
    from shoplens.sources.readers import nan_to_null

    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "customer_id string, age double")
    assert nan_to_null(df).where("age IS NULL").count() == 1
    assert CUSTOMERS_RAW["age"].dataType.typeName() == "double"


def test_features(spark, store, raw_dir):
    tx = enrich_transactions(read_transactions(spark, f"{raw_dir}/transactions.csv"))
    assert tx.columns == TRANSACTIONS_CLEAN.fieldNames()
    row = tx.where("transaction_id = 'T1'").first()
    assert (float(row["revenue"]), row["year"], row["month"], row["quarter"]) == (18.0, 2025, 1, 1)
    assert (row["day_of_week"], row["year_month"], row["season"]) == ("Friday", "2025-01", "Winter")


def test_revenue_of_missing_part_is_missing(spark):
    df = spark.sql(
        "SELECT 'T' AS transaction_id, 'C' AS customer_id, timestamp_ntz'2025-01-01' AS transaction_date,"
        " 'A' AS product_category, 'a' AS product_name, CAST(NULL AS int) AS quantity,"
        " CAST(1 AS decimal(14,4)) AS price, CAST(0 AS decimal(5,4)) AS discount_applied, 'x' AS payment_method"
    )
    tx = enrich_transactions(df)
    assert tx.first()["revenue"] is None
    # A sum of nothing is zero, not missing.
    assert float(category_spend(tx).first()["spend"]) == 0.0


def test_seasons(spark):
    months = spark.range(1, 13).select("id", season(F.col("id")).alias("s"))
    by_season = {}
    for row in months.collect():
        by_season.setdefault(row["s"], []).append(row["id"])
    assert by_season == {"Winter": [1, 2, 12], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Autumn": [9, 10, 11]}


def test_calendar_does_not_depend_on_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT timestamp_ntz'2024-12-31 23:30:00' AS t").select(
        *[c.alias(n) for n, c in calendar_columns(F.col("t")).items()]
    )
    expected = (2024, 12, 4, "Tuesday", "2024-12", "Winter")
    try:
        for name in ["UTC", "America/New_York", "Asia/Tokyo"]:
            spark.conf.set("spark.sql.session.timeZone", name)
            assert tuple(df.first()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_preferred_category_ignores_missing_and_breaks_ties(spark):
    tx = spark.sql(
        """SELECT c AS customer_id, cat AS product_category, 't' AS transaction_id, CAST(rev AS decimal(18,4)) AS revenue,
                  1 AS quantity, CAST(0 AS decimal(4,2)) AS discount_applied, timestamp_ntz'2025-01-01' AS transaction_date
           FROM VALUES ('x', 'B', 5), ('x', 'A', 5), ('x', NULL, 9), ('y', 'A', 1), ('y', 'B', 2), (NULL, 'A', 3) AS v(c, cat, rev)"""
    )
    assert {tuple(r) for r in preferred_category(tx).collect()} == {("x", "A"), ("y", "B")}
