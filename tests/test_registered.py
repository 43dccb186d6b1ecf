"""Registered queries against their SQL, and invariants of the fitted clusters."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from __spark_entry__ import _QUERIES, COMPLETED, entry, queries, workspace
from check import TABLES, rows_of
from shoplens_oracle import ORACLES
from shoplens.operators.clustering import (
    CLUSTER_NAMES,
    SCALED,
    kmeans_clusters,
    scaled_features,
)
from shoplens.plans.segmentation import purchasers
from shoplens.sources.schemas import SEGMENTED

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_only_fitted_clusters_lack_sql():
    assert set(_QUERIES) - set(ORACLES) == {"kmeans_clusters", "segmented_customers"}


def test_entry(spark):
    assert entry(spark).count() > 0


def test_fitted_segments(spark):
    w = workspace(spark, FOLDER, COMPLETED)
    segmented = w.segmented()
    assert segmented.columns == SEGMENTED.fieldNames()
    pdf = segmented.toPandas()
    assert sorted(pdf["customer_id"]) == sorted(r["customer_id"] for r in w.customers().collect())
    never = pdf[pdf["total_transactions"] == 0]
    assert set(never["cluster_name"]) == {"Never Purchased"} and set(never["RFM_Score"]) == {"000"}
    active = pdf[pdf["total_transactions"] > 0]
    medians = active.groupby("cluster_name")["total_spend"].median().sort_values(ascending=False)
    assert medians.index.tolist() == CLUSTER_NAMES
    assert active.groupby("cluster_name")["kmeans_cluster"].nunique().tolist() == [1] * 4


def test_fit_is_near_its_best_and_rows_at_their_nearest_centre(spark, store):
    w = workspace(spark, "/root/testdata/sf0.01")
    features = scaled_features(purchasers(w.profiles()))
    pdf = kmeans_clusters(features, store).toPandas()
    x = pdf[SCALED].to_numpy()
    labels = pdf["kmeans_cluster"].to_numpy()
    assert sorted(set(labels)) == [0, 1, 2, 3]
    centres = np.array([x[labels == k].mean(0) for k in range(4)])
    distances = ((x[:, None, :] - centres) ** 2).sum(2)
    # The stopping rule lets centres move by a hair after the last labelling.
    assert (distances.argmin(1) == labels).mean() > 0.99
    cost = distances.min(1).sum()
    best = min(_lloyd(x, seed) for seed in range(10))
    assert cost <= best * 1.01


def _lloyd(x, seed):
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), 4, replace=False)]
    for _ in range(300):
        labels = ((x[:, None, :] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([x[labels == k].mean(0) if (labels == k).any() else centres[k] for k in range(4)])
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return ((x[:, None, :] - centres) ** 2).sum(2).min(1).sum()


def test_fit_repeats(spark, store):
    features = scaled_features(purchasers(workspace(spark, FOLDER).profiles()))
    first = kmeans_clusters(features, store, starts=2).select("customer_id", "kmeans_cluster").collect()
    again = kmeans_clusters(features, store, starts=2).select("customer_id", "kmeans_cluster").collect()
    assert sorted(first) == sorted(again)


def test_too_few_customers(spark, store):
    three = workspace(spark, FOLDER).profiles().where("total_transactions > 0").limit(3)
    with pytest.raises(ValueError, match="found 3"):
        kmeans_clusters(scaled_features(three), store)


def test_revenues_add_up(spark):
    total = queries()["kpi_cards"](spark, FOLDER).first()["total_revenue"]
    for name in ["monthly_revenue", "revenue_by_season", "payment_split", "revenue_by_location", "category_performance"]:
        assert sum(r["revenue"] for r in queries()[name](spark, FOLDER).collect()) == pytest.approx(total)
