"""Recency-frequency-monetary scores, segments and named clusters."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from shoplens.functions.columns import rfm_code, rfm_segment
from shoplens.operators.clustering import kmeans_clusters, name_clusters, scaled_features
from shoplens.operators.order_stats import rank_bins, value_bins
from shoplens.sources.schemas import SEGMENTED
from shoplens.sources.stages import StageStore


def purchasers(profiles: DataFrame) -> DataFrame:
    return profiles.where("total_transactions > 0")


def rfm_scores(profiles: DataFrame, store: StageStore, strict: bool = False) -> DataFrame:
    """Purchasing customers with scores 1-5, their code and their segment.

    The score edges are looked up first, from three columns of the profiles; scoring itself is
    one projection. Pass written profiles, as the look-ups read them several times.
    """
    active = purchasers(profiles)
    # The three look-ups do not depend on each other, so their jobs may share the executors.
    with ThreadPoolExecutor(3) as pool:
        # Threads take over job group and scheduler pool of the request, so cancelling reaches them.
        inherit = inheritable_thread_target(profiles.sparkSession)
        recency = pool.submit(inherit(partial(value_bins, active, "recency_days", store, strict=strict)))
        frequency = pool.submit(inherit(partial(rank_bins, active, "total_transactions", "customer_id", store)))
        spend = pool.submit(inherit(partial(rank_bins, active, "total_spend", "customer_id", store)))
    scores = {
        # The most recent fifth scores 5.
        "R_Score": F.lit(6) - recency.result(),
        "F_Score": frequency.result(),
        "M_Score": spend.result(),
    }
    r, f, m = F.col("R_Score"), F.col("F_Score"), F.col("M_Score")
    return active.withColumns(scores).withColumns({"RFM_Score": rfm_code(r, f, m), "rfm_segment": rfm_segment(r, f, m)})


def never_purchased(profiles: DataFrame) -> DataFrame:
    """The other customers, with the values that stand for no scores and no cluster."""
    return profiles.where("total_transactions <= 0").withColumns(
        {
            "R_Score": F.lit(0),
            "F_Score": F.lit(0),
            "M_Score": F.lit(0),
            "RFM_Score": F.lit("000"),
            "rfm_segment": F.lit("Inactive"),
            "kmeans_cluster": F.lit(-1),
            "cluster_name": F.lit("Never Purchased"),
        }
    )


def segment(
    profiles: DataFrame,
    store: StageStore,
    assign: Callable[[DataFrame], DataFrame] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Every customer exactly once with scores, segment and cluster, 26 columns.

    ``assign`` adds ``kmeans_cluster`` to rows with scaled features; by default it fits K-Means.
    Scores, features and labels are row-local once their parameters are known, so the profiles
    are neither shuffled nor joined by customer.
    """
    features = scaled_features(rfm_scores(profiles, store, strict))
    clustered = assign(features) if assign else kmeans_clusters(features, store)
    # Four lines at most: one per cluster.
    names = F.broadcast(name_clusters(clustered, store).select("kmeans_cluster", "cluster_name"))
    columns = SEGMENTED.fieldNames()
    active = clustered.join(names, "kmeans_cluster").select(columns)
    return active.unionByName(never_purchased(profiles).select(columns))
