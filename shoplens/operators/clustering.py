"""Log-scaled, standardised features and four clusters named by their median spend."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from random import Random

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.operators.order_stats import grouped_quantiles
from shoplens.sources.stages import StageStore

# Fixed values of the cluster model. Names go from the highest median spend to the lowest.
FEATURES = ["recency_days", "total_transactions", "total_spend"]
SCALED = [f"{name}_scaled" for name in FEATURES]
EPSILON = 0.001
CLUSTER_NAMES = ["VIP Spenders", "Active Customers", "Slipping Customers", "Lost Customers"]
STARTS = 10
SEED = 42
MAX_ITERATIONS = 300
# Customers that the starts begin from.
SEEDING_ROWS = 4_096
# Stopping rule on unit-variance features: the squared shifts of all centres add up to 1e-4 at
# most, of which each centre gets its share.
CENTRE_SHIFT = (1e-4 / len(CLUSTER_NAMES)) ** 0.5


def scaled_features(active: DataFrame) -> DataFrame:
    """Add ``ln(1 + x + 0.001)`` of each feature, brought to mean 0 and variance 1.

    Means and population deviations of the three logs come from one pass over three columns.
    """
    log = {x: F.log1p(F.col(x) + EPSILON) for x in FEATURES}
    moments = active.agg(
        *[F.avg(log[x]).alias(f"{x}_mean") for x in FEATURES],
        *[F.stddev_pop(log[x]).alias(f"{x}_dev") for x in FEATURES],
    ).first()

    def scale(x: str) -> Column:
        # A constant column has no spread to divide by.
        return (log[x] - F.lit(moments[f"{x}_mean"])) / F.lit(moments[f"{x}_dev"] or 1.0)

    return active.withColumns({f"{x}_scaled": scale(x) for x in FEATURES})


@dataclass(frozen=True)
class Clusters:
    """Centres of the scaled features, and the sum of all squared distances to the nearest of them."""

    centres: list[tuple[float, ...]]
    cost: float


def _square(point: Sequence[float], centre: Sequence[float]) -> float:
    return sum((a - b) ** 2 for a, b in zip(point, centre))


def first_centres(points: list[tuple[float, ...]], k: int, seed: int) -> list[tuple[float, ...]]:
    """k of the points, each drawn with a probability that grows with its squared distance to those before."""
    rng = Random(seed)
    centres = [rng.choice(points)]
    nearest = [_square(p, centres[0]) for p in points]
    while len(centres) < k:
        # All points at their centres: any will do.
        weights = nearest if sum(nearest) > 0 else None
        centres.append(rng.choices(points, weights)[0])
        nearest = [min(d, _square(p, centres[-1])) for d, p in zip(nearest, points)]
    return centres


def settled(points: list[tuple[float, ...]], centres: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
    """``centres`` moved to the means of their nearest points until they rest: where a start begins on all rows."""
    x, own = np.array(points), np.array(centres)
    for _ in range(MAX_ITERATIONS):
        label = ((x[:, None, :] - own) ** 2).sum(2).argmin(1)
        moved = np.array([x[label == k].mean(0) if (label == k).any() else own[k] for k in range(len(own))])
        rests = (((moved - own) ** 2).sum(1) <= CENTRE_SHIFT**2).all()
        own = moved
        if rests:
            break
    return [tuple(c) for c in own.tolist()]


def lloyd_step(points: DataFrame, centres: list[list[tuple[float, ...]]], moving: set[int]) -> DataFrame:
    """Per start and cluster: members, sums of the features and cost, for those of the starts that move.

    One scan and one aggregate whatever the number of starts: each task sends a line per start and cluster.
    The centres of the moving starts are one array value, over which a row is exploded, so every iteration runs
    the same generated code. Expressions are text, since a call per operator would outlast the scan.
    """
    size = len(SCALED)

    def array(numbers: Iterable[float]) -> str:
        return f"array({', '.join(f'{float(x)!r}D' for x in numbers)})"

    given = ", ".join(f"named_struct('start', {s}, 'c', {array(v for own in centres[s] for v in own)})" for s in sorted(moving))
    distances = []
    for k in range(len(centres[0])):
        squares = [f"({x} - at.c[{k * size + i}]) * ({x} - at.c[{k * size + i}])" for i, x in enumerate(SCALED)]
        distances.append(f"named_struct('d', {' + '.join(squares)}, 'i', {k})")
    sums = [f"sum({x}) AS {x}" for x in SCALED]
    return (
        points.selectExpr(*SCALED, f"explode(array({given})) AS at")
        .selectExpr(*SCALED, "at.start AS start", f"array_min(array({', '.join(distances)})) AS near")
        .groupBy("start", F.col("near.i").alias("cluster"))
        .agg(*[F.expr(e) for e in ["count(*) AS n", *sums, "sum(near.d) AS cost"]])
    )


def fit_best_of(points: DataFrame, sample: list[tuple[float, ...]], k: int, starts: int, seed: int) -> Clusters:
    """The clusters of lowest cost among ``starts`` seeds, the smallest seed among equals.

    Each start begins where its centres rest on the sample, which saves passes over all rows. All starts move together: an iteration is one aggregate over ``points`` for the starts whose centres
    still move. A cluster without members stays where it is.
    """
    centres = [settled(sample, first_centres(sample, k, seed + s)) for s in range(starts)]
    moving = set(range(starts))
    for _ in range(MAX_ITERATIONS):
        if not moving:
            break
        moved = [list(own) for own in centres]
        for row in lloyd_step(points, centres, moving).collect():
            moved[row["start"]][row["cluster"]] = tuple(row[x] / row["n"] for x in SCALED)
        still = {s for s in moving if any(_square(a, b) > CENTRE_SHIFT**2 for a, b in zip(centres[s], moved[s]))}
        centres, moving = moved, still
    found = lloyd_step(points, centres, set(range(starts))).groupBy("start").agg(F.sum("cost").alias("cost"))
    costs = {r["start"]: r["cost"] for r in found.collect()}
    best = min(range(starts), key=lambda s: (costs[s], s))
    return Clusters(centres[best], costs[best])


def fit_clusters(features: DataFrame, store: StageStore, starts: int = STARTS, seed: int = SEED) -> Clusters:
    """The best of ``starts`` fits of four clusters to the scaled features.

    Starts begin from at most :data:`SEEDING_ROWS` customers, those of smallest id hash; from there on every
    iteration, and the cost, takes all customers.
    """
    k = len(CLUSTER_NAMES)
    # Written once, three numbers per customer: what the iterations read, whatever tasks are lost.
    staged = store.scratch("features", features.select(F.xxhash64("customer_id").alias("_draw"), *SCALED))
    customers = staged.count()
    if customers < k:
        raise ValueError(f"{k} clusters need at least {k} purchasing customers, found {customers}")
    sample = staged.orderBy("_draw", *SCALED).limit(SEEDING_ROWS).select(SCALED).collect()
    return fit_best_of(staged.select(SCALED), [tuple(r) for r in sample], k, starts, seed)


def labelled(features: DataFrame, clusters: Clusters) -> DataFrame:
    """Add ``kmeans_cluster``; ids are arbitrary, only :func:`name_clusters` orders them.

    Labelling is row-local, so every other column of ``features`` passes through without a join.
    """
    return nearest_centre(features, clusters.centres)


def kmeans_clusters(features: DataFrame, store: StageStore, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    return labelled(features, fit_clusters(features, store, starts, seed))


def nearest_centre(features: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Features with ``kmeans_cluster``, the index of the closest of the given centres."""
    distances = []
    for index, centre in enumerate(centres):
        squares = [(F.col(x) - F.lit(float(c))) * (F.col(x) - F.lit(float(c))) for x, c in zip(SCALED, centre)]
        distances.append(F.struct((squares[0] + squares[1] + squares[2]).alias("d"), F.lit(index).alias("i")))
    return features.withColumn("kmeans_cluster", F.array_min(F.array(*distances))["i"])


def _named(medians: DataFrame) -> DataFrame:
    """Clusters with ``spend_rank`` and ``cluster_name``: one line per cluster, four at most."""
    names = F.array(*[F.lit(name) for name in CLUSTER_NAMES])
    by_spend = Window.orderBy(F.desc("median_spend"), "kmeans_cluster")
    return medians.withColumn("spend_rank", F.row_number().over(by_spend)).withColumn(
        "cluster_name", F.element_at(names, F.col("spend_rank"))
    )


def name_clusters(clustered: DataFrame, store: StageStore) -> DataFrame:
    """Median spend, ``spend_rank`` and ``cluster_name``: one line per cluster, four at most."""
    medians = grouped_quantiles(clustered, ["kmeans_cluster"], ["total_spend"], [0.5], store)
    return _named(medians.select("kmeans_cluster", F.col("total_spend")[0].alias("median_spend")))


def cluster_medians(clustered: DataFrame, store: StageStore) -> DataFrame:
    """Named clusters with the medians of all three raw features, from one pass, one line per cluster."""
    medians = grouped_quantiles(clustered, ["kmeans_cluster"], ["total_spend", "recency_days", "total_transactions"], [0.5], store)
    return _named(
        medians.select(
            "kmeans_cluster",
            F.get("total_spend", F.lit(0)).alias("median_spend"),
            F.get("recency_days", F.lit(0)).alias("median_recency"),
            F.get("total_transactions", F.lit(0)).alias("median_frequency"),
        )
    )
