"""Connected components of links between long numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoplens.llm.common import written

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; roots are listed as well.

    ``links`` has two long columns a and b. Alternates the large-star and small-star steps of the
    published map-reduce method, each a join on the node and its smallest neighbour, until no edge
    changes. Edges are written after each round; the driver sees a count and a checksum.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
