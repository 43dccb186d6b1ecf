"""Shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards. At each level a document draws a number per child from its
key and the child's name, and takes the child whose draw, scaled by weight, comes first. A draw
depends on no sibling, so a changed weight moves documents only into or out of its own subtrees.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.llm.common import text_of, written

SHARDS = 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is the number of a leaf."""

    name: str
    own_weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def leaves(self) -> list[Node]:
        return [leaf for c in self.children for leaf in c.leaves()] if self.children else [self]


def topology(shards: int = SHARDS, racks_per_region: int = 2, shards_per_rack: int = 4) -> Node:
    """``shards`` equal shards, filled rack by rack and region by region."""
    racks = [
        Node(f"rack{start}", children=tuple(Node(f"shard{s}", shard=s) for s in range(start, min(start + shards_per_rack, shards))))
        for start in range(0, shards, shards_per_rack)
    ]
    regions = [
        Node(f"region{start}", children=tuple(racks[start : start + racks_per_region]))
        for start in range(0, len(racks), racks_per_region)
    ]
    return Node("root", children=tuple(regions))


def with_region(tree: Node, name: str, shard: int, weight: float = 1.0) -> Node:
    """``tree`` with one more shard in a region of its own.

    No other subtree's weight changes, so the new shard takes documents and nothing else moves. A
    shard added inside a region would also move documents between the shards of that region.
    """
    leaf = Node(f"shard{shard}", weight, shard=shard)
    return Node(tree.name, children=(*tree.children, Node(name, children=(Node(f"{name}-rack", children=(leaf,)),))))


def _arrival(key: Column, node: Node) -> Column:
    """Time of the first arrival of a process whose rate is the node's weight; the earliest child wins."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11)
    uniform = (draw.cast("double") + 0.5) / float(1 << 53)
    return -F.log(uniform) / F.lit(node.weight)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard that ``key`` descends to. A null key descends like any other value."""
    open_children = [c for c in tree.children if c.weight > 0]
    if not tree.children:
        return F.lit(tree.shard)
    if len(open_children) == 1:
        return shard_of(key, open_children[0])
    first = F.least(*[_arrival(key, c) for c in open_children])
    below = None
    for child in open_children:
        here, inside = _arrival(key, child) == first, shard_of(key, child)
        below = F.when(here, inside) if below is None else below.when(here, inside)
    return below


def shard_documents(docs: DataFrame, tree: Node, grown: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size, checksum and shard of each row of ``docs``, numbered without gaps inside each shard.

    Numbers follow the id (null first) and then the checksum. Rows are sorted by range over shard and
    id, numbered inside each partition and shifted by the counts of the partitions before, so no shard
    has to fit a task; one count per partition and shard is all that is added up across partitions.
    """
    whole = text_of(text)
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        shard_of(F.col("doc_id").cast("string"), tree).alias("shard"),
        shard_of(F.col("doc_id").cast("string"), grown).alias("grown_shard"),
    )
    order = ["shard", "doc_id", "text_crc32", "size"]
    ranged = written(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id()),
        "shards",
    )
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranged.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("before") + F.col("row") - F.col("first")).alias("slot")
    )


def hash_tree_shards(documents: DataFrame) -> DataFrame:
    """Sixteen shards by key, and the shard of each document if a seventeenth is added.

    Null texts have size 1 and the checksum of nothing. Repeated ids go to one shard; an empty table gives no rows.
    """
    tree = topology()
    placed = shard_documents(documents.select("doc_id", "text"), tree, with_region(tree, "region-grown", SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
