"""Hash tree and web archives."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shoplens.llm.oracles import ORACLES
from shoplens.llm.sharding import Node, hash_tree_shards, shard_documents, shard_of, topology, with_region
from shoplens.llm.warc import coalesced, parse_record, read_records, record_bytes, warc_round_trip, write_archives
from tests.llm.conftest import AWKWARD, equals_sql, frame


def test_shards_are_gapless_and_grow_into_the_new_one(spark, nothing):
    rows = AWKWARD + [(1000 + i, f"text {i}", "en", "src0") for i in range(3000)]
    placed = hash_tree_shards(frame(spark, rows)).collect()
    texts = sorted([(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows], key=str)
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in placed], key=str) == texts
    shards = Counter(r["shard"] for r in placed)
    assert set(shards) == set(range(16)) and max(shards.values()) < 2 * min(shards.values())
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(n))
        ids = [r["doc_id"] for r in sorted(placed, key=lambda r: r["slot"]) if r["shard"] == shard and r["doc_id"] is not None]
        assert ids == sorted(ids)
    moved = [r for r in placed if r["shard"] != r["grown_shard"]]
    assert 0 < len(moved) < len(rows) / 10 and {r["grown_shard"] for r in moved} == {16}
    by_id = {}
    assert all(by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"] for r in placed)
    assert hash_tree_shards(nothing).count() == 0


def test_slots_over_many_partitions(spark):
    """One shard that holds nearly all rows is numbered over several partitions."""
    heavy = Node("root", children=(Node("a", children=(Node("s0", 1e6, shard=0), Node("s1", 1.0, shard=1))),))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = shard_documents(frame(spark, [(i, "x", "en", "s") for i in range(500)]), heavy, heavy).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["slot"] for r in sorted(placed, key=lambda r: r["doc_id"]) if r["shard"] == 0] == list(range(sum(r["shard"] == 0 for r in placed)))


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    tree = topology()

    def reweighted(node, name, weight):
        if not node.children:
            return replace(node, own_weight=weight) if node.name == name else node
        return replace(node, children=tuple(reweighted(c, name, weight) for c in node.children))

    heavier = reweighted(tree, "shard1", 3.0)
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    rows = ids.select(shard_of(F.col("k"), tree).alias("a"), shard_of(F.col("k"), heavier).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved
    # Into the region of shard 1, or into its rack, or into it; never between other regions or racks.
    for a, b in moved:
        assert b // 8 == 0 and (a // 8 == 1 or b // 4 == 0) and (a // 4 != 0 or b == 1)
    weights = Counter(r["b"] for r in rows)
    assert 1.8 < weights[1] / (sum(weights[s] for s in (0, 2, 3)) / 3) < 4.5


def test_a_new_region_takes_its_share(spark):
    tree = topology(4, 1, 2)
    grown = with_region(tree, "new", 4, weight=4.0)
    ids = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    rows = ids.select(shard_of(F.col("k"), tree).alias("a"), shard_of(F.col("k"), grown).alias("b")).collect()
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {4}
    assert abs(sum(r["b"] == 4 for r in rows) / len(rows) - 0.5) < 0.05


PAGES = "page_id long, url string, html string, payload string, digest int"
BIG = "<html>" + "é" * 600 + "</html>"
ROWS = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (7, "http://a/7\nnew line 100%0A", BIG),
    (7, "http://a/7b", BIG),
    (3, "http://a/3", "small"),
    (4, "http://a/4", "small"),
    (5, None, None),
    (6, "http://a/6", ""),
    (None, "http://a/none", BIG),
    (8, "http://a/8", "y" * 300_000),
    (9, "http://a/9", "\r\n\r\nWARC/1.1\r\n\r\n" * 100),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], PAGES).repartition(2)


def expected():
    found = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        latest = max((j for j, _, h in ROWS if h == html and j is not None), default=None)
        revisit = len(raw) >= 1000 and i != latest
        found.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", latest if revisit else None))
    return sorted(found, key=str)


def test_round_trip(pages, tmp_path):
    assert sorted(map(tuple, warc_round_trip(pages, str(tmp_path / "a")).collect()), key=str) == expected()
    assert warc_round_trip(pages.where("false"), str(tmp_path / "b")).count() == 0


def test_round_trip_equals_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    equals_sql(warc_round_trip(spark.read.parquet(f"{folder}/pages.parquet"), str(tmp_path)), ORACLES["op6_warc"], pages=folder)


def test_chosen_records_are_read_with_their_payload(pages, tmp_path):
    folder = str(tmp_path / "warc")
    index = write_archives(pages, folder)
    assert index.count() == len(ROWS)
    chosen = read_records(index.where("page_id in (7, 8, 1)"), folder).collect()
    found = sorted((r["page_id"], r["url"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in chosen)
    assert [x[:2] for x in found] == [(1, "http://a/1"), (7, ROWS[2][1]), (7, "http://a/7b"), (8, "http://a/8")]
    assert found[0][2] is None and found[3][2] == "y" * 300_000


def test_byte_ranges():
    places = [("f", 0, 10), ("f", 10, 10), ("f", 25, 5), ("f", 1000, 5), ("f", 1005, 90), ("f", 1095, 20), ("g", 0, 500)]
    groups = list(coalesced(places, most=100, gap=8))
    assert groups == [places[:3], places[3:5], places[5:6], places[6:]]


def test_damage_is_noticed():
    whole = b"payload"
    record = record_bytes("1", "http://x", whole, hashlib.sha1(whole).hexdigest(), None, False)
    assert parse_record(record)["payload"] == whole
    other = record_bytes("1", "http://x", b"changed", hashlib.sha1(whole).hexdigest(), None, False)
    with pytest.raises(ValueError, match="damaged"):
        parse_record(other)
