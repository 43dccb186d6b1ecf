"""SimHash near-duplicates through an index of positional bytes.

A fingerprint of 64 bits has a byte in each of 8 positions. Two fingerprints at most ``distance`` bits
apart differ in at most that many bytes, so they are guaranteed to share 8 - ``distance`` positional
bytes. Positions go in four couples, of which such a pair shares 4 - ``distance`` whole ones, and the index
lists fingerprints by every choice of that many couples with their bytes. In a list the positional bytes that
two members share are tallied; pairs that reach the guaranteed count have their bits verified. A list that is
long is cut into lists of one more choice of positions each, so that meeting there is reaching the count; their
members differ in at most two bytes, so they have at most 65,536. A list yields the links of a spanning forest,
not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.llm.common import fresh, raw_texts, text_of, written
from shoplens.llm.components import component_roots

SHINGLE = 3
DISTANCE = 2
SEED = 42
POSITIONS = 8
SHINGLES_AT_ONCE = 1 << 16
COUPLES = 4
# Longer lists are cut by further positions.
SMALL_LIST = 256


def fingerprint_of(raw: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for first in range(0, len(stops), SHINGLES_AT_ONCE):
        part = stops[first : first + SHINGLES_AT_ONCE]
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[first:], part)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def _fingerprints(shingle: int):
    @F.arrow_udf("bigint")
    def fingerprints(text: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(raw, shingle) for raw in raw_texts(text)], np.uint64)
        return pa.array(found.view(np.int64))

    return fingerprints


def with_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    return docs.withColumn(name, _fingerprints(shingle)(F.col(text).cast("string")))


def _settled(labels: np.ndarray, step) -> np.ndarray:
    while True:
        lower = step(labels)
        if np.array_equal(lower, labels):
            return labels
        labels = lower


def linked_within(members: np.ndarray, distance: int, free: int) -> np.ndarray:
    """For each fingerprint of one list the place of the first member it reaches over links of that list.

    ``free`` has the bits in which members may differ. A short list tallies the shared positional bytes of its
    pairs and verifies the bits of those that reach the guaranteed count; a long one, with at most two bytes
    free, looks each member's neighbours up in a table of all values of the free bits.
    """
    size = len(members)
    if size <= SMALL_LIST:
        tally = np.zeros((size, size), np.uint8)
        for position in np.ascontiguousarray(members).view(np.uint8).reshape(size, POSITIONS).T:
            tally += position[:, None] == position[None, :]
        near = tally >= POSITIONS - distance
        near[near] = np.bitwise_count((members[:, None] ^ members[None, :])[near]) <= distance
        return _settled(np.arange(size), lambda labels: np.where(near, labels[None, :], size).min(axis=1))
    bits = [bit for bit in range(64) if free >> bit & 1]
    place = np.zeros(size, np.int64)
    for order, bit in enumerate(bits):
        place |= ((members >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << order
    table = np.full(1 << len(bits), size, np.int64)
    table[place] = np.arange(size)
    flips = [sum(1 << b for b in some) for n in range(1, distance + 1) for some in combinations(range(len(bits)), n)]

    def step(labels: np.ndarray) -> np.ndarray:
        known = np.append(labels, size)
        lower = labels.copy()
        for flip in flips:
            np.minimum(lower, known[table[place ^ flip]], out=lower)
        return np.minimum(lower, lower[lower])

    return _settled(np.arange(size), step)


def _bits(positions: Iterable[int]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _choice(number: int, free: int) -> Column:
    """A list's number and the mask of the bits that its members share, as a signed long."""
    mask = free ^ ((1 << 64) - 1)
    return F.struct(F.lit(number).alias("choice"), F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint").alias("mask"))


def _by_choice(choices: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[_choice(number, free) for number, free in choices])).alias("m")


def near_links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between the distinct longs of ``fingerprint`` that connect all pairs within ``distance`` bits."""
    if not 1 <= distance <= 2:
        raise ValueError("lists stay short for a distance of 1 or 2 bits only")
    couples = [(2 * c, 2 * c + 1) for c in range(COUPLES)]
    # Free positions of each list, and of each list that a long one is cut into.
    lists = [tuple(p for couple in some for p in couple) for some in combinations(couples, distance)]
    index = fingerprints.select("fingerprint", _by_choice([(i, _bits(open_)) for i, open_ in enumerate(lists)]))
    index = index.select("fingerprint", "m.choice", F.col("fingerprint").bitwiseAND(F.col("m.mask")).alias("shared"))
    sizes = written(index.groupBy("choice", "shared").agg(F.count("*").alias("size")).where("size > 1"), "list-sizes")
    index = written(index.join(sizes, ["choice", "shared"]), "lists")
    short = index.where(F.col("size") <= SMALL_LIST).select("choice", "shared", "fingerprint")
    cuts, left_out = [], [_bits(open_) for open_ in lists]
    for i, open_ in enumerate(lists):
        parts = list(combinations(open_, distance))
        cuts.append(F.array(*[_choice(len(left_out) + j, _bits(part)) for j, part in enumerate(parts)]))
        left_out += [_bits(part) for part in parts]
    cut = F.element_at(F.array(*cuts), F.col("choice") + 1)
    long = index.where(F.col("size") > SMALL_LIST).select("fingerprint", F.explode(cut).alias("m"))
    long = long.select("m.choice", F.col("fingerprint").bitwiseAND(F.col("m.mask")).alias("shared"), "fingerprint")
    lists = short.unionByName(long).groupBy("choice", "shared").agg(F.collect_list("fingerprint").alias("members")).where("size(members) > 1")

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for choice, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.sort(members.values.to_numpy().view(np.uint64))
                first = linked_within(values, distance, left_out[choice])
                linked = np.flatnonzero(first != np.arange(len(values)))
                a.append(values[linked])
                b.append(values[first[linked]])
            if a:
                pairs = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    return lists.select("choice", "members").mapInArrow(verified, "a long, b long").distinct()


def near_components(narrow: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint, root, component_id): the smallest id that each fingerprint of (doc_id, fingerprint) reaches.

    Null ids take no part in the smallest. The root is a fingerprint of the component; it tells components
    apart that have no id, or whose smallest id is the same.
    """
    distinct = written(narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = component_roots(near_links(distinct, distance))
    members = written(distinct.join(roots, distinct["fingerprint"] == roots["node"]).drop("node"), "members")
    components = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = members.join(components, "root").select("fingerprint", "root", "component_id")
    return distinct.join(linked.withColumnRenamed("component_id", "_c"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("_c", "first_id").alias("component_id")
    )


def simhash_components(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Fingerprint and component of every document.

    Null texts count as empty: fingerprint zero, linked like any other. Every row gives one row, also repeated
    ones; an empty table gives none. Equal texts collapse to one
    fingerprint before any index is built, so groups of copies cost nothing further.
    """
    narrow = with_fingerprint(documents.select("doc_id", "text"), "fingerprint", shingle).select("doc_id", "fingerprint")
    narrow = written(narrow, "simhash")
    components = written(near_components(narrow, distance).drop("root"), "components")
    return narrow.join(components, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the smallest id. Columns stay as they are.

    Of a component's rows that repeat that id the one of smallest text hash stays, then of smallest hash of
    all columns. Each component without any id keeps one row too. An empty table stays empty.

    Fingerprints are made once: they are written beside the documents, and both the index and the choice
    read them there.
    """
    mark, key, root, component = (fresh(docs, n) for n in ("_fingerprint", "_key", "_root", "_component"))
    marked = written(with_fingerprint(docs, mark, shingle, text), "marked")
    narrow = marked.select(F.col(doc_id).alias("doc_id"), F.col(mark).alias("fingerprint"))
    found = written(near_components(narrow, distance), "components").select(
        F.col("fingerprint").alias(key), F.col("root").alias(root), F.col("component_id").alias(component)
    )
    columns = docs.columns

    def bearers(rows: DataFrame, print_: str, own: str) -> DataFrame:
        return rows.join(found, F.col(print_) == F.col(key)).where(F.col(own).eqNullSafe(F.col(component)))

    times = bearers(narrow, "fingerprint", "doc_id").groupBy(root).agg(F.count("*").alias("n"))
    repeated = written(times.where("n > 1").select(root), "repeated")
    first = bearers(marked, mark, doc_id)
    if repeated.isEmpty():
        return first.select(columns)
    hashes = [F.sha2(text_of(text), 256), F.xxhash64(*columns)]
    nth = fresh(docs, "_nth")
    # A group limit of one row comes before the exchange, so copies leave their task as one row.
    order = Window.partitionBy(root).orderBy(*hashes)
    return first.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(columns)
