"""Exact duplicates by counting quotient filters.

Every partition counts the fingerprints of its texts in a counting quotient filter; filters merge
without loss, since each is a sorted list of remainders per quotient. Texts whose fingerprint may
have a count above one are compared byte by byte; no other text leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shoplens.llm.common import text_of, written

# A filter is cut into blocks by the first bits of its quotients; so many fingerprints to a block on average.
BLOCK_ENTRIES = 1 << 16
SLOTS_PER_BLOCK_BITS = 16
# Bits of the table that routes texts to comparison; its size does not grow with the data.
ROUTE_BITS = 25


@dataclass(frozen=True)
class QuotientFilter:
    """Exact counts of 64-bit fingerprints: per occupied quotient a run of sorted remainders, a count beside each."""

    quotient_bits: int
    quotients: np.ndarray
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None) -> QuotientFilter:
        """The filter of a multiset; ``counts`` are multiplicities of the fingerprints, one each if not given."""
        if counts is None:
            entries, total = np.unique(fingerprints, return_counts=True)
        else:
            entries, place = np.unique(fingerprints, return_inverse=True)
            total = np.zeros(len(entries), np.int64)
            np.add.at(total, place, counts)
        shift = np.uint64(64 - quotient_bits)
        quotients, runs = np.unique(entries >> shift, return_counts=True)
        remainders = entries & ((np.uint64(1) << shift) - np.uint64(1))
        return cls(quotient_bits, quotients, runs.astype(np.int64), remainders, total.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.runs) << np.uint64(64 - self.quotient_bits)) | self.remainders

    def merged(self, *others: QuotientFilter) -> QuotientFilter:
        parts = (self, *others)
        return QuotientFilter.of(
            np.concatenate([p.fingerprints() for p in parts]), self.quotient_bits, np.concatenate([p.counts for p in parts])
        )

    def blocks(self, quotients_per_block: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter cut into its occupied blocks."""
        ends = np.concatenate([[0], np.cumsum(self.runs)])
        numbers, firsts = np.unique(self.quotients // np.uint64(quotients_per_block), return_index=True)
        for number, lo, hi in zip(numbers.tolist(), firsts, np.append(firsts[1:], len(self.quotients))):
            inside = slice(ends[lo], ends[hi])
            yield number, QuotientFilter(
                self.quotient_bits, self.quotients[lo:hi], self.runs[lo:hi], self.remainders[inside], self.counts[inside]
            )


_FILTER_SCHEMA = "block long, quotients binary, runs binary, remainders binary, counts binary"
_MERGED_SCHEMA = _FILTER_SCHEMA + ", shared binary"


def _packed(block: int, f: QuotientFilter) -> dict:
    arrays = {"quotients": f.quotients, "runs": f.runs, "remainders": f.remainders, "counts": f.counts}
    return {"block": block} | {name: array.tobytes() for name, array in arrays.items()}


def _unpacked(row: dict, quotient_bits: int) -> QuotientFilter:
    return QuotientFilter(
        quotient_bits,
        np.frombuffer(row["quotients"], np.uint64),
        np.frombuffer(row["runs"], np.int64),
        np.frombuffer(row["remainders"], np.uint64),
        np.frombuffer(row["counts"], np.int64),
    )


def block_bits(rows: int) -> int:
    """Bits that number the blocks, from 6 to 20."""
    return min(20, max(6, (rows // BLOCK_ENTRIES).bit_length()))


def counting_filters(fingerprints: DataFrame, rows: int) -> DataFrame:
    """One counting quotient filter over the long column of ``fingerprints``, a row per block.

    Each task builds the filter of its partition; tasks then merge by block. A fingerprint takes one
    entry per partition, so many copies of one text cost no more than one. Column ``shared`` has the
    block's part of the routing table: a bit per prefix that occurs in a fingerprint counted twice or more.
    """
    bits = block_bits(rows)
    quotient_bits = bits + SLOTS_PER_BLOCK_BITS
    route_bits = ROUTE_BITS
    fields = [name.split()[0] for name in _FILTER_SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.binary()] * 4]

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches if b.num_rows]
        if not held:
            return
        own = QuotientFilter.of(np.concatenate(held), quotient_bits)
        rows_out = [_packed(n, f) for n, f in own.blocks(1 << SLOTS_PER_BLOCK_BITS)]
        for start in range(0, len(rows_out), 64):
            yield pa.RecordBatch.from_pylist(rows_out[start : start + 64], pa.schema(list(zip(fields, types))))

    def merge(pieces: pa.Table) -> pa.Table:
        parts = [_unpacked(row, quotient_bits) for row in pieces.to_pylist()]
        whole = parts[0].merged(*parts[1:])
        number = pieces.column("block")[0].as_py()
        shared = np.zeros(1 << (route_bits - bits), bool)
        prefixes = whole.fingerprints()[whole.counts > 1] >> np.uint64(64 - route_bits)
        shared[(prefixes - np.uint64(number << (route_bits - bits))).astype(np.int64)] = True
        row = _packed(number, whole) | {"shared": np.packbits(shared).tobytes()}
        return pa.Table.from_pylist([row], pa.schema([*zip(fields, types), ("shared", pa.binary())]))

    return fingerprints.mapInArrow(build, _FILTER_SCHEMA).groupBy("block").applyInArrow(merge, _MERGED_SCHEMA)


def routing_table(filters: DataFrame, bits: int) -> np.ndarray:
    """Two to the power of :data:`ROUTE_BITS` bits, whatever the number of documents."""
    table = np.zeros((1 << bits, 1 << (ROUTE_BITS - bits - 3)), np.uint8)
    for block, shared in filters.select("block", "shared").toLocalIterator():
        table[block] = np.frombuffer(shared, np.uint8)
    return table.ravel()


def _may_repeat(filters: DataFrame, bits: int, fingerprint: Column) -> Column:
    table = filters.sparkSession.sparkContext.broadcast(routing_table(filters, bits))
    shift = np.uint64(64 - ROUTE_BITS)

    @F.arrow_udf("boolean")
    def routed(values: pa.Array) -> pa.Array:
        prefix = (values.to_numpy(zero_copy_only=False).view(np.uint64) >> shift).astype(np.int64)
        return pa.array((table.value[prefix >> 3] >> (7 - (prefix & 7))) & 1 == 1)

    return routed(fingerprint)


def normalised(text: str = "text") -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text_of(text), "[\\x20\\x09-\\x0D]+", "")


def exact_dedup(documents: DataFrame) -> DataFrame:
    """Per document the id that stays among equal normalised texts, and the size of its group.

    The text with most code points stays, of these the smallest id; a null id comes after all others.
    Null texts count as empty; an empty table gives no rows. Rows alike in id and text count in ``group_size`` and are marked alike.
    Texts are moved only where the merged filter may hold their fingerprint more than once, and copies
    within a task collapse before they move, so a group of any size is one row per task.
    """
    norm = normalised()
    docs = documents.select("doc_id", "text")
    narrow = written(
        docs.select(
            "doc_id",
            F.xxhash64(norm).alias("fingerprint"),
            F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        ),
        "fingerprints",
    )
    rows = narrow.count()
    filters = written(counting_filters(narrow.select("fingerprint"), rows), "quotient-filters")
    candidates = docs.select("doc_id", F.char_length(text_of()).alias("points"), norm.alias("norm"))
    candidates = candidates.withColumn("fingerprint", F.xxhash64("norm"))
    routed = candidates.where(_may_repeat(filters, block_bits(rows), F.col("fingerprint")))
    first = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id").alias("keep_id")))
    groups = written(
        routed.groupBy("fingerprint", "norm")
        .agg(F.count("*").alias("group_size"), first.alias("first"))
        .where("group_size > 1")
        .select("fingerprint", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "first.keep_id", "group_size"),
        "equal-texts",
    )
    grouped = F.col("group_size").isNotNull()
    return narrow.join(groups, ["fingerprint", "text_sha256"], "left").select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
