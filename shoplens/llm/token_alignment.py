"""Alignment of two tokenizers over the same texts.

Both token sequences of a text cut the same bytes. Where a token of either ends at the same byte, a group
ends, and the tokens of a group are linked. The work inside a task runs on whole Arrow columns: lists are
flattened beside their parent indices, lengths become ends by cumulative sums that start anew with each
document, common ends come from a hash join on (document, end), and grouped counts give the links. Counts of
a task's chunks are added up by Spark; the sums go back once to each chunk that holds the pair.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoplens.llm.common import raw_texts, written

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
# Bytes of text whose tokens are aligned together; a longer text stands alone.
TEXT_AT_ONCE = 2 << 20
# Pairs, one per document that has them, at which a chunk is closed. A longer document has a chunk of its own.
PAIRS_PER_CHUNK = 6_000_000


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write: printable ones stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _plain(texts: list[bytes]) -> list[str]:
    return [raw.decode("utf-8", "replace") for raw in texts]


def _table_of(tokens: list[bytes]) -> tuple[pa.Array, pa.Array]:
    return pa.array(tokens, pa.binary()), pa.array([len(x) for x in tokens], pa.int64())


class ByteLevel:
    """Ids of a byte-level BPE vocabulary; special tokens are plain text.

    Where merges have the order of their ids, as ranks do, the ranks are used, which is faster and gives the
    same ids; another vocabulary goes through the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        alphabet = byte_alphabet()
        special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        tokens = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            if token not in special:
                tokens[i] = bytes(alphabet[c] for c in token)
        self.bytes, self.lengths = _table_of(tokens)
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in told["model"]["merges"]]
        ranked = all(vocabulary.get(m) == 256 + i for i, m in enumerate(merges)) and len(vocabulary) - len(merges) in (256, 256 + len(special))
        cut = told.get("pre_tokenizer") or {}
        if ranked and told.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex"):
            import public_tokenizers
            import tiktoken

            ranks = {token: i for i, token in enumerate(tokens) if token}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [encoding.encode_ordinary(x) for x in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[bytes]) -> list[list[int]]:
        """Of a space and each text."""
        return self.encode([f" {x}" for x in _plain(texts)])


class Pieces:
    """Ids of a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        tokens = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]
        self.bytes, self.lengths = _table_of(tokens)

    def ids(self, texts: list[bytes]) -> list[list[int]]:
        return self.model.encode(_plain(texts), num_threads=1)


@cache
def tokenizers_of(byte_path: str | None, piece_path: str | None) -> tuple[ByteLevel, Pieces]:
    """One pair for each worker."""
    import public_tokenizers

    # Tasks share the machine's cores; Arrow's own threads would take more than a task's.
    pa.set_cpu_count(1)
    return ByteLevel(byte_path or public_tokenizers.path(BYTE_VOCABULARY)), Pieces(piece_path or public_tokenizers.path(PIECE_VOCABULARY))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def _ends(lists: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Parent document, id and end byte of every token, ends counted within the document."""
    doc, token = pc.list_parent_indices(lists).cast(pa.int64()), pc.list_flatten(lists)
    total = pc.cumulative_sum(lengths.take(token))
    upto = np.concatenate([[0], total.to_numpy(zero_copy_only=False)])
    base = pa.array(upto[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()])
    return doc, token, pc.subtract(total, base.take(doc))


def _segments(array: pa.Array, marks: np.ndarray) -> pa.ListArray:
    """``array`` cut after every marked place."""
    offsets = np.concatenate([[0], np.flatnonzero(marks) + 1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), array)


@dataclass
class Alignment:
    """Per document counts and the text of its groups, and the linked pairs with their number of links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    # doc, a, b, times; one row per document and pair.
    pairs: pa.Table


def aligned(texts: list[bytes], a: ByteLevel, b: Pieces) -> Alignment:
    """Groups and links of each text; none for an empty one or where the tokens do not give its bytes back."""
    spaced = pa.array([b" " + raw for raw in texts], pa.binary())
    sides = []
    for tokenizer in (a, b):
        lists = _lists(tokenizer.ids(texts))
        spelled = pa.ListArray.from_arrays(lists.offsets, tokenizer.bytes.take(lists.values))
        sides.append((lists, pc.equal(pc.binary_join(spelled, b""), spaced)))
    usable = pc.and_(pc.and_(sides[0][1], sides[1][1]), pa.array([bool(raw) for raw in texts]))
    rows = pc.indices_nonzero(usable).to_numpy()
    n = len(texts)
    lists = [side.take(pa.array(rows)) for side, _ in sides]

    (doc_a, token_a, end_a), (doc_b, token_b, end_b) = (_ends(x, t.lengths) for x, t in zip(lists, (a, b)))
    left = pa.table({"doc": doc_a, "end": end_a, "at_a": pa.array(np.arange(len(token_a)))})
    right = pa.table({"doc": doc_b, "end": end_b, "at_b": pa.array(np.arange(len(token_b)))})
    common = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    marks_a, marks_b = np.zeros(len(token_a), np.int64), np.zeros(len(token_b), np.int64)
    marks_a[common["at_a"].to_numpy()] = 1
    marks_b[common["at_b"].to_numpy()] = 1
    # Both sequences of a document end at its last byte, so groups have the same numbers on both sides.
    group_a, group_b = (np.cumsum(m) - m for m in (marks_a, marks_b))
    doc_of_group = doc_a.to_numpy()[np.flatnonzero(marks_a)]
    n_groups = np.bincount(rows[doc_of_group], minlength=n)

    joined = [pc.binary_join(_segments(t.cast(pa.string()), m), ",") for t, m in ((token_a, marks_a), (token_b, marks_b))]
    each = pc.binary_join_element_wise(*joined, "|")
    offsets = np.concatenate([[0], np.cumsum(n_groups[rows])])
    told = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), ";").to_pylist()
    groups = [""] * n
    for row, text in zip(rows.tolist(), told):
        groups[row] = text

    per_group = [
        pa.table({"group": pa.array(g), x: t}).group_by(["group", x], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", x, f"n_{x}"])
        for g, x, t in ((group_a, "a", token_a), (group_b, "b", token_b))
    ]
    links = per_group[0].join(per_group[1], "group", join_type="inner", use_threads=False)
    times = pc.multiply(links["n_a"], links["n_b"])
    doc = pa.array(rows[doc_of_group[links["group"].to_numpy()]], pa.int64())
    linked = pa.table({"doc": doc, "a": links["a"], "b": links["b"], "times": times})
    pairs = linked.group_by(["doc", "a", "b"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "a", "b", "times"])
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, pairs["doc"].to_numpy(), pairs["times"].to_numpy())
    counts = [np.zeros(n, np.int64) for _ in lists]
    for count, x in zip(counts, lists):
        count[rows] = np.diff(x.offsets.to_numpy())
    return Alignment(*counts, n_groups, n_links, groups, pairs)


def _by_bytes(ids: pa.Array, texts: list[bytes]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    first, held = 0, 0
    for i, raw in enumerate(texts):
        if i > first and held + len(raw) > TEXT_AT_ONCE:
            yield ids[first:i], texts[first:i]
            first, held = i, 0
        held += len(raw)
    if first < len(texts):
        yield ids[first:], texts[first:]


@dataclass
class _Chunk:
    """Neighbouring documents whose pairs are counted together."""

    number: int
    schema: pa.Schema

    def __post_init__(self):
        self.ids: list[pa.Array] = []
        self.rows: list[Alignment] = []
        self.digests: list[str | None] = []
        self.docs = self.size = 0

    def add(self, ids: pa.Array, found: Alignment) -> None:
        at = self.docs
        self.ids.append(ids)
        self.digests += [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.groups]
        found.groups = []
        found.pairs = found.pairs.set_column(0, "doc", pc.add(found.pairs["doc"], at))
        self.rows.append(found)
        self.docs += len(ids)
        self.size += len(found.pairs)

    def closed(self) -> Iterator[pa.RecordBatch]:
        """A row per document, whose pairs are places in the chunk's sorted pairs, then a row per pair."""
        pairs = pa.concat_tables(x.pairs for x in self.rows).sort_by("doc")
        code = pc.add(pc.shift_left(pairs["a"].cast(pa.int64()), 32), pairs["b"].cast(pa.int64()))
        counted = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
        codes = counted["code"].combine_chunks()
        places = pc.index_in(code, codes).combine_chunks()
        offsets = np.searchsorted(pairs["doc"].to_numpy(), np.arange(self.docs + 1))
        lists = {
            "places": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places),
            "times": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs["times"].combine_chunks()),
        }
        plain = {x: pa.array(np.concatenate([getattr(r, x) for r in self.rows])) for x in ("n_a", "n_b", "n_groups", "n_links")}
        ids = pa.concat_arrays(self.ids)
        yield self._batch(self.docs, doc_id=ids, groups_sha256=pa.array(self.digests, pa.string()), **plain, **lists)
        yield self._batch(len(codes), code=codes, docs=counted["count_all"].combine_chunks())

    def _batch(self, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(rows, self.number))
        columns["is_pair"] = pa.array([("code" in columns)] * rows, pa.bool_())
        arrays = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in self.schema]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _chunks(byte_path: str | None, piece_path: str | None, pairs_per_chunk: int):
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers_of(byte_path, piece_path)
        chunk, number = None, TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in _by_bytes(batch.column(0), raw_texts(batch.column(1))):
                chunk = chunk or _Chunk(number, _chunk_schema(ids.type))
                chunk.add(ids, aligned(texts, a, b))
                if chunk.size >= pairs_per_chunk:
                    yield from chunk.closed()
                    chunk, number = None, number + 1
        if chunk:
            yield from chunk.closed()
        pa.default_memory_pool().release_unused()

    return align


def _chunk_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("chunk", pa.int64()), ("is_pair", pa.bool_()), ("code", pa.int64()), ("docs", pa.int64()), ("doc_id", key)]
        + [(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))]
    )


_RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk with the corpus-wide counts of their pairs; best counts are negative."""
    by_place = counts.sort_by("code")["signed"].combine_chunks().to_numpy() if len(counts) else np.zeros(0, np.int64)
    places, times = docs["places"].combine_chunks(), docs["times"].combine_chunks()
    signed = by_place[places.flatten().to_numpy()]
    weight = times.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy())])

    def per_document(values: np.ndarray) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(values)])
        return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

    done = {"n_best": per_document(weight * (signed < 0)), "count_sum": per_document(weight * np.abs(signed))}
    names = ["doc_id", *_RESULT]
    return pa.table([done[x] if x in done else docs[x] for x in names], names)


def align_tokenizers(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, pairs_per_chunk: int = PAIRS_PER_CHUNK
) -> tuple[DataFrame, DataFrame]:
    """The result of :func:`token_alignment`, and the pair table (a, b, docs, best) of the whole corpus.

    Pairs of a chunk are counted in its task, so a pair sends one row per chunk, however frequent it is; a
    document refers to its pairs by their place in the chunk.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"chunk long, is_pair boolean, code long, docs long, doc_id {key}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, places array<int>, times array<long>"
    )
    chunks = written(docs.mapInArrow(_chunks(byte_path, piece_path, pairs_per_chunk), ddl), "aligned")
    pairs = chunks.where("is_pair").select("chunk", "code", "docs")
    counts = pairs.groupBy("code").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("code", 32))
    counts = written(counts, "pair-counts")
    # At most one row per entry of the other vocabulary and id, so no group is large.
    best = counts.groupBy("a").agg(F.max("docs").alias("most"))
    counts = counts.join(best, "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))
    signed = F.when(F.col("best"), -F.col("docs")).otherwise(F.col("docs")).alias("signed")
    known = pairs.select(F.col("chunk").alias("of_chunk"), "code").join(counts.select("code", signed), "code")
    rows = chunks.where("not is_pair").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    schema = f"doc_id {key}, " + ", ".join(f"{x} {'string' if x == 'groups_sha256' else 'long'}" for x in _RESULT)
    done = rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_summed, schema)
    table = counts.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "docs", "best")
    return done, table


def token_alignment(documents: DataFrame) -> DataFrame:
    """Tokens, groups and links of every document, and what its links count corpus-wide.

    Null and empty texts, and texts that the tokens of either side do not spell, have zeros and no digest.
    Every row gives one row and counts as a document, also repeated ones; an empty table gives none.
    """
    return align_tokenizers(documents)[0]
