"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts up to five bytes is a set of tables, one per order, with counts from the
training documents. A byte seen c times in a context of n bytes, d of them distinct, has probability
(2c - 1) / 2n; one not seen escapes to the next shorter context with probability d / 2n, where the
bytes seen in the longer context are excluded. Probabilities depend on a context and a byte only, so
each distinct string of six bytes is evaluated once and sent back to the chunks of text that hold it; no
task holds the whole trie. Strings and words travel packed: a row has those of one chunk in one range.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shoplens.llm.common import id_remainder, text_of, written

ORDER = 5
# Symbols are the bytes of UTF-8 and the end of a text; the byte before its first is not predicted.
START, END = 0xFF, 0xFE
SYMBOLS = 255
# Text that shares one set of distinct strings, and text that is worked on at once.
CHUNK_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
# Distinct strings of so many blocks are kept apart before they are merged.
BLOCKS_AT_ONCE = 8
# Texts of a block are numbered in this many bits beside the 48 of a string.
TEXT_BITS = 16
SMOOTHING = 0.1


def strings_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` bytes before each symbol and the symbol, as one number each; and symbols per text."""
    lead, end = bytes([START]) * order, bytes([END])
    parts = [part for raw in texts for part in (lead, raw, end)]
    data = np.frombuffer(b"".join([*parts, bytes(7 - order)]), np.uint8)
    size = len(data) - 7
    # Eight bytes are read at every place as one number, of which the first are wanted.
    codes = np.ndarray((size,), ">u8", data.data, 0, (1,)).astype(np.uint64) >> np.uint64(8 * (7 - order))
    return codes[data[order : order + size] != START], np.array([len(raw) + 1 for raw in texts], np.int64)


def summed_by_text(found: np.ndarray, symbols: np.ndarray, codes: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Per text the sum of ``logp`` over its strings; ``codes`` is sorted and has all of them.

    Strings are sorted together with the number of their text, so that each distinct one is looked up once.
    """
    keys = found << np.uint64(TEXT_BITS) | np.repeat(np.arange(len(symbols), dtype=np.uint64), symbols)
    keys.sort()
    strings = keys >> np.uint64(TEXT_BITS)
    starts = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
    distinct = strings[starts]
    at = np.minimum(np.searchsorted(codes, distinct), len(codes) - 1)
    if (codes[at] != distinct).any():
        raise ValueError("a string of the text is not in the trie")
    values = np.repeat(logp[at], np.diff(np.append(starts, len(keys))))
    texts = (keys & np.uint64((1 << TEXT_BITS) - 1)).astype(np.int64)
    return np.bincount(texts, values, len(symbols))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte position by byte position."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def packed_codes(codes: np.ndarray) -> bytes:
    """Sorted codes, as their differences."""
    return packed(np.diff(codes, prepend=np.uint64(0)))


def unpacked_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def ranges_for(chunks: int) -> int:
    """How many ranges strings and words are spread over: a prime that grows with the chunks, so a range stays bounded."""
    number = 2 * chunks + 61
    while any(number % d == 0 for d in range(2, int(number**0.5) + 1)):
        number += 1
    return number


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) parts as one with distinct, sorted codes."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes)
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    counts = np.add.reduceat(np.concatenate([n for _, n in parts])[order], starts)
    return [(codes[starts], counts)]


def _by_range(homes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range with the places that belong to it, in their order."""
    order = np.argsort(homes, kind="stable")
    numbers, firsts = np.unique(homes[order], return_index=True)
    yield from zip(numbers.tolist(), np.split(order, firsts[1:]))


class _Chunk:
    """Texts of one chunk: compressed blocks, distinct strings and distinct words with their training counts."""

    def __init__(self, number: int, ranges: int):
        self.number = number
        self.ranges = ranges
        self.held_bytes = 0
        self.strings: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter[bytes] = Counter()
        self.blocks: list[tuple[list, bytes, bytes]] = []

    def add(self, ids: list, texts: list[bytes], held: list[bool]) -> None:
        taught = [raw for raw, out in zip(texts, held) if not out]
        others = [raw for raw, out in zip(texts, held) if out]
        for some, weight in ((taught, 1), (others, 0)):
            if some:
                codes, n = np.unique(strings_of(some)[0], return_counts=True)
                self.strings.append((codes, n * weight))
        if len(self.strings) > 2 * BLOCKS_AT_ONCE:
            self.strings = _merged(self.strings)
        for raw in taught:
            self.words.update(raw.split())
        for raw in others:
            self.words.update(dict.fromkeys(raw.split(), 0))
        sizes = np.array([len(raw) for raw in texts], np.int64).tobytes()
        self.blocks.append((ids, sizes, zstandard.compress(b"".join(texts), 3)))
        self.held_bytes += sum(map(len, texts))

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def rows(kind: str, count: int, **columns) -> pa.RecordBatch:
            fixed = {"kind": pa.array([kind] * count), "chunk": pa.array(np.full(count, self.number))}
            known = fixed | {name: pa.array(values, schema.field(name).type) for name, values in columns.items()}
            return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

        for ids, sizes, data in self.blocks:
            yield rows("block", 1, ids=[ids], sizes=[sizes], data=[data])
        self.blocks = []
        ((codes, counts),) = _merged(self.strings)
        self.strings = []
        for home, at in _by_range(codes % np.uint64(self.ranges)):
            yield rows("string", 1, home=[home], codes=[packed_codes(codes[at])], counts=[packed(counts[at])])
        del codes, counts
        words, counts = list(self.words), np.fromiter(self.words.values(), np.int64, len(self.words))
        homes = np.fromiter(map(crc32, words), np.uint64, len(words)) % np.uint64(self.ranges)
        for home, at in _by_range(homes):
            some = b" ".join([words[i] for i in at.tolist()])
            yield rows("word", 1, home=[home], words=[zstandard.compress(some, 1)], counts=[packed(counts[at])])
        self.words = Counter()
        # Workers are reused; what this chunk needed goes back to the system.
        pa.default_memory_pool().release_unused()


def _chunks(schema: pa.Schema, chunk_bytes: int, block_bytes: int, ranges: int):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        chunk, ids, texts, held, size = _Chunk(first, ranges), [], [], [], 0
        for batch in batches:
            texts_here = batch.column(1).cast(pa.binary())
            for key, raw, out in zip(batch.column(0).to_pylist(), texts_here, batch.column(2).to_pylist()):
                raw = raw.as_py()
                ids.append(key)
                texts.append(raw.lower())
                held.append(out)
                size += len(raw)
                if size >= block_bytes or len(ids) >= 1 << TEXT_BITS:
                    chunk.add(ids, texts, held)
                    ids, texts, held, size = [], [], [], 0
                    if chunk.held_bytes >= chunk_bytes:
                        yield from chunk.batches(schema)
                        chunk = _Chunk(chunk.number + 1, ranges)
        if ids:
            chunk.add(ids, texts, held)
        if chunk.blocks:
            yield from chunk.batches(schema)

    return build


def trie_levels(strings: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(code, c) per order from 0: strings of that many bytes and one more, with their training counts.

    ``strings`` has packed rows of the highest order: home, codes and counts. A range is added up in one
    task, where it holds a bounded number of strings. Strings that only held-out texts have count zero.
    """

    def added(pieces: pa.Table) -> pa.Table:
        parts = [(unpacked_codes(c), unpacked(n, np.int64)) for c, n in zip(*(pieces.column(x).to_pylist() for x in ("codes", "counts")))]
        ((codes, counts),) = _merged(parts)
        return pa.table({"code": codes.view(np.int64), "c": counts})

    narrow = strings.select("home", "codes", "counts")
    level = written(narrow.groupBy("home").applyInArrow(added, "code long, c long"), f"trie-{order}")
    levels = [level]
    for k in range(order - 1, -1, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("bigint")).alias("code")
        level = written(level.groupBy(suffix).agg(F.sum("c").alias("c")), f"trie-{k}")
        levels.insert(0, level)
    return levels


def log_probabilities(levels: list[DataFrame]) -> DataFrame:
    """(code, logp): log10 probability of the last byte of each string after the bytes before it.

    Goes up from order 0. ``below`` is the probability that the shorter contexts give a byte once the
    bytes seen in this context are excluded; a context has at most 255 bytes, so windows stay small.
    """
    context = Window.partitionBy(F.shiftright("code", 8))
    seen = (F.col("c") > 0).cast("long")
    state = None
    for k, level in enumerate(levels):
        if state is None:
            found = level.withColumns({"n": F.sum("c").over(context), "d": F.sum(seen).over(context)})
            state = found.withColumn("below", 1 / F.greatest(F.lit(1), SYMBOLS - F.col("d")))
        else:
            suffix = F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("bigint"))
            lower = state.select(*[F.col(x).alias(f"{x}_") for x in ("code", "c", "n", "d", "below")])
            found = level.join(lower, suffix == F.col("code_")).withColumns(
                {
                    "n": F.sum("c").over(context),
                    "d": F.sum(seen).over(context),
                    "excluded": F.sum(F.when(F.col("c") > 0, F.col("c_")).otherwise(0)).over(context),
                }
            )
            fresh_symbols = F.col("d_") - F.col("d")
            twice = 2 * (F.col("n_") - F.col("excluded"))
            below = (
                F.when(twice <= 0, F.col("below_"))
                .when(F.col("c_") > 0, (2 * F.col("c_") - 1) / twice)
                .otherwise(fresh_symbols / twice * F.col("below_"))
            )
            state = found.select("code", "c", "n", "d", below.alias("below"))
        if k < len(levels) - 1:
            state = written(state, f"order-{k}")
    own = (
        F.when(F.col("n") == 0, F.col("below"))
        .when(F.col("c") > 0, (2 * F.col("c") - 1) / (2 * F.col("n")))
        .otherwise(F.col("d") / (2 * F.col("n")) * F.col("below"))
    )
    return state.select("code", F.log10(own).alias("logp"))


def _found(strings: pa.Table, known: pa.Table) -> pa.Table:
    """The log probabilities of one range, in the order of each chunk's strings."""
    codes = known.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, logp = codes[order], known.column("logp").to_numpy()[order]
    chunks, sent = strings.column("chunk"), strings.column("codes")
    values = [packed(logp[np.searchsorted(codes, unpacked_codes(x.as_py()))]) for x in sent]
    return pa.table({"chunk": chunks.combine_chunks(), "codes": sent.combine_chunks(), "values": pa.array(values, pa.binary())})


def _words_of(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def _word_totals(pieces: pa.Table) -> pa.Table:
    """Each chunk's words of one range with their counts in all chunks, and a row without chunk for the range."""
    own = [_words_of(data) for data in pieces.column("words").to_pylist()]
    place = pa.array([word for words in own for word in words], pa.binary()).dictionary_encode()
    at = place.indices.to_numpy()
    totals = np.zeros(len(place.dictionary), np.int64)
    np.add.at(totals, at, np.concatenate([unpacked(n, np.int64) for n in pieces.column("counts").to_pylist()]))
    ends = np.cumsum([len(words) for words in own])
    found = [packed(part) for part in np.split(totals[at], ends[:-1])]
    return pa.table(
        {
            "chunk": pa.array([*pieces.column("chunk").to_pylist(), None], pa.int64()),
            "words": pa.array([*pieces.column("words").to_pylist(), None], pa.binary()),
            "totals": pa.array([*found, None], pa.binary()),
            "tokens": pa.array([None] * len(own) + [int(totals.sum())], pa.int64()),
            "types": pa.array([None] * len(own) + [int((totals > 0).sum())], pa.int64()),
        }
    )


def _scorer(key: pa.DataType, tokens: int, types: int):
    total = tokens + SMOOTHING * (types + 1)
    schema = pa.schema(
        [("doc_id", key), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def score(strings: pa.Table, rest: pa.Table, ends: int) -> pa.Table:
        codes = np.concatenate([unpacked_codes(x.as_py()) for x in strings.column("codes")])
        logp = np.concatenate([unpacked(x.as_py(), np.float64) for x in strings.column("values")])
        order = np.argsort(codes)
        codes, logp = codes[order], logp[order]
        place, counts, blocks = {}, [], []
        for row, (words, totals) in enumerate(zip(rest.column("words"), rest.column("totals"))):
            if words.is_valid:
                own = _words_of(words.as_py())
                place.update(zip(own, range(len(place), len(place) + len(own))))
                counts.append(unpacked(totals.as_py(), np.int64))
            else:
                blocks.append(row)
        count = np.append(np.concatenate([*counts, np.empty(0, np.int64)]), ends)
        base, known = np.log10((count + SMOOTHING) / total), count > 0
        del order, counts
        out = []
        for row in blocks:
            # One block at a time; the others stay compressed in the table.
            block = {name: rest.column(name)[row].as_py() for name in ("ids", "sizes", "data")}
            data = zstandard.decompress(block["data"])
            stops = np.cumsum(np.frombuffer(block["sizes"], np.int64))
            texts = [data[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
            found, symbols = strings_of(texts)
            scores = summed_by_text(found, symbols, codes, logp)
            own = [raw.split() for raw in texts]
            lengths = np.array([len(w) + 1 for w in own], np.int64)
            spots = np.fromiter((p for w in own for p in (*map(place.__getitem__, w), len(place))), np.int64, int(lengths.sum()))
            firsts = np.cumsum(lengths) - lengths
            columns = [block["ids"], lengths, np.add.reduceat(known[spots].astype(np.int64), firsts), np.add.reduceat(base[spots], firsts), scores]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema)

    return score


def ppm_scores(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Log10 probability of every whole text, with a smoothed unigram score beside it.

    Documents whose crc32 of the id leaves 0 on division by 10 are held out, the others train. A-Z are
    lower-cased; tokens are words and one end per document. Null texts count as empty and have their
    end only. Every row is scored and trains by itself, also repeated ones; an empty table gives no rows.

    Text moves once, compressed, to the task that scores its chunk. A chunk sends its distinct strings and its
    distinct words as one packed row per range, so a frequent one costs an entry per chunk. The ranges grow
    with the chunks, so that what one task adds up stays bounded.
    """
    docs = documents.select("doc_id", text_of().alias("text"), (id_remainder("doc_id", 10) == 0).alias("held_out"))
    key = documents.schema["doc_id"].dataType
    size = docs.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    ends = size[1] or 0
    parallel = documents.sparkSession.sparkContext.defaultParallelism
    tasks = max(parallel, -(-(size[0] or 0) // chunk_bytes))
    docs, ranges = docs.coalesce(tasks), ranges_for(tasks)

    ddl = f"kind string, chunk long, home long, codes binary, counts binary, words binary, ids array<{key.simpleString()}>, sizes binary, data binary"
    id_type = pa.int64() if key.simpleString() == "bigint" else pa.int32() if key.simpleString() == "int" else pa.string()
    plain = {"kind": pa.string(), "chunk": pa.int64(), "home": pa.int64(), "codes": pa.binary(), "counts": pa.binary(), "words": pa.binary()}
    schema = pa.schema([*plain.items(), ("ids", pa.list_(id_type)), ("sizes", pa.binary()), ("data", pa.binary())])
    corpus = written(docs.mapInArrow(_chunks(schema, chunk_bytes, block_bytes, ranges), ddl), "corpus")

    strings = corpus.where("kind = 'string'").select("chunk", "home", "codes", "counts")
    logp = log_probabilities(trie_levels(strings)).withColumn("home", F.col("code") % F.lit(ranges))
    sent = strings.select("chunk", "home", "codes").groupBy("home").cogroup(logp.groupBy("home"))
    known = sent.applyInArrow(_found, "chunk long, codes binary, values binary")
    own = corpus.where("kind = 'word'").select("chunk", "home", "words", "counts")
    totals = own.groupBy("home").applyInArrow(_word_totals, "chunk long, words binary, totals binary, tokens long, types long")
    words = written(totals, "words")
    tokens, types = words.where("chunk is null").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "types")]).first()
    tokens, types = tokens + ends, types + (ends > 0)

    blocks = corpus.where("kind = 'block'").select("chunk", "ids", "sizes", "data")
    own = words.where("chunk is not null").select("chunk", "words", "totals")
    rest = own.unionByName(blocks, allowMissingColumns=True)
    score = _scorer(id_type, tokens, types)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return score(left, right, ends)

    result = f"doc_id {key.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    done = known.groupBy("chunk").cogroup(rest.groupBy("chunk")).applyInArrow(scored, result)
    return done.select(
        "doc_id",
        (id_remainder("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
