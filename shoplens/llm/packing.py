"""Packing of token sequences, hierarchically by residual.

Every partition packs its pieces best fit by itself and emits the bins that are nearly full. The
others go up a tree of partitions as items, and each node packs the items of its children best fit
again. Only lengths travel; ids stay where they were made.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from string import ascii_lowercase
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoplens.llm.common import raw_texts, written
from shoplens.llm.measures import in_batches

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
# A bin with no more room than this is full.
NEARLY_FULL = 8
FAN_IN = 8
VOCABULARY = "word_bpe_49k.json"
END = (0).to_bytes(4, "little")
# Bytes of words and ids that a task remembers; the words themselves cost about as much again.
REMEMBERED_BYTES = 64 << 20
# What an entry of the memory takes beside the bytes of the word and of its ids.
ENTRY_BYTES = 150
WORDS_AT_ONCE = 200
# Marks that are tokenized apart from letters before them, when no letter follows.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Words that are told apart at once, and those whose ids are put together at once, which takes far larger arrays.
WORDS_IN_BATCH = 3_000_000
WORDS_TOGETHER = 200_000
ROWS_AT_ONCE = 50_000

# Two words with every lower-case ASCII letter.
_NORMAL = f"{ascii_lowercase} {ascii_lowercase[::-1]}"

_PIECE = pa.schema(
    [
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("bin", pa.int64()),
        ("offset", pa.int64()),
        ("fill", pa.int64()),
        ("node", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_ITEM = "node long, bin long, fill long, parts array<struct<bin:bigint,shift:bigint>>, up boolean"


class WordIds:
    """Ids of white-space separated words as little-endian 32-bit numbers, remembered by word.

    The vocabulary never joins characters across ASCII white space, and ignores case, so each word is
    tokenized once. A run of ASCII marks after letters that end a word is tokenized apart from them, so
    the letters are looked up without it. Words of letters alone have one last token each, which tells
    them apart when many are tokenized as one text. Words are told apart and put together by Arrow and
    numpy; Python sees each distinct one of a batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case ASCII letters are normal already, unless this normalizer says otherwise.
        normalizer = self.tokenizer.normalizer
        self.of_ascii = self.tokenizer
        if normalizer is not None and normalizer.normalize_str(_NORMAL) == _NORMAL:
            self.of_ascii = Tokenizer.from_file(path)
            self.of_ascii.normalizer = None
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _several(self, words: list[str], tokenizer: Tokenizer) -> list[bytes]:
        """Ids of words of letters."""
        found = tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(found, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return [self._one(word) for word in words]
        raw, stops = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, words: list[str]) -> None:
        """Remember every one of ``words``."""
        known = self.known
        if self.held > REMEMBERED_BYTES:
            # Words of the last texts are likely to come again.
            self.known = known = {word: known[word] for word in words if word in known}
            self.held = self._size(known)
        new = dict.fromkeys(word for word in words if word not in known)
        ascii_words, letters = [], []
        for word in new:
            if word.isascii() and word.isalpha() and word.islower():
                ascii_words.append(word)
            elif word.isalpha() and word.lower().isalpha():
                letters.append(word)
            else:
                known[word] = self._one(word)
        for several, tokenizer in ((ascii_words, self.of_ascii), (letters, self.tokenizer)):
            for start in range(0, len(several), WORDS_AT_ONCE):
                some = several[start : start + WORDS_AT_ONCE]
                known.update(zip(some, self._several(some, tokenizer)))
        self.held += self._size(new)

    def _size(self, words: Iterable[str]) -> int:
        return sum(len(word) + len(self.known[word]) + ENTRY_BYTES for word in words)

    def forget(self) -> None:
        self.known, self.held = {}, 0

    @staticmethod
    def _parted(words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """Each word as what is looked up and the marks after it: lower-case letters, or the word as it is and no marks."""
        base = pc.ascii_rtrim(pc.ascii_lower(words), MARKS)
        letters = pc.ascii_is_alpha(base).to_numpy(zero_copy_only=False).copy()
        others = np.flatnonzero(~pc.string_is_ascii(base).to_numpy(zero_copy_only=False))
        # What lower() makes of a letter may be more than letters.
        letters[others] = [w.isalpha() and w.lower().isalpha() for w in base.take(pa.array(others)).to_pylist()]
        parted = pa.array(letters)
        marks = pc.struct_field(pc.extract_regex(words, f"(?P<marks>[{re.escape(MARKS)}]*)$"), "marks")
        return pc.if_else(parted, base, words).dictionary_encode(), pc.if_else(parted, marks, "").dictionary_encode()

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text and the end id."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        bases, marks = self._parted(words.dictionary)
        looked_up, after = bases.dictionary.to_pylist(), marks.dictionary.to_pylist()
        self.learn([*looked_up, *after])
        parts = [*map(self.known.__getitem__, looked_up), *map(self.known.__getitem__, after)]
        ids = np.frombuffer(b"".join(parts), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(lengths) - lengths
        # Every word is two runs of ids, one after the other.
        runs_of = np.stack([bases.indices.to_numpy(), len(looked_up) + marks.indices.to_numpy()], 1)
        which, offsets = words.indices.to_numpy(), split.offsets.to_numpy()
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WORDS_TOGETHER, "right")) - 1)
            runs = runs_of[which[offsets[first] : offsets[last]]].ravel()
            size = lengths[runs]
            ends = np.concatenate([[0], np.cumsum(size)])
            found = ids[np.repeat(starts[runs] - ends[:-1], size) + np.arange(ends[-1])]
            of_text = ends[2 * (offsets[first : last + 1] - offsets[first])].tolist()
            for start, stop in zip(of_text, of_text[1:]):
                yield found[start:stop].tobytes() + END
            first = last


@cache
def word_ids(path: str | None) -> WordIds:
    """One for each worker: the vocabulary is loaded once, what words gave is forgotten at the end of a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers

    return WordIds(path or public_tokenizers.path(VOCABULARY))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the fill of each bin.

    Open bins are kept by their room, with one bit per room that occurs, so each item takes constant time.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    present = 0
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, capacity - room
        fills[chosen] += size
        left = room - size
        if left:
            rooms[left].append(chosen)
            present |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def goes_up(fills: np.ndarray, capacity: int, fan_in: int) -> np.ndarray:
    """Bins that a parent node can use.

    After best fit at most one bin of a node is filled to half or less, and two fuller ones never
    fit together. So a parent joins at most one bin per child to another one, and needs no more than
    ``fan_in`` bins of equal fill from any child; the others are final, which changes no result.
    """
    up = np.zeros(len(fills), bool)
    seen: dict[int, int] = {}
    for place, fill in enumerate(fills.tolist()):
        if fill < capacity - NEARLY_FULL and seen.get(fill, 0) < fan_in:
            seen[fill] = seen.get(fill, 0) + 1
            up[place] = True
    return up


def _local_packer(path: str | None, capacity: int, with_ids: bool):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        ids, owner, rows, raw_ids = [], [], [], []
        for batch in batches:
            place = sum(len(x) for x in ids)
            ids.append(batch.column(0))
            for some in in_batches(raw_texts(batch.column(1)), WORDS_IN_BATCH):
                for tokens in word_ids(path).of(some):
                    total = len(tokens) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        own = tokens[4 * start : 4 * (start + capacity)]
                        owner.append(place)
                        rows.append((piece, start, len(own) // 4, zlib.crc32(own)))
                        raw_ids.append(own if with_ids else None)
                    place += 1
        word_ids(path).forget()
        if not rows:
            return
        table = np.array(rows, np.int64)
        bins, offsets, fills = best_fit(table[:, 2], capacity)
        keys = pa.chunked_array(ids).take(pa.array(owner))
        for start in range(0, len(rows), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            columns = [*table[part].T, (node << 33) + bins[part], offsets[part], fills[bins[part]], np.full(len(table[part]), node)]
            arrays = [pa.array(c, t.type) for c, t in zip(columns, _PIECE)]
            yield pa.RecordBatch.from_arrays(
                [keys[part].combine_chunks(), *arrays, pa.array(raw_ids[part], pa.binary())], ["doc_id", *_PIECE.names]
            )

    return pack


def _merge_node(capacity: int, fan_in: int):
    def merge(items: pa.Table) -> pa.Table:
        rows = sorted(items.to_pylist(), key=lambda r: (-r["fill"], r["bin"]))
        bins, offsets, fills = best_fit(np.array([r["fill"] for r in rows], np.int64), capacity)
        merged: dict[int, dict] = {}
        for row, chosen, offset in zip(rows, bins.tolist(), offsets.tolist()):
            into = merged.setdefault(chosen, {"node": row["node"], "bin": row["bin"], "fill": int(fills[chosen]), "parts": []})
            into["parts"] += [{"bin": p["bin"], "shift": p["shift"] + offset} for p in row["parts"]]
        out = [merged[i] for i in range(len(fills))]
        for row, up in zip(out, goes_up(fills, capacity, fan_in).tolist()):
            row["up"] = up
        part = pa.list_(pa.struct([("bin", pa.int64()), ("shift", pa.int64())]))
        kinds = [("node", pa.int64()), ("bin", pa.int64()), ("fill", pa.int64()), ("parts", part), ("up", pa.bool_())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    return merge


def _moves(pieces: DataFrame, capacity: int, fan_in: int) -> DataFrame:
    """(part, sequence, shift) for the bins that a node of the tree has put into another bin."""
    bins = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - NEARLY_FULL))
    part = F.struct("bin", F.lit(0).cast("long").alias("shift"))
    items = bins.select("node", "bin", "fill", F.array(part).alias("parts"))
    last = pieces.agg(F.max("node")).first()[0] or 0
    levels = []
    while last > 0:
        last //= fan_in
        up = items.withColumn("node", F.floor(F.col("node") / fan_in))
        level = written(up.groupBy("node").applyInArrow(_merge_node(capacity, fan_in), _ITEM), "packing")
        levels.append(level if last == 0 else level.where("not up"))
        items = level.where("up").drop("up")
    if not levels:
        return items.select(F.col("bin").alias("part"), F.col("bin").alias("sequence"), F.lit(0).cast("long").alias("shift")).limit(0)
    done = levels[0]
    for level in levels[1:]:
        done = done.unionByName(level)
    moved = done.where("size(parts) > 1").select(F.col("bin").alias("sequence"), F.explode("parts").alias("p"))
    return written(moved.select(F.col("p.bin").alias("part"), "sequence", "p.shift"), "moves")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, fan_in: int = FAN_IN, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents with their place in sequences of ``capacity`` tokens.

    ``docs`` has doc_id and text; null texts count as empty and give one token, the end. ``tokenizer`` is a
    file of the tokenizers library. With ``with_ids`` each piece has its ids as little-endian 32-bit numbers.
    Rows of equal ids are packed each; an empty table gives no pieces. Tokens are made once: pieces are a written table.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, node long, ids binary"
    pieces = written(docs.mapInArrow(_local_packer(tokenizer, capacity, with_ids), schema), "pieces")
    moves = _moves(pieces.drop("ids"), capacity, fan_in)
    placed = pieces.join(moves, F.col("bin") == F.col("part"), "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        "ids",
    )
    return placed if with_ids else placed.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids; a group holds one sequence."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(ordered, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
