"""Counts taken from whole texts, on UTF-8 bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np

from shoplens.llm.common import CONTINUATION, WHITE

WORDS_AT_ONCE = 1_000_000


def without(raw: bytes, deleted: bytes) -> int:
    """Bytes left after deleting every byte of ``deleted``."""
    return len(raw.translate(None, deleted))


def word_code_points(raw: bytes) -> int:
    return without(raw, WHITE + CONTINUATION)


def repeated_lines(raw: bytes) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated_windows(texts: list[list[bytes]], width: int = 8) -> np.ndarray:
    """Per text, the words inside a window of ``width`` (a power of two) words that the text has twice or more.

    Windows get exact ranks by doubling: the rank of 2n words is the rank of a pair of ranks of n words.
    """
    lengths = np.array([len(words) for words in texts], np.int64)
    total = int(lengths.sum())
    result = np.zeros(len(texts), np.int64)
    if total <= width:
        return result
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ranks = np.fromiter((index[w] for words in texts for w in words), np.int64, total)
    text = np.repeat(np.arange(len(texts)), lengths)
    reach = 1
    while reach < width:
        ranks = _ranks(ranks[:-reach] * (int(ranks.max()) + 1) + ranks[reach:])
        reach *= 2
    inside = np.flatnonzero(text[: len(ranks)] == text[width - 1 :])
    keys = ranks[inside] + (int(ranks.max()) + 1) * text[inside]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    starts = inside[again]
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    np.add.at(result, text[np.cumsum(edges[:-1]) > 0], 1)
    return result


def in_batches(texts: Iterable[bytes], most: int = WORDS_AT_ONCE) -> Iterator[list[bytes]]:
    """Neighbouring texts together, so far as they have about ``most`` words; a longer text stands alone."""
    batch: list[bytes] = []
    held = 0
    for raw in texts:
        size = len(raw) // 4
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(raw)
        held += size
    if batch:
        yield batch


# What `measured` returns for each text, in this order.
MEASURES = {
    "n_words": "[^\\x20\\x09-\\x0D]+",
    "word_chars": "code points in words",
    "n_symbols": "characters of #*$%&|<>",
    "n_lines": "\\n-split lines with a word",
    "n_dup_lines": "of these, equal to an earlier line",
    "n_adjacent": "words equal to the word before",
    "n_distinct": "distinct words",
    "n_capitals": "A-Z",
    "n_exclaims": "exclamation marks",
    "n_digits": "0-9",
    "n_stops": "full stops, question marks and commas",
}
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def measured(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    lines, again = repeated_lines(raw)
    size = len(raw)
    return (
        len(words),
        word_code_points(raw),
        size - without(raw, b"#*$%&|<>"),
        lines,
        again,
        sum(map(bytes.__eq__, words, words[1:])),
        len(set(words)),
        size - without(raw, CAPITALS),
        size - without(raw, b"!"),
        size - without(raw, b"0123456789"),
        size - without(raw, b".?,"),
    )
