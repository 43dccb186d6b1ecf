"""Product codes against a plain computation that compares every entry, and against SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from shoplens.llm.oracles import ORACLES
from shoplens.llm.vector_codes import nearest_entries, vector_codes
from tests.llm.conftest import equals_sql

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, code string, values long"


def table(spark, rows):
    """Rows (vec_id, vector, label) with columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, v, x, "x", 1) for i, v, x in rows], SCHEMA).repartition(3)


def brute_force(rows, parts=4):
    """Codes with Python integers, entry by entry."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v], x_) for i, v, x_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    longest = max(len(v) for _, v, _ in kept)
    width = max(1, -(-longest // parts))
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[row[p] for row in cut[:256]] for p in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, entry)), e) for e, entry in enumerate(book))

    for _ in range(4):
        for p in range(parts):
            members = {}
            for row in cut:
                members.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else book for e, book in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = []
    for (i, _, label), row in zip(kept, cut):
        best = [nearest(row[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    totals = {}
    for _, _, error, label in found:
        totals[label] = totals.get(label, 0) + error
    return [(i, code, error, totals[label], sha) for i, code, error, label in found]


@pytest.mark.parametrize("spread", [3, 1000])
def test_nearest_entry_is_that_of_a_full_search(spread):
    rng = np.random.default_rng(spread)
    points, entries = rng.integers(-spread, spread, (500, 5)), rng.integers(-spread, spread, (60, 5))
    entries[7] = entries[50]
    distance = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    index, best = nearest_entries(points, entries)
    assert index.tolist() == distance.argmin(axis=1).tolist() and best.tolist() == distance.min(axis=1).tolist()


def test_search_stops_early():
    """Entries far away in their sum are not looked at."""
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if self.ndim == 2 and isinstance(key, np.ndarray):
                seen.append(len(key))
            return super().__getitem__(key)

    entries = (np.arange(256)[:, None] * np.ones((1, 4), np.int64)).astype(np.int64)
    nearest_entries(entries[::8].copy() + 0, entries.view(Counted))
    assert sum(seen) < 32 * 8


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8))
    rows = [(int(i), (centres[i % 40] + rng.normal(size=8) * 0.1).tolist(), int(i % 3)) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], None) for i in range(30)]
    rows += [rows[5], rows[5], (3, rows[9][1], 2), (None, rows[10][1], None)]
    rows += [(-1, None, 1), (-2, [0.1, None] + [0.0] * 6, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, 1)]
    rows += [(2000, [1.5, -2.5], 7), (2001, [], 7), (2002, [3e6, -3e6, 1e9, 1.0, 0.0, 0.0, 0.0, 2e9], 8)]
    found = vector_codes(table(spark, rows)).collect()
    expected = [(i, c, min(e, 2**63 - 1), min(t, 2**63 - 1), s) for i, c, e, t, s in brute_force(rows)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(5, [0.5, -0.5, 0.25, 1.0], None)], [(i, [float(i % 2)], 1) for i in range(9)]])
def test_few_vectors(spark, rows):
    found = vector_codes(table(spark, rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_force(rows))


def test_equals_sql(spark):
    found = vector_codes(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    equals_sql(found, ORACLES["op12_vector_codes"], embeddings=SMALL)
