"""Product codes of vectors, by equal-average nearest entry search.

Vectors become whole numbers and are cut into equal parts. Each part position has a codebook of up to 256
entries, refined by a fixed number of rounds of assignment and averaging. The nearest entry of a part is
found along the entries sorted by their component sum: no entry whose sum differs by g is nearer than
g * g / dimension, so the search goes outward from the part's own sum until that exceeds the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shoplens.llm.common import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
MOST_LONG = (1 << 63) - 1
# Vectors that are searched together.
ROWS_AT_ONCE = 8_192
# Labels whose sums are sent to every task; more of them are joined by an exchange.
MOST_BROADCAST = 100_000

Codebook = np.ndarray


def nearest_entries(points: np.ndarray, entries: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, the lower index among equals.

    All points expand side by side; in each step a point looks at the entry whose sum is next nearest to its
    own, and is done once the squared gap of that sum, divided by the dimension, exceeds its best distance.
    """
    count, width = points.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, last = sums[order], len(order)
    own = points.sum(axis=1)
    above = np.searchsorted(sums, own)
    below = above - 1
    index = np.full(count, -1)
    best = np.zeros(count, points.dtype)
    active = np.arange(count)
    while len(active):
        low, high, mine = below[active], above[active], own[active]
        down = mine - sums[np.maximum(low, 0)]
        up = sums[np.minimum(high, last - 1)] - mine
        lower = (high >= last) | ((low >= 0) & (down <= up))
        gap = np.where(lower, down, up)
        left = (low >= 0) | (high < last)
        going = left & ((index[active] < 0) | (gap * gap <= best[active] * width)).astype(bool)
        active, lower, low, high = active[going], lower[going], low[going], high[going]
        entry = order[np.where(lower, low, high)]
        below[active] = low - lower
        above[active] = high + ~lower
        difference = points[active] - entries[entry]
        distance = (difference * difference).sum(axis=1)
        nearer = (index[active] < 0) | (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
        nearer = nearer.astype(bool)
        index[active[nearer]] = entry[nearer]
        best[active[nearer]] = distance[nearer]
    return index, best


def _exact(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` in a type that holds squared distances and sum gaps: Python integers where 64 bits do not."""
    safe = (1 << 31) // (2 * max(width, 1))
    return values if values.dtype == object or not values.size or np.abs(values.astype(float)).max() < safe else values.astype(object)


def _assigned(column: pa.ListArray, books: list[Codebook]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part position its points, their entries and distances."""
    width = books[0].shape[1]
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    for part, book in enumerate(books):
        points = values[:, part * width : (part + 1) * width]
        wide = _exact(points, width).dtype == object or _exact(book, width).dtype == object
        kind = object if wide else np.int64
        points, book = points.astype(kind), book.astype(kind)
        yield points, *nearest_entries(points, book)


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _sums_by_entry(books: list[Codebook]):
    """Of each task one row per used entry: how many parts it got, and their sum by component."""
    width = books[0].shape[1]
    kind = pa.list_(pa.decimal128(38, 0))

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(book), np.int64) for book in books]
        totals: list[list] = [[0] * len(book) for book in books]
        for batch in _batches(batches):
            for part, (points, entry, _) in enumerate(_assigned(batch.column(0), books)):
                counts[part] += np.bincount(entry, minlength=len(books[part]))
                used, place = np.unique(entry, return_inverse=True)
                sums = np.zeros((len(used), width), points.dtype)
                np.add.at(sums, place, points)
                for own, row in zip(used.tolist(), sums.astype(object)):
                    totals[part][own] = totals[part][own] + row
        rows = [(part, entry) for part in range(len(books)) for entry in np.flatnonzero(counts[part]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in rows], pa.int32()),
                    pa.array([e for _, e in rows], pa.int32()),
                    pa.array([int(counts[p][e]) for p, e in rows], pa.int64()),
                    pa.array([[int(x) for x in totals[p][e]] for p, e in rows], kind),
                ],
                ["part", "entry", "n", "total"],
            )

    return add_up


def refined(vectors: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """One round: each entry becomes the floor of the mean of the parts it is nearest to; an unused one stays.

    ``vectors`` has a column of whole numbers. A task sends at most one row per entry, and the driver gets one.
    """
    width = books[0].shape[1]
    rows = vectors.mapInArrow(_sums_by_entry(books), "part int, entry int, n long, total array<decimal(38,0)>")
    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
    done = [book.astype(object) for book in books]
    for row in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        done[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    # Means lie between 64-bit numbers.
    return [book.astype(np.int64) for book in done]


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a whole, finite vector; its components become floor(1024 x) in column ``values``.

    Null vectors and those with a null, NaN or infinite component go. A shorter vector is filled up with
    zeros to the longest one, and that to a multiple of the number of parts. Numbers beyond 64 bits stay
    at their ends.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(v.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    kept = embeddings.where(x.isNotNull() & finite)
    width = kept.agg(F.max(F.size(x))).first()[0] or 0
    width = max(PARTS, -(-width // PARTS) * PARTS)
    scaled = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-9.3e18), F.least(F.lit(9.3e18), v * F.lit(float(SCALE))))))
    return kept.withColumn("values", F.concat(scaled, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size(x))))


def trained_codebooks(vectors: DataFrame, order: list[str], rounds: int = ROUNDS) -> list[Codebook]:
    """The codebook of each part position: the parts of the 256 first rows in ``order``, refined ``rounds`` times."""
    first = vectors.orderBy(*[F.col(c).asc_nulls_last() for c in order], "values").limit(ENTRIES).select("values").collect()
    if not first:
        return []
    start = np.array([row["values"] for row in first], np.int64)
    books = np.split(start, PARTS, axis=1)
    for _ in range(rounds):
        books = refined(vectors.select("values"), books)
    return books


def codebooks_sha256(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for row in book for x in row).encode()).hexdigest()


def encoded(vectors: DataFrame, books: list[Codebook]) -> DataFrame:
    """``vectors`` with ``code``, two hex digits per part, and ``error``, the squared distances added up.

    ``values`` must be the last column. An error beyond 64 bits stays at their end.
    """
    kept = vectors.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields[:-1]) + ", code string, error long"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            found = [(entry, distance) for _, entry, distance in _assigned(batch.column(len(kept)), books)]
            codes = np.column_stack([entry for entry, _ in found]).astype(np.uint8)
            errors = sum(distance.astype(object) for _, distance in found)
            columns = [batch.column(i) for i in range(len(kept))]
            columns.append(pa.array([bytes(row).hex() for row in codes]))
            columns.append(pa.array([min(int(e), MOST_LONG) for e in errors], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "code", "error"])

    return vectors.mapInArrow(encode, schema)


def _as_long(total: Column) -> Column:
    return F.least(total, F.lit(MOST_LONG).cast("decimal(38,0)")).cast("bigint")


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """Code, error and label error of every usable vector.

    Rows whose vector is null or has a null or non-finite component go (``whole_numbers`` says what becomes
    of other lengths). Null ids come last in the choice of the first entries, equal ids follow their
    vectors; repeated rows each count and each give a row. ``label_error`` adds up the errors of equal labels, nulls
    together. An empty table, or one without a usable vector, gives no rows.
    """
    named = embeddings.select("vec_id", "label", "embedding")
    vectors = written(whole_numbers(named).select("vec_id", "label", "values"), "vectors")
    books = trained_codebooks(vectors, ["vec_id"])
    key = embeddings.schema["vec_id"].dataType.simpleString()
    if not books:
        empty = f"vec_id {key}, code string, error long, label_error long, codebooks_sha256 string"
        return embeddings.sparkSession.createDataFrame([], empty)
    codes = written(encoded(vectors, books), "vector-codes")
    sums = written(codes.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= MOST_BROADCAST else sums
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", _as_long(F.col("_sum")).alias("label_error"), F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
