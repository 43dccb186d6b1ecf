"""Lines that many documents share.

Normalised lines are hashed and exploded once per document; a hash found in enough documents loses its
lines everywhere but in one document, and each text is put together again in the order of its lines.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shoplens.llm.common import CONTINUATION, fresh, raw_texts, text_of, written

MIN_POINTS = 20
MIN_DOCUMENTS = 3


def line_key(line: bytes, min_points: int) -> bytes | None:
    """Hash of the line stripped of ASCII white space and with A-Z lower-cased; none for a short line."""
    key = line.strip().lower()
    if len(key) < min_points or len(key.translate(None, CONTINUATION)) < min_points:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys_of(min_points: int):
    @F.arrow_udf("array<binary>")
    def keys(text: pa.Array) -> pa.Array:
        found = []
        for raw in raw_texts(text):
            own = {line_key(line, min_points) for line in raw.split(b"\n")}
            found.append([key for key in own if key is not None])
        return pa.array(found, pa.list_(pa.binary()))

    return keys


def _rebuilt(min_points: int):
    @F.arrow_udf("struct<text:string,n_dropped:bigint>")
    def rebuild(text: pa.Array, drop: pa.Array) -> pa.Array:
        texts, dropped = [], []
        for raw, keys in zip(raw_texts(text), drop.to_pylist()):
            if keys is None:
                texts.append(None)
                dropped.append(0)
                continue
            gone, lines = set(keys), raw.split(b"\n")
            kept = [line for line in lines if line_key(line, min_points) not in gone]
            texts.append(b"\n".join(kept))
            dropped.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64())], ["text", "n_dropped"]
        )

    return rebuild


def text_key(doc_id: str, text: str) -> Column:
    """A hash of the text where the id is null, else null: with the id it names a document."""
    return F.when(F.col(doc_id).isNull(), F.xxhash64(text_of(text)))


def shared_lines(docs: DataFrame, min_points: int, min_documents: int, doc_id: str, text: str) -> DataFrame:
    """Per document, named by id and ``text_key``, the keys of the lines that it loses.

    Documents are counted by distinct id, and each row without id counts; ids stand above rows without.
    The count adds up in two steps, by line and document and then by line, so that a line that a third of
    all documents have is spread over many tasks.
    """
    keys = docs.select(
        F.col(doc_id).alias("id"),
        text_key(doc_id, text).alias("own"),
        F.explode(_keys_of(min_points)(F.col(text).cast("string"))).alias("line"),
    )
    keys = written(keys, "line-keys")
    holders = keys.groupBy("line", "id", "own").agg(F.count("*").alias("rows"))
    count = F.sum(F.when(F.col("id").isNull(), F.col("rows")).otherwise(F.lit(1)))
    found = holders.groupBy("line").agg(count.alias("n"), F.max("id").alias("id_kept"), F.max("own").alias("own_kept"))
    frequent = written(found.where(F.col("n") >= min_documents).select("line", "id_kept", "own_kept"), "frequent-lines")
    keeps = F.col("id").eqNullSafe(F.col("id_kept")) & (F.col("id").isNotNull() | F.col("own").eqNullSafe(F.col("own_kept")))
    return keys.join(frequent, "line").where(~keeps).groupBy("id", "own").agg(F.collect_set("line").alias("lines"))


def drop_shared_lines(
    docs: DataFrame,
    min_points: int = MIN_POINTS,
    min_documents: int = MIN_DOCUMENTS,
    doc_id: str = "doc_id",
    text: str = "text",
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``; with ``counts``, lines before and lines dropped as well.

    Lines of at least ``min_points`` code points (stripped, A-Z lower-cased) in at least
    ``min_documents`` documents stay only in the largest id that has them. A null text counts as empty,
    one empty line. Repeated rows of one id are one document and each is rebuilt. Each row without id is a
    document of its own; a line that none but such rows have stays in one of them, and in its exact copies
    without id. Other columns stay.
    """
    key, own, lines, rebuilt = (fresh(docs, n) for n in ("_id", "_own", "_lines", "_rebuilt"))
    losses = shared_lines(docs, min_points, min_documents, doc_id, text).select(
        F.col("id").alias(key), F.col("own").alias(own), F.col("lines").alias(lines)
    )
    same = F.col(doc_id).eqNullSafe(F.col(key)) & text_key(doc_id, text).eqNullSafe(F.col(own))
    joined = docs.join(losses, same, "left")
    touched = F.when(F.col(lines).isNotNull(), F.col(text))
    whole = joined.withColumn(rebuilt, _rebuilt(min_points)(touched.cast("string"), F.col(lines)))
    before = F.char_length(text_of(text)) - F.char_length(F.replace(text_of(text), F.lit("\n"), F.lit(""))) + 1
    result = {text: F.coalesce(F.col(f"{rebuilt}.text"), text_of(text))}
    if counts:
        result |= {counts[0]: before.cast("bigint"), counts[1]: F.col(f"{rebuilt}.n_dropped")}
    return whole.withColumns(result).drop(key, own, lines, rebuilt)


def line_dedup(documents: DataFrame) -> DataFrame:
    """Lines, dropped lines and the digest of the remaining text of every document.

    Null and empty texts have one empty line. Rows of equal ids are one document to the counts and give a row
    each; rows without an id are documents of their own. An empty table gives no rows.
    """
    done = drop_shared_lines(documents.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
