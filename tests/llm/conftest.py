from __future__ import annotations

import re

import duckdb
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
LICENCE = "Licensed under some open licence."
AWKWARD = [
    (1, "Some plain text, with words enough to pass every rule that there is. It goes on for a while yet, quietly. " * 1, "en", "src0"),
    (2, None, "en", "src0"),
    (3, "", None, None),
    (4, " \n\t ", "de", "src1"),
    (5, "café Été \U0001f600 naïve x\r\n second line here with twenty code points\n", "fr", "src1"),
    (6, "Same line over and over again\nSame line over and over again\nother", "en", "src2"),
    (7, "  SAME LINE over and over again \n\nsomething else entirely, but not so short", "en", "src2"),
    (8, "same line over and over again", "xx", "src3"),
    (9, LONG, "en", "src0"),
    (10, LONG + " tail", "en", "src0"),
    (11, "a b c d e f g h a b c d e f g h # $ % ! ! !", "es", "src4"),
    (12, "Aaaa bb c", "en", "src0"),
    (13, "aaaa BB c", "en", "src0"),
    (13, "aaaa BB c", "en", "src0"),
    (13, "another text under the same id", "en", "src0"),
    (None, "a text without any id", "en", None),
    (None, None, None, None),
    (14, "Don't <|endoftext|> it's 12.5\x1cd, 가ᄀ é. İ.", "en", "src0"),
    (15, "one two three four five " * 30 + "\n" + LICENCE, "en", "src5"),
    (16, "x" * 5000, "en", "src0"),
    (17, "with | pipes | in | it", "en", "src0"),
]


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) as documents with columns whose names clash with those that operators use."""
    full = [(i, t, lang, source, None if t is None else len(t), 7, "x", 1) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCUMENTS + ", _id long, fingerprint string, features int").repartition(3)


@pytest.fixture
def awkward(spark):
    return frame(spark, AWKWARD)


@pytest.fixture
def nothing(spark):
    return frame(spark, AWKWARD).where("false")


def words(text):
    return WORD.findall(text or "")


def equals_sql(found, sql, **tables):
    """Columns and rows of ``found`` are those of the SQL over ``table=folder``; not one column more or less."""
    con = duckdb.connect()
    for table, folder in tables.items():
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(names).collect()), key=str) == sorted(cursor.fetchall(), key=str)
