"""CSV with line breaks inside quotes, over many splits, against a CSV parser."""

from __future__ import annotations

import csv
import random

import pytest

from shoplens.sources.readers import INPUT_ORDER, read_customers
from shoplens.sources.schemas import CUSTOMERS_RAW

COLUMNS = CUSTOMERS_RAW.fieldNames()
PIECES = ["a", "Ohio", '"', '""', "\n", "\n\n", ",", " ", "x" * 40, "é", '",\n"']


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def _rows(seed: int, count: int) -> list[list[str]]:
    rng = random.Random(seed)

    def text():
        return "t" + "".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 6, 60]))) + "e"

    return [[f"c{i}", str(rng.randrange(90)), text(), "", text(), "2020-01-02", "3"] for i in range(count)]


def _write(path, rows, end="\n", columns=COLUMNS):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=end).writerows([columns, *rows])


def _read(spark, path, store):
    found = read_customers(spark, str(path), multi_line=True, store=store).orderBy(*INPUT_ORDER).collect()
    return found, [[r["customer_id"], r["gender"], r["location"]] for r in found]


@pytest.mark.parametrize("seed", range(3))
def test_rows_of_a_parser(spark, store, tmp_path, small_splits, seed):
    rows = _rows(seed, 120)
    _write(tmp_path / "raw.csv", rows)
    found, texts = _read(spark, tmp_path / "raw.csv", store)
    assert texts == [[r[0], r[2], r[4]] for r in rows]
    assert [r["age"] for r in found] == [float(r[1]) for r in rows] and all(r["annual_income"] is None for r in found)
    assert len({r["_block"] for r in found}) > 10


def test_a_record_longer_than_several_splits(spark, store, tmp_path, small_splits):
    long = "\n".join(f'line {i}, "{i}"' for i in range(300))
    rows = [["c1", "1", "F", "", "x", "", ""], ["c2", "2", long, "", long, "", ""], ["c3", "3", "M", "", "y", "", ""]]
    _write(tmp_path / "raw.csv", rows)
    assert _read(spark, tmp_path / "raw.csv", store)[1] == [[r[0], r[2], r[4]] for r in rows]


def test_files_headers_and_blank_lines(spark, store, tmp_path, small_splits):
    folder = tmp_path / "raw"
    folder.mkdir()
    first, second = _rows(7, 40), _rows(8, 40)
    _write(folder / "a.csv", first, columns=["id", "age\nin years", *COLUMNS[2:]])
    _write(folder / "b.csv", second)
    text = (folder / "b.csv").read_text(encoding="utf-8")
    (folder / "b.csv").write_text("\n \n" + text + "\n\n", encoding="utf-8")
    _write(folder / "c.csv", [])
    (folder / "d.csv").write_text("")
    assert _read(spark, folder, store)[1] == [[r[0], r[2], r[4]] for r in first + second]


def test_windows_line_ends(spark, store, tmp_path, small_splits):
    rows = [[f"c{i}", "1", "a,b", "", "Ohio", "2020-01-02", "3"] for i in range(50)]
    _write(tmp_path / "raw.csv", rows, end="\r\n")
    found, texts = _read(spark, tmp_path / "raw.csv", store)
    assert texts == [[r[0], r[2], r[4]] for r in rows] and {r["satisfaction_score"] for r in found} == {3.0}


def test_windows_line_ends_inside_quotes_stay(spark, store, tmp_path, small_splits):
    rows = [[f"c{i}", "1", "a\r\nb" * (i % 9), "", '"Ohio"\r\n', "", ""] for i in range(1, 60)]
    _write(tmp_path / "raw.csv", rows, end="\r\n")
    assert _read(spark, tmp_path / "raw.csv", store)[1] == [[r[0], r[2] or None, r[4]] for r in rows]


@pytest.mark.parametrize("bad", ['c1,1,"F,,x,,\n', "c1,1,F\n", "c1,1,F,,x,,,,\n"])
def test_malformed_files_raise(spark, store, tmp_path, bad):
    (tmp_path / "raw.csv").write_text(",".join(COLUMNS) + "\n" + bad)
    with pytest.raises(Exception, match="not closed|MALFORMED|Malformed"):
        _read(spark, tmp_path / "raw.csv", store)


def test_only_lines_of_longer_records_move(spark, store, tmp_path):
    _write(tmp_path / "raw.csv", _rows(1, 20))
    plan = read_customers(spark, str(tmp_path / "raw.csv"), multi_line=True, store=store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2 and "SortMergeJoin" not in plan and "MapInArrow" not in plan
