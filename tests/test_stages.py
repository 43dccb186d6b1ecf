"""Stage tables: formats, partitioning, sharing and the folder they live in."""

from __future__ import annotations

import os
import re
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from shoplens.__main__ import main
from shoplens.operators.slicing import DashboardFilter
from shoplens.plans.dashboard import dashboard, load_stages
from shoplens.plans.processing import clean_and_process, enrich_transactions
from shoplens.plans.segmentation import segment
from shoplens.sources import star_schema
from shoplens.sources.schemas import SEGMENTED, TRANSACTIONS_CLEAN, with_customer_key
from shoplens.sources.stages import StageStore, fingerprint, pinned, shared_folder
from shoplens.workspace import Workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    return Workspace(spark, FOLDER, StageStore(spark, str(tmp_path_factory.mktemp("work"))))


def test_stages_are_built_once(work):
    assert work.transactions() is work.transactions()


def test_transactions_are_partitioned_by_month(work):
    months = {r["year_month"] for r in work.transactions().select("year_month").distinct().collect()}
    folders = {f.split("=")[1] for f in os.listdir(work.store.path("cleaned_transactions")) if "=" in f}
    assert folders == months
    assert work.transactions().columns == TRANSACTIONS_CLEAN.fieldNames()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, work, fmt):
    store = StageStore(spark, str(tmp_path / "out"), fmt)
    for name, table in {"tx": work.transactions(), "profiles": work.profiles()}.items():
        back = store.write(name, table)
        assert back.schema.simpleString() == table.schema.simpleString()
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_awkward_text_round_trips(spark, tmp_path, fmt):
    store = StageStore(spark, str(tmp_path / "out"), fmt)
    values = [" lead", "trail ", "", None, 'a "quoted" word', "comma, here", "two\nlines", "back\\slash", "\\N", '"']
    rows = [(i, v, datetime(2025, 1, 1, 10, 0, 0, 750_000 + i)) for i, v in enumerate(values) if v != "\\N" or fmt == "parquet"]
    table = spark.createDataFrame(rows, "i int, v string, t timestamp_ntz")
    assert sorted(map(tuple, store.write("t", table).collect())) == rows


def test_a_request_leaves_no_folder(spark, store, work):
    with store.request() as own:
        tables = dashboard(work.transactions(), work.segmented_by_centres(), DashboardFilter(), own)
        assert tables["kpi_cards"].first()["total_orders"] > 0
        assert os.path.exists(own.root)
    assert not os.path.exists(own.root)
    with pytest.raises(RuntimeError), store.request() as own:
        own.scratch("x", spark.range(3))
        raise RuntimeError
    assert not os.path.exists(own.root)


def test_scratch_is_cleared_and_stages_stay(spark, store):
    store.write("kept", spark.range(3))
    gone = store.scratch("gone", spark.range(3))
    assert gone.count() == 3
    store.clear_scratch()
    assert not os.path.exists(store.path("scratch"))
    assert spark.read.parquet(store.path("kept")).count() == 3
    store.clear_scratch()


def test_a_stage_may_be_sorted(spark, store):
    back = store.write("sorted", spark.range(1000, 0, -1).repartition(4), order_by=["id"])
    files = sorted(f for f in os.listdir(store.path("sorted")) if f.endswith(".parquet"))
    read = [r["id"] for f in files for r in spark.read.parquet(f"{store.path('sorted')}/{f}").collect()]
    assert read == list(range(1, 1001)) and back.count() == 1000


def test_overwrite_replaces_the_stage(spark, store):
    store.write("t", spark.range(5))
    assert store.write("t", spark.range(2)).count() == 2


def test_raw_tables_run_through_the_whole_pipeline(spark, tmp_path, work):
    """Raw files with integer keys, written by us, processed, segmented and loaded for reports."""
    store = StageStore(spark, str(tmp_path / "stages"))
    raw_tx = work.raw_transactions()
    order = raw_tx.columns[1:]
    tx, profiles = clean_and_process(work.raw_customers(), raw_tx, store, ["join_date"], order)
    assert tx.count() == work.transactions().count()
    store.write("segmented_customers", segment(profiles, store))
    key = T.LongType()
    back = store.read("segmented_customers", with_customer_key(SEGMENTED, key))
    assert back.count() == work.customers().count()
    with pytest.raises(FileNotFoundError, match="clean_and_process"):
        load_stages(StageStore(spark, str(tmp_path / "nothing")))


@pytest.mark.parametrize("name", ["spark://somewhere:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(name):
    class Context:
        master = name

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_commands(spark, tmp_path, capfd, fmt):
    raw = tmp_path / "raw"
    raw.mkdir()
    customers = ["customer_id,age,gender,annual_income,location,join_date,satisfaction_score"]
    lines = [
        "transaction_id,customer_id,transaction_date,product_category,product_name,quantity,price,"
        "discount_applied,payment_method"
    ]
    for i in range(40):
        customers.append(f"C{i:02},{20 + i},Female,{1000 * i},Ohio,2024-01-01,{1 + i % 5}")
        for j in range(i % 8):
            day = f"2025-{1 + (i + j) % 12:02}-{1 + i % 28:02} 00:00:00"
            lines.append(f"T{i}-{j},C{i:02},{day},A,a{j},{1 + j},{10 + i}.50,0.10,Cash")
    (raw / "customers.csv").write_text("\n".join(customers) + "\n")
    (raw / "transactions.csv").write_text("\n".join(lines) + "\n")
    stages = str(tmp_path / "stages")
    main(["process", str(raw), stages, "--format", fmt])
    main(["segment", stages, "--format", fmt])
    shown = capfd.readouterr().out
    assert "VIP Spenders" in shown and "Never Purchased" in shown and "Inactive" in shown
    tx, segmented = load_stages(StageStore(spark, stages, fmt), pin=True)
    assert (tx.count(), segmented.count()) == (len(lines) - 1, 40)
    # The facts stay files.
    assert not tx.storageLevel.useMemory and segmented.storageLevel.useMemory
    segmented.unpersist()


def test_pinned_tables_stay_loaded(work):
    tx, customers = pinned(work.transactions(), work.profiles())
    assert tx.storageLevel.useMemory and customers.storageLevel.useDisk
    tx.unpersist()
    customers.unpersist()


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = shared_folder(spark)
    assert configured is None or folder == configured
    assert shared_folder(spark) == folder or spark.sparkContext.getCheckpointDir() == shared_folder(spark)
    assert StageStore(spark).root.startswith(shared_folder(spark))


def test_a_failed_write_leaves_the_last_version(spark, store):
    store.write("t", spark.range(5).withColumn("v", F.lit("old")))
    before = store.path("t")
    broken = spark.range(5).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).otherwise("new"))
    with pytest.raises(Exception, match="broken"):
        store.write("t", broken)
    assert store.path("t") == before
    assert {r["v"] for r in store.read("t", T.StructType.fromJson(store.published("t")["schema"])).collect()} == {"old"}
    with pytest.raises(Exception, match="broken"):
        store.write("first", broken)
    with pytest.raises(FileNotFoundError, match="Run that first"):
        store.read("first", broken.schema, "that")


def test_readers_keep_the_version_they_opened(spark, store):
    """A new version neither moves nor removes what a reader of the last one has open; older ones go."""
    versions = [store.write("t", spark.range(n + 1)) for n in range(3)]
    assert [t.count() for t in versions[1:]] == [2, 3]
    folders = [f for f in os.listdir(os.path.dirname(store.path("t"))) if f.startswith("version-")]
    assert len(folders) == 2


def test_changed_inputs_build_a_new_version(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)

    def rows(store):
        inputs = fingerprint(spark, [source])
        return store.table("t", lambda: spark.read.parquet(source), inputs=inputs).count(), store.path("t")

    store = StageStore(spark, root)
    first = rows(store)
    assert first[0] == 3 and rows(store) == first and rows(StageStore(spark, root)) == first
    spark.range(4).write.mode("append").parquet(source)
    again = rows(store)
    assert again[0] == 7 and again[1] != first[1]


def test_a_changed_folder_gets_a_new_workspace(spark, tmp_path):
    folder = str(tmp_path / "sf")
    shutil.copytree(FOLDER, folder, ignore=lambda _, names: [n for n in names if n.split(".")[0] not in star_schema.TABLES])
    os.chmod(folder, 0o755)
    first = entry.workspace(spark, folder)
    assert entry.workspace(spark, folder) is first
    os.utime(f"{folder}/orders.parquet", (1, 1))
    assert entry.workspace(spark, folder) is not first


def test_derived_columns_are_made_behind_the_exchange(spark, store):
    """What follows from other columns is neither exchanged nor sorted; a missing or empty key is read as missing."""
    rows = [(1, "2024-01"), (2, None), (3, "2024-02"), (4, ""), (5, "2024-01"), (6, None)]
    seen = []

    def derive(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.select("id", (F.col("id") * 10).alias("ten"), "year_month")

    months = spark.createDataFrame(rows, "id long, year_month string")
    stage = store.write("tx", months, partition_by="year_month", derive=derive)
    assert re.search(r"^Sort \[year_month.*\], false\n.*RebalancePartitions \[year_month", seen[-1])
    assert "ten" not in seen[-1] and stage.columns == ["id", "ten", "year_month"]
    assert sorted(map(tuple, stage.collect())) == [(i, 10 * i, m or None) for i, m in rows]
    assert stage.where("year_month is null").count() == 3


def test_the_stage_of_transactions_moves_no_derived_column(spark, tmp_path, monkeypatch):
    day = datetime(2024, 1, 31, 5)
    tables = {
        "lineitem": (
            [(1, 1, day, 1, 1, 2.0, 0.1), (1, 1, day, 1, 1, 2.0, 0.1), (1, 2, day, 2, 1, 1.0, None), (2, 1, day, 1, 1, None, 0.0)],
            "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_partkey long, l_suppkey long, l_quantity double, l_discount double",
        ),
        "orders": (
            [(1, 7, day, "1-URGENT", "F"), (2, None, None, None, "O")],
            "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_orderstatus string",
        ),
        "part": ([(1, "A", "x", 2.5), (2, None, "y", None)], "p_partkey long, p_type string, p_name string, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sf/{name}.parquet")
    moved = {}
    write = StageStore.write

    def noted(self, name, df, *args, **kwargs):
        moved[name] = df.columns
        return write(self, name, df, *args, **kwargs)

    monkeypatch.setattr(StageStore, "write", noted)
    w = Workspace(spark, str(tmp_path / "sf"), StageStore(spark, str(tmp_path / "own")))
    stage = w.transactions()
    assert not {"transaction_id", "revenue", "day_of_week", "season", "year"} & set(moved["cleaned_transactions"])
    expected = enrich_transactions(w.unique_transactions())
    assert stage.count() == 3 and stage.dtypes == expected.dtypes
    assert stage.exceptAll(expected).count() == 0 and expected.exceptAll(stage).count() == 0
