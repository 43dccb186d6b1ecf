"""Stage tables: written results that later steps read instead of recomputing.

They live below one folder that every executor can reach, so a lost executor costs the rerun of
its tasks and never a result that was already written. A stage has versions: each write makes a folder
of its own, which a small pointer file publishes once it is complete, so a failed write leaves the last
version in place.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shoplens.sources.readers import read_table


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    # A local-cluster has executors of its own, as any cluster.
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="shoplens-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system, which any store that Spark reads has."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, sizes and times of all files below ``paths``; it changes when a file does."""
    found = []
    for path in paths:
        folder, system = _folder(spark, path)
        if system.exists(folder):
            files = system.listFiles(folder, True)
            while files.hasNext():
                status = files.next()
                found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


# What file-based tables name the folder of rows whose partition value is missing.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

# Pointer files: the highest number names the version in use.
_POINTER = re.compile(r"_published-(\d{10})-[0-9a-f]+")


class StageStore:
    """Reads and writes stage tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None, fmt: str = "parquet"):
        self.spark = spark
        self.fmt = fmt
        if root is None:
            root = f"{shared_folder(spark)}/shoplens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        self.root = root.rstrip("/")
        self._known: dict[str, tuple[str | None, DataFrame]] = {}

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointer files of a stage, the newest first."""
        folder, system = _folder(self.spark, f"{self.root}/{name}")
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return sorted(filter(_POINTER.fullmatch, names), reverse=True)

    def published(self, name: str) -> dict | None:
        """What the newest pointer says: ``version``, ``schema`` and ``inputs``; none before the first write ends."""
        pointers = self._pointers(name)
        return self._told(name, pointers[0]) if pointers else None

    def _told(self, name: str, pointer: str) -> dict:
        file, system = _folder(self.spark, f"{self.root}/{name}/{pointer}")
        stream = system.open(file)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, version: str, schema: T.StructType, inputs: str | None) -> None:
        """Make ``version`` the one that readers get; the one before stays for those that read it now."""
        before = self._pointers(name)
        number = int(_POINTER.fullmatch(before[0]).group(1)) + 1 if before else 0
        told = {"version": version, "schema": json.loads(schema.json()), "inputs": inputs, "format": self.fmt}
        draft, system = _folder(self.spark, f"{self.root}/{name}/_draft-{uuid.uuid4().hex}")
        stream = system.create(draft)
        try:
            stream.write(json.dumps(told).encode())
        finally:
            stream.close()
        final, _ = _folder(self.spark, f"{self.root}/{name}/_published-{number:010d}-{uuid.uuid4().hex[:8]}")
        if not system.rename(draft, final):
            raise OSError(f"stage {name} could not be published")
        for pointer in before[1:]:
            self._delete(f"{self.root}/{name}/{self._told(name, pointer)['version']}")
            self._delete(f"{self.root}/{name}/{pointer}")

    def path(self, name: str) -> str:
        """The folder of the version in use."""
        told = self.published(name)
        return f"{self.root}/{name}/{told['version']}" if told else f"{self.root}/{name}"

    def write(
        self,
        name: str,
        df: DataFrame,
        partition_by: str | None = None,
        order_by: list[str] | None = None,
        inputs: str | None = None,
        derive: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Write a new version of stage ``name``, publish it and return it as read back.

        A version is published when all of its files are complete, so readers and a failed or repeated write
        never meet half of it. ``inputs`` is a fingerprint of what it was made from.

        With ``order_by`` rows are sorted over all files, in the order of the file names.

        With ``partition_by`` the rows are first rebalanced on that column, which gives each
        value few large files, and splits a value that holds a large share of the rows. They are sorted
        by it there, as the writer wants them. ``derive`` adds columns row by row that follow from the others
        and leaves that column as it is: they are made behind the exchange and the sort, which take narrow rows.
        """
        schema = (derive(df) if derive else df).schema
        if partition_by:
            if schema[partition_by].dataType == T.StringType():
                # A column without gaps is written in the order given; else the writer sorts the whole rows anew.
                # Empty text goes to the same folder as a gap, so it has to be next to it.
                df = df.withColumn(partition_by, F.coalesce(F.nullif(partition_by, F.lit("")), F.lit(_NO_VALUE)))
            df = df.hint("rebalance", partition_by).sortWithinPartitions(partition_by)
        if derive:
            df = derive(df)
        if order_by:
            df = df.orderBy(*order_by)
        writer = df.write.mode("overwrite").format(self.fmt)
        if self.fmt == "csv":
            # Nothing is trimmed, and empty text differs from a gap, so that text reads back as it was.
            writer = writer.options(
                header="true",
                timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS",
                escape='"',
                emptyValue='""',
                nullValue="\\N",
                ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false",
            )
        if partition_by:
            writer = writer.partitionBy(partition_by)
        version = f"version-{uuid.uuid4().hex}"
        writer.save(f"{self.root}/{name}/{version}")
        self._publish(name, version, schema, inputs)
        return self.read(name, schema)

    def read(self, name: str, schema: T.StructType, made_by: str | None = None) -> DataFrame:
        """Stage ``name`` in the version that was published last, with its columns in schema order."""
        if self.published(name) is None:
            hint = f" Run {made_by} first." if made_by else ""
            raise FileNotFoundError(f"No data at {self.root}/{name}.{hint}")
        return read_table(self.spark, self.path(name), schema, self.fmt, made_by).select(schema.fieldNames())

    def table(
        self,
        name: str,
        build: Callable[[], DataFrame],
        partition_by: str | None = None,
        inputs: str | None = None,
        derive: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Stage ``name``, built at its first use and then shared by every caller of this store.

        With ``inputs``, the fingerprint of what ``build`` reads, a version that was made from the same
        inputs is read instead, also one of an earlier application, and other inputs build a new one.
        """
        known = self._known.get(name)
        if known is None or known[0] != inputs:
            told = self.published(name) if inputs else None
            if told and told["inputs"] == inputs:
                table = self.read(name, T.StructType.fromJson(told["schema"]))
            else:
                table = self.write(name, build(), partition_by, inputs=inputs, derive=derive)
            self._known[name] = known = (inputs, table)
        return known[1]

    def scratch(self, label: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write an intermediate result once, as Parquet under a name of its own."""
        path = f"{self.root}/scratch/{label}-{uuid.uuid4().hex}"
        if partition_by:
            df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
        else:
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(df.columns)

    def _delete(self, path: str) -> None:
        folder, system = _folder(self.spark, path)
        system.delete(folder, True)

    def clear_scratch(self) -> None:
        """Delete the scratch tables of this store, once the results that read them are written."""
        self._delete(f"{self.root}/scratch")

    @contextmanager
    def request(self) -> Iterator[StageStore]:
        """A store for the intermediate tables of one request; they go when the block ends.

        Collect or write the results inside the block. Other requests keep their tables.
        """
        own = StageStore(self.spark, f"{self.root}/request-{uuid.uuid4().hex}", self.fmt)
        try:
            yield own
        finally:
            own._delete(own.root)


def pinned(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Keep loaded stage tables for repeated interaction, spilling to disk what does not fit."""
    return tuple(table.persist() for table in tables)
