"""Readers of raw inputs and stage tables, with the guard against missing paths."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from shoplens.sources.schemas import CUSTOMERS_RAW, TRANSACTIONS_RAW

if TYPE_CHECKING:
    from shoplens.sources.stages import StageStore

# File position of a row: which file, which split of it, and the running number inside the
# split. Comparing the three gives file order without moving all rows to one place.
INPUT_ORDER = ["_file", "_block", "_row"]

# Quotes inside a field are doubled, as CSV writers do.
_CSV_OPTIONS = {"header": "true", "mode": "FAILFAST", "quote": '"', "escape": '"'}
# Stage tables are read back as they were written: empty text is quoted, a gap is nothing.
_STAGE_OPTIONS = _CSV_OPTIONS | {
    "dateFormat": "yyyy-MM-dd",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "emptyValue": "",
    "nullValue": "\\N",
    "multiLine": "true",
}


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", made_by: str | None = None
) -> DataFrame:
    """Read ``path`` with a fixed schema; a missing path names the step that produces it."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**_STAGE_OPTIONS)
    return _loaded(reader, path, made_by)


def _loaded(reader: DataFrameReader, path: str, made_by: str | None) -> DataFrame:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        hint = f" Run {made_by} first." if made_by else ""
        raise FileNotFoundError(f"No data at {path}.{hint}") from error


def exact(column: str, kind: T.DataType) -> Column:
    """A column of any type as ``kind``; a number that would be rounded raises instead."""
    given = F.col(column)
    if isinstance(kind, (T.IntegerType, T.DecimalType)):
        wide = given.cast("decimal(38,18)")
        cast = wide.cast(kind)
        message = F.concat(F.lit(f"{column} does not fit {kind.simpleString()}: "), given.cast("string"))
        return F.when(wide == cast.cast("decimal(38,18)"), cast).when(given.isNotNull(), F.raise_error(message).cast(kind))
    return given.cast(kind)


def read_raw(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str,
    made_by: str,
    multi_line: bool = False,
    store: StageStore | None = None,
) -> DataFrame:
    """A raw table in the types of ``schema``, with its input order.

    CSV fields are read as text and then cast: whole numbers may be printed as ``2.0``, days may have
    a time, seconds a fraction. What cannot be cast, or only with loss, raises.

    ``multi_line`` accepts line breaks inside quotes; the lines of such files are written once, to ``store``
    or below the shared folder, and files are split as others are.
    """
    names = schema.fieldNames()
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if fmt == "csv" and multi_line:
        # The stage store reads its tables through this module.
        from shoplens.sources.quoted_csv import read_quoted
        from shoplens.sources.stages import StageStore

        lines = _loaded(spark.read.option("lineSep", "\n").format("text"), path, made_by)
        lines = with_input_order(lines.withColumnRenamed("value", "line"))
        options = {key: value for key, value in _CSV_OPTIONS.items() if key != "header"}
        rows = read_quoted(lines, texts, options, store or StageStore(spark))
    else:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.schema(texts).options(**_CSV_OPTIONS)
        rows = with_input_order(_loaded(reader, path, made_by))
    if fmt == "csv":
        numbers = [f.name for f in schema if not isinstance(f.dataType, T.StringType)]
        rows = rows.withColumns({name: F.nullif(F.trim(name), F.lit("")) for name in numbers})
    return rows.select(*[exact(f.name, f.dataType).alias(f.name) for f in schema], *INPUT_ORDER)


def with_input_order(df: DataFrame) -> DataFrame:
    """Add the :data:`INPUT_ORDER` columns to a DataFrame read straight from files."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers arrive as NaN from some writers; keep one kind of missing value."""
    return df.select(
        [
            F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def read_customers(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, store: StageStore | None = None
) -> DataFrame:
    """Raw customers, 7 columns plus the input order; ``multi_line`` accepts line breaks inside quoted fields."""
    return nan_to_null(read_raw(spark, path, CUSTOMERS_RAW, fmt, "the customer extract", multi_line, store))


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, store: StageStore | None = None
) -> DataFrame:
    """Raw transactions, 9 columns plus the input order; ``multi_line`` accepts line breaks inside quoted fields."""
    return read_raw(spark, path, TRANSACTIONS_RAW, fmt, "the transaction extract", multi_line, store)
