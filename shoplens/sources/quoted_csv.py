"""CSV files with line breaks inside quotes, read by as many tasks as their size asks for.

Spark splits such a file by lines only if no record has several. Here lines are read instead, and quotes are counted:
a line begins a record if the quotes before it in the file are even in number. A task does not know how many there are
before its split, so it notes what holds in either case; the splits are then added up, one row each, and say which case
it is. Records of one line, nearly all, stay where they are; only lines of longer ones are moved to be joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shoplens.sources.stages import StageStore

_LINE = "_file string, _block bigint, _row bigint, line string, odd int, start_even bigint, start_odd bigint"
NO_START = -1


def _with_starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to each line whether its quotes are odd, and where its record begins in the split in either case.

    ``start_even`` holds if the quotes before the split are even. A record that began before the split has no start.
    """
    split, seen, last = None, 0, [NO_START, NO_START]
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, row, line = (batch.column(i) for i in range(4))
        blocks, rows = block.to_numpy(), row.to_numpy()
        quotes = pc.count_substring(line, '"').to_numpy().astype(np.int64)
        starts = np.empty((2, len(rows)), np.int64)
        new = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (blocks[1:] != blocks[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
        for low, high in zip(edges, edges[1:]):
            if split != (here := (file[low].as_py(), int(blocks[low]))):
                split, seen, last = here, 0, [NO_START, NO_START]
            total = seen + np.cumsum(quotes[low:high])
            before = (total - quotes[low:high]) & 1
            for case in (0, 1):
                own = np.where(before == case, rows[low:high], NO_START)
                own[0] = max(own[0], last[case])
                starts[case, low:high] = np.maximum.accumulate(own)
                last[case] = int(starts[case, high - 1])
            seen = int(total[-1]) & 1
        columns = [file, block, row, line, pa.array((quotes & 1).astype(np.int32)), pa.array(starts[0]), pa.array(starts[1])]
        yield pa.RecordBatch.from_arrays(columns, ["_file", "_block", "_row", "line", "odd", "start_even", "start_odd"])


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: quotes before it, the record that is open at its beginning, and the header of its file."""
    filled = F.trim(F.rtrim(F.translate("line", "\r", ""))) != ""
    row = F.col("_row")

    def of_case(start: str):
        return F.struct(
            F.nullif(F.max(start), F.lit(NO_START)).alias("last"),
            F.min(F.when(filled & (F.col(start) == row), row)).alias("first"),
        ).alias(start)

    splits = lines.groupBy("_file", "_block").agg((F.sum("odd") % 2).alias("odd"), of_case("start_even"), of_case("start_odd"))
    file = Window.partitionBy("_file")
    earlier = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({
        "odd_before": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1,
        "unclosed": F.sum("odd").over(file) % 2 == 1,
    })
    case = F.when(F.col("odd_before"), F.col("start_odd")).otherwise(F.col("start_even"))
    splits = splits.select("_file", "_block", "odd_before", "unclosed", case.alias("case"))

    def at(name: str):
        place = F.struct(F.col("_block").alias("block"), F.col(f"case.{name}").alias("row"))
        return F.when(F.col(f"case.{name}").isNotNull(), place)

    message = F.concat(F.lit("a quote is not closed in "), F.col("_file"))
    return splits.select(
        "_file",
        "_block",
        F.when(F.col("unclosed"), F.raise_error(message).cast("boolean")).otherwise(F.col("odd_before")).alias("odd_before"),
        F.last(at("last"), ignorenulls=True).over(earlier).alias("open"),
        F.min(at("first")).over(file).alias("header"),
    )


def read_quoted(lines: DataFrame, schema: T.StructType, options: dict[str, str], store: StageStore) -> DataFrame:
    """Fields of ``schema`` and the file position of each record, that of its first line.

    ``lines`` has ``line`` and the input order, straight from Spark's text reader. The first record of a file that is
    not blank is its header; blank lines between records are skipped; files without records give no row. A line break
    inside quotes stays as it is, ``\\r\\n`` too. Quotes may
    occur only around a field or doubled inside one, as CSV writers place them; a file with an unclosed quote raises,
    and so does a record with more or fewer fields than ``schema``. Lines are written to ``store`` once, since a
    second read could be split in another way. A record has to fit a task, a file does not.
    """
    ordered = lines.select("_file", "_block", "_row", "line")
    lines = store.scratch("csv-lines", ordered.mapInArrow(_with_starts, _LINE))
    # No hint: Spark broadcasts the splits while their table is small, and else sends each split's lines to one task.
    placed = lines.join(store.scratch("csv-splits", _splits(lines)), ["_file", "_block"])
    start = F.when(F.col("odd_before"), F.col("start_odd")).otherwise(F.col("start_even"))
    here = F.struct(F.col("_block").alias("block"), start.alias("row"))
    placed = placed.withColumn("record", F.when(start != NO_START, here).otherwise(F.col("open")))
    alone = (start == F.col("_row")) & (F.col("odd") == 0)
    place = ["_file", F.col("record.block").alias("_block"), F.col("record.row").alias("_row")]
    placed = placed.where(F.col("record") != F.col("header"))
    text = F.regexp_replace("line", "\r$", "")
    single = placed.where(alone).select(*place, text.alias("line")).where(F.trim("line") != "")
    part = F.struct(F.col("_block").alias("b"), F.col("_row").alias("r"), F.col("line").alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "\n")
    several = placed.where(~alone).select(*place, part.alias("part")).groupBy("_file", "_block", "_row").agg(joined.alias("line"))
    records = single.unionByName(several.withColumn("line", text))
    fields = F.from_csv("line", schema.simpleString()[len("struct<"):-1].replace(":", " "), options)
    return records.select(fields.alias("f"), "_file", "_block", "_row").select("f.*", "_file", "_block", "_row")
