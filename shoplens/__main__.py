"""The pipeline steps as commands, for spark-submit or plain Python:

python -m shoplens process RAW_FOLDER STAGE_FOLDER
python -m shoplens segment STAGE_FOLDER
"""

from __future__ import annotations

import argparse

from shoplens.plans.pipeline import process_files, segment_files
from shoplens.plans.reports import cluster_distribution, rfm_distribution
from shoplens.session import build_session
from shoplens.sources.stages import StageStore


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shoplens")
    steps = parser.add_subparsers(dest="step", required=True)
    process = steps.add_parser("process", help="write cleaned transactions and customer profiles")
    process.add_argument("raw", help="folder with customers and transactions")
    process.add_argument("--raw-format", default="csv", choices=["csv", "parquet"])
    segment = steps.add_parser("segment", help="write segmented customers and show the group sizes")
    for step in (process, segment):
        step.add_argument("stages", help="folder of the stage tables")
        step.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    given = parser.parse_args(arguments)

    spark = build_session()
    store = StageStore(spark, given.stages, given.format)
    try:
        if given.step == "process":
            process_files(spark, given.raw, store, given.raw_format)
        else:
            segmented = segment_files(store)
            cluster_distribution(segmented).show(truncate=False)
            rfm_distribution(segmented).show(truncate=False)
    finally:
        store.clear_scratch()


if __name__ == "__main__":
    main()
