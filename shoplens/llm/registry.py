"""Registered queries of the corpus operators, each over a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shoplens.llm.exact_dedup import exact_dedup
from shoplens.llm.line_dedup import line_dedup
from shoplens.llm.mixing import mix_sources
from shoplens.llm.oracles import ORACLES
from shoplens.llm.packing import pack_documents
from shoplens.llm.ppm import ppm_scores
from shoplens.llm.quality_ranking import quality_ranking
from shoplens.llm.quality_rules import quality_rules, rule_ablations
from shoplens.llm.sharding import hash_tree_shards
from shoplens.llm.simhash import simhash_components
from shoplens.llm.token_alignment import token_alignment
from shoplens.llm.toxicity import toxicity
from shoplens.llm.vector_codes import vector_codes
from shoplens.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*[spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables])


QUERIES: dict[str, Query] = {
    "op1_mix_sources": _over(mix_sources, "documents"),
    "op2_quality_ranking": _over(quality_ranking, "documents", "labels"),
    "op3_exact_dedup": _over(exact_dedup, "documents"),
    "op4_quality_rules": _over(quality_rules, "documents"),
    "rule_ablations": _over(rule_ablations, "documents"),
    "op5_hash_tree_shards": _over(hash_tree_shards, "documents"),
    "op6_warc": _over(warc_round_trip, "pages"),
    "op7_ppm_scores": _over(ppm_scores, "documents"),
    "op8_line_dedup": _over(line_dedup, "documents"),
    "op9_simhash": _over(simhash_components, "documents"),
    "op10_packing": _over(pack_documents, "documents"),
    "op11_toxicity": _over(toxicity, "documents", "labels"),
    "op12_vector_codes": _over(vector_codes, "embeddings"),
    "op13_token_alignment": _over(token_alignment, "documents"),
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = dict(ORACLES)
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["QUERIES", "SQL"]
