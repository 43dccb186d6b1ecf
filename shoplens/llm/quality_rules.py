"""Quality rules as a ledger of failure bits.

Each text is measured once and each rule is evaluated once; a document's failures are the bits of one
integer. Policies are masks over those bits, so a new version of a policy, or the question what one
rule contributes, needs the ledger only and no text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoplens.llm.common import fresh, raw_texts, written
from shoplens.llm.measures import MEASURES, in_batches, measured, repeated_windows

COLUMNS = [*MEASURES, "n_repeat_words"]

Rule = Callable[[Callable[[str], Column]], Column]

# A rule's place in this list is its bit; new rules go to the end. True means that the text fails.
RULES: dict[str, Rule] = {
    "few_words": lambda m: m("n_words") < 20,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "stutter": lambda m: 100 * m("n_adjacent") > 40 * m("n_words"),
    "capitals": lambda m: 100 * m("n_capitals") > 45 * m("word_chars"),
    "exclamations": lambda m: 4 * m("n_exclaims") > m("n_words"),
    "duplicate_lines": lambda m: 2 * m("n_dup_lines") > m("n_lines"),
    "word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words")),
}
BASE = ["few_words", "repeated_windows"]

# Versioned policies: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "v1": BASE,
    "v2": [*BASE, "symbols", "stutter", "capitals", "exclamations", "duplicate_lines"],
    "v3": list(RULES),
}
CURRENT = "v3"


def mask_of(rules: list[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(rule) for rule in set(rules))


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in COLUMNS]))
def _measures(text: pa.Array) -> pa.Array:
    columns: list[list[int]] = [[] for _ in MEASURES]
    windows = []
    for batch in in_batches(raw_texts(text)):
        words = [raw.split() for raw in batch]
        for raw, own in zip(batch, words):
            for column, value in zip(columns, measured(raw, own)):
                column.append(value)
        windows.append(repeated_windows(words))
    arrays = [pa.array(column, pa.int64()) for column in columns]
    arrays.append(pa.array(np.concatenate([np.zeros(0, np.int64), *windows]), pa.int64()))
    return pa.StructArray.from_arrays(arrays, COLUMNS)


def rule_ledger(docs: DataFrame, text: str = "text", ledger: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``ledger``: every measurement, and ``fail_bits``.

    Row by row, no shuffle. A null text counts as empty, which fails ``few_words`` alone. A column of
    the name ``ledger`` must not exist; choose another name then.
    """
    raw = fresh(docs, "_measures")
    bits = None
    for bit, rule in enumerate(RULES.values()):
        failed = F.when(rule(lambda name: F.col(f"{raw}.{name}")), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        bits = failed if bits is None else bits.bitwiseOR(failed)
    return (
        docs.withColumn(raw, _measures(F.col(text).cast("string")))
        .withColumn(ledger, F.struct(*[F.col(f"{raw}.{name}").alias(name) for name in COLUMNS], bits.alias("fail_bits")))
        .drop(raw)
    )


def passes(fail_bits: Column, rules: list[str]) -> Column:
    return fail_bits.bitwiseAND(F.lit(mask_of(rules)).cast("bigint")) == 0


def apply_policies(ledger: DataFrame, fail_bits: str = "fail_bits", versions: list[str] | None = None) -> DataFrame:
    """The verdict of each policy version as a column ``kept_<version>``."""
    return ledger.withColumns(
        {f"kept_{version}": passes(F.col(fail_bits), POLICIES[version]) for version in versions or POLICIES}
    )


def ablations(ledger: DataFrame, version: str = CURRENT, fail_bits: str = "fail_bits") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects, which leaving it out would keep.

    Rows collapse to one count per pattern of bits first (at most two to the number of rules).
    """
    return _ablations(ledger.groupBy(F.col(fail_bits).alias("fail_bits")).agg(F.count("*").alias("docs")), version)


def _ablations(counts: DataFrame, version: str) -> DataFrame:
    mask = mask_of(POLICIES[version])
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    patterns = counts.groupBy(bits.alias("bits")).agg(F.sum("docs").alias("docs"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("bigint").alias("bit")) for r in POLICIES[version]])
    return (
        patterns.withColumn("r", F.explode(rules))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("docs")).otherwise(0)).alias("rejected_by_it_alone"),
        )
    )


def reject_low_quality(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass a policy, with their columns as they are. An empty table stays empty."""
    ledger = fresh(docs, "_ledger")
    judged = rule_ledger(docs, text, ledger)
    return judged.where(passes(F.col(f"{ledger}.fail_bits"), POLICIES[version])).drop(ledger)


def quality_rules(documents: DataFrame) -> DataFrame:
    """The ledger of every document with the verdicts of the current policy and of each version.

    Null texts count as empty. Every row gives one row, also repeated ones; an empty table gives none.
    """
    judged = rule_ledger(documents.select("doc_id", "text")).select("doc_id", "ledger.*")
    return apply_policies(judged).select(
        "doc_id",
        *COLUMNS,
        "fail_bits",
        (~passes(F.col("fail_bits"), BASE)).alias("base_failed"),
        F.col(f"kept_{CURRENT}").alias("kept"),
        *[f"kept_{version}" for version in POLICIES],
    )


def rule_ablations(documents: DataFrame) -> DataFrame:
    """``ablations`` of every policy version over the whole table, with the version as first column; texts are read once.

    An empty table gives no rows.
    """
    patterns = rule_ledger(documents.select("text")).groupBy(F.col("ledger.fail_bits").alias("fail_bits")).agg(F.count("*").alias("docs"))
    patterns = written(patterns, "fail-bits")
    found = None
    for version in POLICIES:
        rows = _ablations(patterns, version).select(F.lit(version).alias("version"), "rule", "failed", "rejected_by_it_alone")
        found = rows if found is None else found.unionByName(rows)
    return found
