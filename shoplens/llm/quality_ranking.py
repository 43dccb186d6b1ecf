"""Bradley-Terry ranking of documents by quality.

A document's strength is a weighted sum of text features. Weights are fitted on preference pairs (a
document marked good, one marked bad) by logistic loss on the difference of their features; the
verdict cuts the strengths at a quantile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shoplens.llm.common import id_remainder, raw_texts, written
from shoplens.llm.measures import MEASURES, measured

# Shares are divided by these values and cut at 1, so that one extreme text does not rule a weight.
SATURATION = {
    "stutter": 0.3,
    "symbols": 0.2,
    "exclamations": 0.3,
    "capitals": 0.3,
    "dup_lines": 0.5,
    "digits": 0.2,
    "stops": 0.5,
    "repeated_words": 0.7,
    "long_words": 10.0,
    "length": 10.0,
}
FEATURES = list(SATURATION)

MOST_PER_CLASS = 8_000
PAIRS_PER_BAD = 8
CUT = 0.7


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    table = np.array([measured(raw, raw.split()) for raw in raw_texts(text)], np.float64).reshape(-1, len(MEASURES))
    m = dict(zip(MEASURES, table.T))
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    shares = {
        "stutter": m["n_adjacent"] / words,
        "symbols": m["n_symbols"] / words,
        "exclamations": m["n_exclaims"] / words,
        "capitals": m["n_capitals"] / chars,
        "dup_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "digits": m["n_digits"] / chars,
        "stops": m["n_stops"] / words,
        # Distinct words grow with the square root of a long text.
        "repeated_words": 1 - np.minimum(1, m["n_distinct"] / np.minimum(words, 30 * np.sqrt(words))),
        "long_words": m["word_chars"] / words,
        "length": np.log1p(m["n_words"]),
    }
    rows = np.column_stack([np.minimum(1, shares[name] / SATURATION[name]) for name in FEATURES])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES)), pa.int32()), pa.array(rows.ravel()))


def with_features(docs: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    return docs.withColumn(name, _features(F.col(text).cast("string")))


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the strength at which the verdict cuts."""

    weights: tuple[float, ...]
    cut: float

    def strength(self, features: Column) -> Column:
        terms = [features[i] * F.lit(w) for i, w in enumerate(self.weights)]
        return sum(terms[1:], terms[0])

    def score(self, features: Column) -> Column:
        """Between 0 and 1; a strength at the cut gets :data:`CUT`."""
        shift = float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-(self.strength(features) - F.lit(self.cut) + F.lit(shift))))


def preference_pairs(labelled: DataFrame, most: int = MOST_PER_CLASS, per_bad: int = PAIRS_PER_BAD) -> DataFrame:
    """Feature differences, good minus bad, in column ``difference``.

    At most ``most`` documents of each label take part, those of smallest hash; each bad one meets
    ``per_bad`` good ones chosen by a hash.
    """
    numbered = Window.orderBy("draw", "doc_id", "features")

    def sample(quality: int) -> DataFrame:
        rows = labelled.where(F.col("quality") == quality).withColumn("draw", F.xxhash64("doc_id", F.lit(quality)))
        return rows.orderBy("draw", "doc_id", "features").limit(most).withColumn("slot", F.row_number().over(numbered) - 1)

    good = written(sample(1).select("slot", F.col("features").alias("good")), "good")
    bad = sample(0).select("draw", F.col("features").alias("bad"), F.explode(F.sequence(F.lit(1), F.lit(per_bad))).alias("k"))
    meets = F.pmod(F.xxhash64("draw", "k"), F.greatest(F.lit(good.count()), F.lit(1))).cast("int")
    return bad.withColumn("slot", meets).join(good, "slot").select(
        F.zip_with("good", "bad", lambda g, b: g - b).alias("difference")
    )


def fit(labelled: DataFrame) -> Ranking:
    """Weights and cut from rows (doc_id, quality 0 or 1, features).

    The cut is the quantile of the labelled strengths at the share of bad documents. Without both
    labels there are no pairs: all weights are zero and every document is at the cut.
    """
    pairs = preference_pairs(labelled)
    both = written(
        pairs.select("difference", F.lit(1.0).alias("label")).unionByName(
            pairs.select(F.transform("difference", lambda x: -x).alias("difference"), F.lit(0.0).alias("label"))
        ),
        "pairs",
    )
    if both.isEmpty():
        return Ranking((0.0,) * len(FEATURES), 0.0)
    learner = LogisticRegression(featuresCol="x", fitIntercept=False, regParam=1e-4, standardization=False, maxIter=60)
    model = learner.fit(both.select(array_to_vector("difference").alias("x"), "label"))
    ranking = Ranking(tuple(float(w) for w in model.coefficients), 0.0)
    share = labelled.agg(F.avg(1 - F.col("quality"))).first()[0]
    strengths = labelled.select(ranking.strength(F.col("features")).alias("strength"))
    cut = strengths.agg(F.percentile_approx("strength", float(share), 100_000)).first()[0]
    return Ranking(ranking.weights, float(cut))


def quality_ranking(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every document, learned from rows that are not held out.

    Held out are documents whose crc32 of the id leaves 2 on division by 4. Null texts count as empty;
    labels without an id or a quality teach nothing; of several labels for one id the largest holds.
    Every row of ``documents`` gives one row, also repeated ones; an empty table gives none.
    """
    docs = written(with_features(documents.select("doc_id", "text")).select("doc_id", "features"), "features")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    taught = marks.where(id_remainder("doc_id", 4) != 2)
    ranking = fit(written(docs.join(taught, "doc_id"), "labelled"))
    score = ranking.score(F.col("features"))
    return docs.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)
    )
