"""Toxic documents by a support vector machine on a subsequence string kernel.

Two words are alike as far as they share subsequences of three letters; a subsequence counts less for every
letter or gap that it skips, so that gapped words and words with inserted characters stay close to the
plain word. Landmark words span the space of the machine (Nyström): a word's features are its kernels to the
landmarks, whitened by the kernels among these. A sentence is as toxic as its worst word and a document as
its worst sentence; the machine is trained on the words that stand for labelled sentences, with gapped and
stretched variants of the toxic ones, and the words are chosen anew in each round.

The decision is linear in a word's subsequences, so weights of landmarks are turned into weights of
subsequences once, and scoring looks those up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoplens.llm.common import id_remainder, raw_texts, written

# Letters of a subsequence, letters and gaps it may span, and what each skipped one leaves of its weight.
LETTERS = 3
SPAN = 6
DECAY = 0.5
SYMBOL_BITS = 7
# A longer word is cut into overlapping pieces of this length.
LONGEST = 48
# Landmarks among the most telling units of toxic documents, and among the most frequent of clean ones.
LANDMARKS = (224, 32)
# Units of each kind that landmarks are chosen from.
TELLING = 400
FREQUENT = 300
# How telling a unit must be to stand for a toxic sentence in later rounds.
EVIDENCE = 10.0
# Clean units among the examples: most frequent, drawn by hash, and per round those that look most toxic.
CLEAN_FREQUENT = 2_000
CLEAN_DRAWN = 20_000
CLEAN_HARD = 3_000
# What a clean document wrongly called toxic costs, against a toxic one that is missed.
CLEAN_COST = 4.0
# Bound of the labelled rows that are learned from, of each label.
MOST_PER_CLASS = 2_000
ROUNDS = 3
REGULARISATION = 1e-4
NEWTON_STEPS = 40
CUT = 0.7
STEEPNESS = 6.0
# Words whose decisions a task remembers, and words and bytes of text taken together.
REMEMBERED = 100_000
UNITS_AT_ONCE = 4_000
KERNELS_AT_ONCE = 250
BYTES_AT_ONCE = 1 << 20

GAP, START, END = "\0", "\1", "\2"
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")
# Symbols: nothing 0, a to z 1 to 26, start 27, end 28, other letters by remainder.
_FIRST_OTHER = 29


def pieces(letters: str) -> list[str]:
    """A word between its start and end marks; a long one as pieces, each half over the next."""
    marked = START + letters + END
    if len(marked) <= LONGEST:
        return [marked]
    step = LONGEST // 2
    return [marked[i : i + LONGEST] for i in range(0, len(marked) - step, step)]


def unit(token: str) -> str:
    """The letters of a token in lower case; what stands between letters becomes one gap."""
    return token.lower() if token.isalpha() else _NO_LETTERS.sub(GAP, token.lower()).strip(GAP)


def tokens(text: str) -> set[str]:
    """Tokens of a text, and each run of single characters as one token."""
    found = set(text.split())
    found.update(_NO_LETTERS.sub(GAP, run) for run in _SPELLED.findall(text))
    return found


def _symbols(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all units, each followed by zeros that no subsequence crosses, and the unit of each symbol."""
    blank = GAP * SPAN
    points = np.frombuffer((blank.join(units) + blank).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    symbols = _FIRST_OTHER + points % ((1 << SYMBOL_BITS) - _FIRST_OTHER)
    latin = (points >= 97) & (points <= 122)
    symbols[latin] = points[latin] - 96
    symbols[points == 0], symbols[points == 1], symbols[points == 2] = 0, 27, 28
    return symbols, np.repeat(np.arange(len(units)), [len(u) + SPAN for u in units])


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, weight) without repeats; the weights of a unit have length one."""
    symbols, owner = _symbols(units)
    size = len(symbols) - SPAN
    keys, weights = [], []
    for places in combinations(range(1, SPAN), LETTERS - 1):
        code, real = symbols[:size].copy(), symbols[:size] > 0
        for place in places:
            other = symbols[place : size + place]
            code = (code << SYMBOL_BITS) | other
            real &= other > 0
        at = np.flatnonzero(real)
        keys.append((owner[at] << (SYMBOL_BITS * LETTERS)) | code[at])
        weights.append(np.full(len(at), DECAY ** (places[-1] + 1 - LETTERS)))
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(place, np.concatenate(weights), len(found))
    unit_of = found >> (SYMBOL_BITS * LETTERS)
    length = np.sqrt(np.bincount(unit_of, weight * weight, len(units)))
    return unit_of, found & ((1 << (SYMBOL_BITS * LETTERS)) - 1), weight / length[unit_of]


def kernels(units: list[str], others: list[str]) -> np.ndarray:
    """The kernel of each unit with each of a few others."""
    owner, code, weight = subsequences(others)
    known, column = np.unique(code, return_inverse=True)
    dense = np.zeros((len(known), len(others)))
    dense[column, owner] = weight
    result = np.zeros((len(units), len(others)))
    for first in range(0, len(units), KERNELS_AT_ONCE):
        owner, code, weight = subsequences(units[first : first + KERNELS_AT_ONCE])
        place = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[place] == code) if len(known) else np.zeros(0, np.int64)
        # Rows of a unit are neighbours, so sums run over stretches of them.
        starts = np.flatnonzero(np.diff(owner[hit], prepend=-1))
        if len(starts):
            result[first + owner[hit][starts]] = np.add.reduceat(weight[hit][:, None] * dense[place[hit]], starts)
    return result


def chosen_landmarks(candidates: list[str], most: int) -> list[str]:
    """Greedily the candidate that those chosen so far represent worst, until ``most`` or none is left."""
    if not candidates:
        return []
    matrix = kernels(candidates, candidates)
    left, parts, chosen = np.diag(matrix).copy(), np.zeros((len(candidates), most)), []
    for j in range(min(most, len(candidates))):
        best = int(np.argmax(left))
        if left[best] < 1e-6:
            break
        parts[:, j] = (matrix[:, best] - parts[:, :j] @ parts[best, :j]) / np.sqrt(left[best])
        left = np.maximum(left - parts[:, j] ** 2, 0)
        chosen.append(candidates[best])
    return chosen


@dataclass
class Nystroem:
    """Features of a unit: its kernels to the landmarks, whitened."""

    landmarks: list[str]

    def __post_init__(self):
        values, vectors = np.linalg.eigh(kernels(self.landmarks, self.landmarks))
        self.whitening = (vectors / np.sqrt(np.maximum(values, 1e-8))) @ vectors.T

    def features(self, units: list[str]) -> np.ndarray:
        return kernels(units, self.landmarks) @ self.whitening

    def machine(self, weights: np.ndarray, bias: float) -> Machine:
        owner, code, weight = subsequences(self.landmarks)
        known, place = np.unique(code, return_inverse=True)
        return Machine(known, np.bincount(place, weight * (self.whitening @ weights)[owner], len(known)), float(bias))


@dataclass
class Machine:
    """The decision as weights of subsequences, and the decision at which a document counts as toxic."""

    codes: np.ndarray
    values: np.ndarray
    bias: float
    cut: float = 0.0
    _dense: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def decisions(self, units: list[str]) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << (SYMBOL_BITS * LETTERS))
            self._dense[self.codes] = self.values
        result = np.zeros(len(units))
        for first in range(0, len(units), UNITS_AT_ONCE):
            some = units[first : first + UNITS_AT_ONCE]
            owner, code, weight = subsequences(some)
            result[first : first + len(some)] = np.bincount(owner, weight * self._dense[code], len(some))
        return result + self.bias

    def of_tokens(self, some: Iterable[str]) -> dict[str, float]:
        """The decision of each token with a letter: that of its worst piece."""
        named = [(token, letters) for token in some if (letters := unit(token))]
        parts, owner = [], []
        for i, (_, letters) in enumerate(named):
            own = pieces(letters)
            parts += own
            owner += [i] * len(own)
        worst = np.full(len(named), -np.inf)
        if parts:
            np.maximum.at(worst, owner, self.decisions(parts))
        return {token: value for (token, _), value in zip(named, worst.tolist())}

    def of_texts(self, texts: Iterable[str]) -> list[float | None]:
        """The decision of each text: that of its worst token; none for a text without letters."""
        known: dict[str, float] = {}
        found: list[float | None] = []
        for some in _together(texts):
            own = [tokens(text) for text in some]
            new = set().union(*own).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, set().union(*own)
            known.update(self.of_tokens(new))
            known.update((token, -np.inf) for token in new.difference(known))
            worst = [max(map(known.__getitem__, x), default=-np.inf) for x in own]
            found += [None if x == -np.inf else x for x in worst]
        return found


def _together(texts: Iterable[str]) -> Iterator[list[str]]:
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > BYTES_AT_ONCE:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def _decoded(column: pa.Array) -> Iterator[str]:
    """Texts one by one, so that no task holds a batch three times over."""
    return (raw.decode("utf-8", "replace") for raw in raw_texts(column))


def _decision_of(machine: Machine):
    @F.arrow_udf("double")
    def decision(text: pa.Array) -> pa.Array:
        return pa.array(machine.of_texts(_decoded(text)), pa.float64())

    return decision


def _unit_decision(machine: Machine):
    @F.arrow_udf("double")
    def decision(unit_: pa.Array) -> pa.Array:
        return pa.array(machine.decisions(unit_.to_pylist()))

    return decision


def _features_of(space: Nystroem):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(unit_: pa.Array) -> pa.Array:
        found = space.features(unit_.to_pylist())
        offsets = np.arange(0, found.size + 1, found.shape[1])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.ravel()))

    return features


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> DataFrame:
    """(doc, toxic, text): at most ``most`` labelled rows of each label that are not held out, those of smallest hash.

    Ids are chosen first, so that the texts of all others stay where they are; no more than ``most`` rows
    of a label go on, however often an id repeats.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(id_remainder("doc_id", 3) != 1).withColumn("draw", F.xxhash64("doc_id", "toxic"))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    known = texts.select("doc_id").where(F.col("doc_id").isNotNull())
    parts = []
    for toxic in (0, 1):
        ids = marks.where(F.col("toxic") == toxic).join(known, "doc_id", "left_semi").orderBy("draw", "doc_id").limit(most)
        rows = texts.join(F.broadcast(ids), "doc_id").withColumn("row", F.xxhash64("text"))
        parts.append(rows.orderBy("draw", "doc_id", "row").limit(most))
    sample = parts[0].unionByName(parts[1])
    return written(sample.select(F.xxhash64("doc_id", "row").alias("doc"), "toxic", "text"), "labelled")


def sentence_units(sample: DataFrame) -> DataFrame:
    """(doc, toxic, unit): the distinct units in the sentences of every document.

    Runs of single characters are taken within a sentence only.
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _decoded(batch.column(2))):
                words = set().union(*map(tokens, _SENTENCE.split(text)))
                found = sorted({part for letters in map(unit, words) if letters for part in pieces(letters)})
                if found:
                    columns = [pa.array([doc] * len(found), pa.int64()), pa.array([toxic] * len(found), pa.int32()), pa.array(found)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "toxic", "unit"])

    narrow = sample.select("doc", F.col("toxic").cast("int").alias("toxic"), "text")
    return written(narrow.mapInArrow(split, "doc long, toxic int, unit string"), "sentences")


def variants(word: str) -> list[str]:
    """``word`` with a gap between all letters, and with one gap or one doubled letter at each place."""
    inner = word.strip(START + END)
    some = {GAP.join(inner)}
    for i in range(1, len(inner)):
        some |= {inner[:i] + GAP + inner[i:], inner[:i] + inner[i - 1 :]}
    return sorted(word.replace(inner, x, 1) for x in some if len(x) + 2 <= LONGEST and GAP + GAP not in x)


def _best_cut(rows: list[tuple[int, float]]) -> float:
    """The place that keeps most of the share of toxic documents above it, less the cost of clean ones there.

    Of equally good places the widest gap; the cut is in its middle.
    """
    rows = sorted(rows, key=lambda r: r[1])
    toxic = np.array([t for t, _ in rows], float)
    value = np.array([v for _, v in rows])
    above = toxic / max(toxic.sum(), 1) - CLEAN_COST * (1 - toxic) / max((1 - toxic).sum(), 1)
    gain = -np.cumsum(above)
    splits = np.flatnonzero(np.diff(value) > 0)
    if not len(splits):
        return float(value[-1]) + 1
    best = splits[gain[splits] >= gain[splits].max() - 1e-12]
    at = best[np.argmax(value[best + 1] - value[best])]
    return float(value[at] + value[at + 1]) / 2


def fitted(examples: DataFrame, width: int) -> np.ndarray:
    """Weights and bias of least squared hinge loss over rows (label of -1 or 1, weight, features), by Newton steps.

    Each task adds up gradient and curvature of its rows; the driver gets one row per task.
    """
    penalty = np.full(width + 1, REGULARISATION)
    penalty[-1] *= 1e-3
    weights = np.zeros(width + 1)

    def sums(current: np.ndarray):
        def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, curvature = np.zeros(width + 1), np.zeros((width + 1, width + 1))
            for batch in batches:
                label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
                rows = np.column_stack([rows, np.ones(len(rows))])
                short = 1 - label * (rows @ current)
                on = short > 0
                gradient -= 2 * rows[on].T @ (weight[on] * label[on] * short[on])
                curvature += 2 * (rows[on] * weight[on][:, None]).T @ rows[on]
            yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()]), pa.array([curvature.tobytes()])], ["gradient", "curvature"])

        return add_up

    for _ in range(NEWTON_STEPS):
        parts = examples.mapInArrow(sums(weights), "gradient binary, curvature binary").collect()
        gradient = penalty * weights + sum(np.frombuffer(r["gradient"]) for r in parts)
        curvature = np.diag(penalty) + sum(np.frombuffer(r["curvature"]).reshape(width + 1, -1) for r in parts)
        step = np.linalg.solve(curvature, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-7:
            break
    return weights


def trained(documents: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS, rounds: int = ROUNDS) -> Machine | None:
    """The machine learned from labelled rows that are not held out; none without both labels.

    A unit tells as much as toxic documents have it more often than clean ones. First the most telling unit
    of each toxic document is an example, in later rounds the one among its telling units that the last
    machine finds worst. Clean examples are units of clean documents: frequent ones, some drawn by hash,
    and those that the last machine finds worst. All of these are bounded by the parameters above.
    """
    spark = documents.sparkSession
    units = sentence_units(labelled_sample(documents, labels, most))
    sizes = {r["toxic"]: r["n"] for r in units.groupBy("toxic").agg(F.count_distinct("doc").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    per_unit = units.groupBy("unit").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc"))).alias("toxic_docs"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc"))).alias("clean_docs"),
    )
    share, clean_share = (F.col("toxic_docs") + 0.1) / sizes[1], (F.col("clean_docs") + 1.0) / sizes[0]
    telling = F.greatest(F.col("toxic_docs") * F.log(share / clean_share), F.lit(0.0))
    often = F.col("toxic_docs") / sizes[1] > 3 * F.col("clean_docs") / sizes[0]
    scored = per_unit.withColumns({"telling": telling, "evident": often & (telling >= EVIDENCE)})
    scored = written(scored, "units")

    def first(rows: DataFrame, most: int, *order) -> list[str]:
        return [r["unit"] for r in rows.orderBy(*order, "unit").limit(most).select("unit").collect()]

    clean = scored.where("clean_docs > 0")
    told = first(scored.where("telling > 0"), TELLING, F.desc("telling"))
    if not told:
        return None
    plain = [u for u in first(clean, FREQUENT, F.desc("clean_docs")) if u not in told]
    space = Nystroem(chosen_landmarks(told, LANDMARKS[0]) + chosen_landmarks(plain, LANDMARKS[1]))
    features, width = _features_of(space), len(space.landmarks)

    def witnesses(value: DataFrame) -> dict[str, int]:
        """The unit that stands for each toxic document, and for how many."""
        worst = F.max(F.struct("value", "unit"))["unit"].alias("unit")
        found = units.where("toxic = 1").join(value, "unit").groupBy("doc").agg(worst).groupBy("unit").agg(F.count("*").alias("n"))
        return {r["unit"]: r["n"] for r in found.collect()}

    toxic = start = witnesses(scored.where("telling > 0").select("unit", F.col("telling").alias("value")))
    calm = clean.where("not evident")
    negatives = {*first(calm, CLEAN_FREQUENT, F.desc("clean_docs")), *first(calm, CLEAN_DRAWN, F.xxhash64("unit"))}
    for number in range(rounds):
        rows = [(u, 1.0, n / sum(toxic.values())) for u, n in sorted(toxic.items())]
        rows += [(v, 1.0, w / len(some)) for u, _, w in rows if (some := variants(u)) for v in some]
        rows += [(u, -1.0, 1 / len(negatives)) for u in sorted(negatives - set(start) - set(toxic))]
        examples = spark.createDataFrame(rows, "unit string, label double, weight double").repartition(8)
        weights = fitted(written(examples.select("label", "weight", features("unit").alias("features")), "examples"), width)
        machine = space.machine(weights[:-1], weights[-1])
        judged = written(scored.withColumn("value", _unit_decision(machine)("unit")), f"decisions-{number}")
        toxic = witnesses(judged.where("evident").select("unit", "value")) or toxic
        negatives |= set(first(judged.where("clean_docs > 0"), CLEAN_HARD, F.desc("value")))
    # At most ``most`` documents of each label.
    worst_of = units.join(judged.select("unit", "value"), "unit").groupBy("doc", "toxic").agg(F.max("value").alias("value"))
    machine.cut = _best_cut([(r["toxic"], r["value"]) for r in worst_of.collect()])
    return machine


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every whole text, learned from rows that are not held out.

    Held out are documents whose crc32 of the id leaves 1 on division by 3. Null and empty texts, and texts
    without a letter, score 0. Labels without an id or a mark teach nothing; of several labels for one id the
    largest holds. Without labels of both kinds every score is 0. Every row of ``documents`` gives one row,
    also repeated ones; an empty table gives none.
    """
    machine = trained(documents, labels)
    held_out = (id_remainder("doc_id", 3) == 1).alias("held_out")
    if machine is None:
        return documents.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    decision = _decision_of(machine)(F.col("text").cast("string")) - F.lit(machine.cut)
    rows = documents.select("doc_id", held_out, decision.alias("_decision"))
    shift = float(np.log(CUT / (1 - CUT)))
    score = F.coalesce(1 / (1 + F.exp(-(F.lit(STEEPNESS) * F.col("_decision") + F.lit(shift)))), F.lit(0.0))
    predicted = F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    return rows.select("doc_id", "held_out", score.alias("score")).select("doc_id", "held_out", "score", predicted)
