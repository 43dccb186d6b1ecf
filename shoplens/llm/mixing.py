"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up per cell of source, language and topic. Cells are raked until their sums meet the
target share of every source, language and topic; a document is then drawn with the probability that
its cell's weight calls for.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoplens.llm.common import fresh, raw_texts, text_of

# The category of all values that the targets of a dimension with explicit shares don't name, null among them.
REST = "*"

Targets = Mapping[str, Mapping[str, float | None]]

# Shares of tokens. What the given shares leave is dealt among the categories without a share, and REST,
# in proportion to their tokens to the power TEMPER, which lifts small sources and languages. In a dimension
# without any given share each value of the data is a category, null as well.
TARGETS: Targets = {
    "source": {},
    "lang": {},
    "topic": {"note": None, "article": None, "long_read": None, "licensed": None, "table": 0.02},
}
TEMPER = 0.85
SEED = 20_240_607
# Share of all tokens that the sample takes.
KEEP = 0.7
# Part of all tokens by which a sum may miss its target.
TOLERANCE = 1e-10
MOST_ROUNDS = 5_000
# Targets that no sample meets together are moved to the data's own shares, as little as so many halvings find.
HALVINGS = 8
SCALES = (1e-60, 1e60)
# Cells that are sent to every executor; more are joined as Spark sees fit.
MOST_BROADCAST = 100_000

log = logging.getLogger(__name__)


def topic_of(raw: bytes, words: int) -> str:
    """A coarse topic from the form of the text, for tables without a topic of their own."""
    if b" | " in raw:
        return "table"
    if b"licensed under" in raw.lower():
        return "licensed"
    return "note" if words < 100 else "article" if words < 1000 else "long_read"


@F.arrow_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("topic", T.StringType())]))
def _form(text: pa.Array) -> pa.Array:
    raw = raw_texts(text)
    words = [len(x.split()) for x in raw]
    topics = [topic_of(x, n) for x, n in zip(raw, words)]
    return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(topics, pa.string())], ["words", "topic"])


def _dealt(share: np.ndarray, held: np.ndarray, total: float) -> np.ndarray:
    """``total`` in proportion to ``share``; no category gets more than it holds, the others get the excess."""
    full = np.zeros(len(share), bool)
    while True:
        left = max(0.0, total - held[full].sum())
        wanted = np.where(full, held, share * left / (share[~full].sum() or 1))
        over = ~full & (wanted > held)
        if not over.any():
            return wanted
        full |= over


def _wanted(share: np.ndarray, held: np.ndarray, total: float, given: np.ndarray) -> np.ndarray:
    """Tokens per category that one axis can give; excess goes to categories whose share is not given, as far as they hold it."""
    fixed = np.minimum(share / share.sum() * total, held)
    rest = total - fixed[given].sum()
    if not given.any() or held[~given].sum() >= rest:
        fixed[~given] = _dealt(share[~given], held[~given], rest)
    else:
        fixed[~given] = held[~given]
        fixed[given] = _dealt(share[given], held[given], total - held[~given].sum())
    return fixed


def _scale(weights: np.ndarray, tokens: np.ndarray, code: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per category the factor at which its cells, none above its tokens, add up to ``wanted``."""
    reach = tokens / weights
    order = np.lexsort((reach, code))
    w, t, c, reach = weights[order], tokens[order], code[order], reach[order]
    start = np.searchsorted(c, np.arange(len(wanted)))
    start[start == len(c)] = 0
    before_t, before_w = np.cumsum(t) - t, np.cumsum(w) - w
    # With the cells of smaller reach full, what the others have to give.
    others = np.bincount(c, w, len(wanted))[c] - (before_w - before_w[start][c])
    factor = (wanted[c] - (before_t - before_t[start][c])) / np.maximum(others, w)
    fits = np.flatnonzero(factor <= reach)[::-1]
    found = np.ones(len(wanted))
    found[c] = reach
    found[c[fits]] = factor[fits]
    return np.clip(found, *SCALES)


def _met(tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], total: float) -> np.ndarray | None:
    """Cells min(tokens, tokens * product of a factor per category) whose sums are ``wanted``; none if raking doesn't settle."""
    sums = lambda x, axis, of=slice(None): np.bincount(codes[axis][of], x[of], len(wanted[axis]))
    axes, full = range(len(codes)), np.zeros(len(tokens), bool)
    for axis in axes:
        full |= (wanted[axis] >= sums(tokens, axis) * (1 - 1e-12))[codes[axis]]
    cells, free = tokens.copy(), ~full
    left = [wanted[axis] - sums(tokens, axis, full) for axis in axes]
    if min(x.min() for x in left) < -TOLERANCE * total:
        return None
    own, places = tokens[free], [code[free] for code in codes]
    scales = [np.ones(len(x)) for x in wanted]
    for _ in range(MOST_ROUNDS if free.any() else 1):
        for axis in axes:
            weights = own * (total / tokens.sum())
            for other in axes:
                if other != axis:
                    weights = weights * scales[other][places[other]]
            if free.any():
                scales[axis] = _scale(weights, own, places[axis], left[axis])
            cells[free] = np.minimum(own, weights * scales[axis][places[axis]])
        if max(np.abs(sums(cells, axis) - wanted[axis]).max() for axis in axes) <= TOLERANCE * total:
            return cells
    return None


def _raked(
    tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], keep: float, given: list[np.ndarray] | None = None
) -> np.ndarray:
    """``rake`` over a list of cells with a category number per axis."""
    usable = tokens > 0
    for code, share in zip(codes, shares):
        usable &= share[code] > 0
    taken = np.zeros(len(tokens))
    if not usable.any():
        return taken
    tokens, codes, all_tokens = tokens[usable], [code[usable] for code in codes], tokens.sum()
    total = min(keep * all_tokens, tokens.sum())
    if total < keep * all_tokens * (1 - TOLERANCE):
        log.warning("mixing: shares of zero leave %.6g of all tokens, %.6g were to be kept", total / all_tokens, keep)
    wanted, own = [], []
    for axis, (code, share) in enumerate(zip(codes, shares)):
        held = np.bincount(code, tokens, len(share))
        own.append(held * (total / tokens.sum()))
        wanted.append(_wanted(share, held, total, given[axis] if given else np.zeros(len(share), bool)))
        short = np.flatnonzero((wanted[-1] < share / share.sum() * total * (1 - TOLERANCE)) & (held > 0))
        if len(short):
            log.warning("mixing: axis %d, categories %s hold less than their share; they give all, others the rest", axis, short.tolist())
    cells = _met(tokens, codes, wanted, total)
    if cells is None:
        low, high, cells = 0.0, 1.0, own and tokens * (total / tokens.sum())
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            found = _met(tokens, codes, [o + middle * (w - o) for o, w in zip(own, wanted)], total)
            low, high, cells = (low, middle, cells) if found is None else (middle, high, found)
        log.warning("mixing: no sample meets all targets together; shares go %.4g of the way from the data's to the targets", low)
    taken[usable] = cells
    return taken


def rake(tokens: np.ndarray, targets: list[np.ndarray], keep: float = 1.0) -> np.ndarray:
    """The tokens to take of each cell: ``keep`` of all, with the target share in every category of every axis.

    Cells are scaled axis by axis, none beyond what it has, until all sums meet their targets. A category
    that holds less than its share gives all it has, and the other categories of its axis give the rest in
    proportion to their shares; a share of zero stays zero, and less is kept if the others don't hold ``keep``.
    If no sample meets the targets of all axes together, they are moved to the data's own shares until one
    does. Each such change is logged; the sums always meet the targets that result.
    """
    codes = [x.ravel() for x in np.indices(tokens.shape)]
    return _raked(tokens.ravel(), codes, targets, keep).reshape(tokens.shape)


def _from_data(shares: Mapping[str, float | None]) -> bool:
    return all(share is None for share in shares.values())


def cell_probabilities(cells: DataFrame, targets: Targets, keep: float = KEEP, temper: float = TEMPER) -> pa.Table:
    """The category per dimension, and the probability of a token, of each cell.

    ``cells`` has one row per cell with its tokens; the driver holds them in arrays, some hundred bytes a cell.
    """
    names = list(targets)
    table = cells.select(*names, "tokens").toArrow()
    tokens = table["tokens"].to_numpy().astype(float)
    codes, wanted, fixed = [], [], []
    for name in names:
        shares = targets[name]
        coded = pa.concat_arrays([pa.array([], pa.string()), *table[name].chunks]).dictionary_encode("encode")
        known = coded.dictionary.to_pylist()
        known += [c for c, share in shares.items() if share is not None and c not in known]
        code = coded.indices.to_numpy().astype(np.int64)
        sums = np.bincount(code, tokens, len(known))
        given = np.array([np.nan if shares.get(c) is None else shares[c] for c in known], float)
        free = np.where(np.isnan(given), sums / max(tokens.sum(), 1), 0) ** temper * np.isnan(given)
        left = max(0.0, 1 - np.nansum(given))
        codes.append(code)
        wanted.append(np.where(np.isnan(given), free * left / (free.sum() or 1), given))
        fixed.append(~np.isnan(given))
    raked = _raked(tokens, codes, wanted, keep, fixed)
    # Texts without words carry no tokens to rake; they are drawn like the average token.
    probability = np.divide(raked, tokens, out=np.full_like(tokens, keep), where=tokens > 0)
    return table.select(names).append_column("probability", pa.array(probability))


def _category(value: Column, shares: Mapping[str, float | None]) -> Column:
    named = [c for c in shares if c != REST]
    if _from_data(shares):
        return value
    return F.when(value.isin(named), value).otherwise(F.lit(REST)) if named else F.lit(REST)


def draw_of(doc_id: str, text: str, seed: int = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id alone; on the text where the id is null."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), text_of(text)))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), 11).cast("double") / float(1 << 53)


def calibrated(
    docs: DataFrame,
    targets: Targets = TARGETS,
    keep: float = KEEP,
    doc_id: str = "doc_id",
    text: str = "text",
    info: str = "mix",
) -> DataFrame:
    """``docs`` with a struct column ``info``: topic, n_tokens, weight, probability, draw and sampled.

    Expected tokens of the sample are ``keep`` of all and meet every target that the data can fill (``rake``
    says what becomes of the others); no document is drawn twice. The weight is the probability divided by ``keep``. A document is sampled if
    its draw is below its probability.
    A topic column in ``docs`` is used; otherwise the topic follows from the text. Rows of equal ids are
    drawn together. Only cell sums are shuffled; the weights, one per cell, are joined to the rows.
    """
    form = fresh(docs, "_form")
    # Words and topic in one pass over the text, whose result the plan uses by name and never repeats.
    known = docs.withColumn(form, _form(F.col(text).cast("string")))
    words = F.col(f"{form}.words")
    topic = F.col("topic").cast("string") if "topic" in docs.columns else F.col(f"{form}.topic")
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    places = {d: _category(values[d].cast("string"), targets[d]) for d in targets}
    cells = known.groupBy(*[places[d].alias(d) for d in targets]).agg(F.sum(words).alias("tokens"))
    found = cell_probabilities(cells, targets, keep)
    cell = fresh(known, "_cell")
    weights = docs.sparkSession.createDataFrame(found).select(F.struct(*found.column_names).alias(cell))
    weights = F.broadcast(weights) if found.num_rows <= MOST_BROADCAST else weights
    same = F.lit(True)
    for d in targets:
        same = same & places[d].eqNullSafe(F.col(f"{cell}.{d}"))
    known = known.join(weights, same, "left")
    probability = F.col(f"{cell}.probability")
    parts = known.withColumn(
        info,
        F.struct(
            topic.alias("topic"),
            words.alias("n_tokens"),
            (probability / F.lit(keep)).alias("weight"),
            probability.alias("probability"),
            draw_of(doc_id, text).alias("draw"),
        ),
    ).drop(form, cell)
    return parts.withColumn(info, F.col(info).withField("sampled", F.col(f"{info}.draw") < F.col(f"{info}.probability")))


def sampled(
    docs: DataFrame, targets: Targets = TARGETS, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that are drawn, with their columns as they are."""
    info = fresh(docs, "_mix")
    return calibrated(docs, targets, keep, doc_id, text, info).where(F.col(f"{info}.sampled")).drop(info)


def mix_sources(documents: DataFrame) -> DataFrame:
    """Weight, probability and draw of every document.

    Null and empty texts have no tokens and are drawn like the average token. A null source or language is a
    category of its own where categories come from the data, and REST where shares are given. Rows of equal
    ids are drawn together; an empty table gives no rows.
    """
    named = [c for c in documents.columns if c in ("doc_id", "text", "source", "lang", "topic")]
    return calibrated(documents.select(named)).select("doc_id", "source", "lang", "mix.*")
