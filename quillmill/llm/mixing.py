"""Mixing sources to target weights by iterative proportional fitting, then sampling documents.

Documents fall into cells of source, language and topic; values without a target share one cell each, so the number
of cells is bounded by the targets. A cell's tokens are its starting weight. Raking scales the weights to each
marginal in turn until all three hold. A cell's ratio of fitted to present tokens, times ``keep``, is the probability
with which each of its documents stays. ``mix`` rakes again where that is over 1, with such cells whole, and lowers
``keep`` until the marginals hold; ``fit_mix`` alone only cuts it to 1, as the query's SQL does. A hash of the document's
identifier draws, so that the same rows stay on every run. Sampling is a map over the rows; only the cell sums are
shuffled, combined in each task first.

Defined results. Null values of source, language or topic are a value without a target. A null text has no tokens and
stays in its cell with the cell's probability. Rows without an identifier draw by their text. Repeated rows draw alike.
A marginal value that no document has is left out and the others share its weight. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

OTHER = "*other*"


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by value for each dimension; a share under OTHER is for all values that are not named."""

    source: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    topic: dict[str, float] = field(default_factory=dict)

    def of(self, dimension: str) -> dict[str, float]:
        return getattr(self, dimension)


DIMENSIONS = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    """Words parted by white space."""
    return F.regexp_count(text, F.lit("[^ \\n\\t\\r]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by form, for corpora without one: tables, text with symbol noise, short texts, prose."""
    n = F.greatest(F.length(text), F.lit(1))

    def how_many(mark: str) -> Column:  # one byte each; a text without the mark is only searched
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))

    cells = how_many("|")
    marks = sum((how_many(m) for m in "*#$&"), how_many("%"))
    return (
        F.when(marks * 20 > n, F.lit("symbols")).when(cells * 40 > n, F.lit("tables"))
        .when(n < 600, F.lit("short")).otherwise(F.lit("prose"))
    )


def folded(column: Column, target: dict[str, float]) -> Column:
    """The column's value if the target names it, else OTHER."""
    names = [F.lit(v) for v in target if v != OTHER]
    return F.when(column.isin(*names), column).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


def uniform_of(id_column: Column, text: Column) -> Column:
    """A number in [0, 1) from the identifier's digits, or from the text where there is none."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(id_column.cast("string"), F.md5(text.cast("binary")))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def rake(tokens: np.ndarray, marginals: list[np.ndarray], rounds: int = 25, off: float = 0.0) -> np.ndarray:
    """Weights with the zero pattern of ``tokens`` whose sums along each axis approach ``marginals`` (shares of 1).

    Takes ``rounds`` rounds, or ends when no weight moves by more than ``off`` in one.
    """
    weights = tokens / max(tokens.sum(), 1e-300)
    axes = range(weights.ndim)
    for _ in range(rounds):
        before = weights
        for axis in axes:
            now = weights.sum(axis=tuple(a for a in axes if a != axis))
            scale = np.divide(marginals[axis], now, out=np.zeros_like(now), where=now > 0)
            weights = weights * scale.reshape([-1 if a == axis else 1 for a in axes])
        if np.abs(weights - before).max() < off:
            break
    return weights


def rake_within(tokens: np.ndarray, weights: np.ndarray, keep: float, rounds: int = 150, off: float = 1e-3) -> np.ndarray:
    """Each cell's probability, at most 1, so that what stays has the marginals of ``weights`` to a share of ``off``.

    ``keep`` is halved and brought near again until they hold; they do where no cell is asked for more than it has.
    """
    axes = range(weights.ndim)
    others = [tuple(a for a in axes if a != axis) for axis in axes]
    goals = [weights.sum(axis=o, keepdims=True) for o in others]
    share = tokens / max(tokens.sum(), 1e-300)

    def at(kept: float) -> np.ndarray | None:
        most, free = share / kept, weights.copy()
        for _ in range(rounds):
            for o, goal in zip(others, goals, strict=True):
                held = np.where(free >= most, most, 0.0).sum(axis=o, keepdims=True)
                loose = np.where(free < most, free, 0.0).sum(axis=o, keepdims=True)
                free = free * np.clip(np.divide(goal - held, loose, out=np.ones_like(goal), where=loose > 0), 0.1, 10)
            now = np.minimum(free, most)
            if all(np.abs(now.sum(axis=o, keepdims=True) - goal).max() <= off for o, goal in zip(others, goals, strict=True)):
                return np.divide(now * kept, share, out=np.zeros_like(now), where=share > 0)
        return None

    ratio = np.divide(weights, share, out=np.zeros_like(share), where=share > 0).max()
    low, high = min(keep, 1 / max(ratio, 1e-300)), keep
    best = at(high)
    if best is not None:
        return np.minimum(best, 1.0)
    best = np.divide(weights * low, share, out=np.zeros_like(share), where=share > 0)
    for _ in range(12):
        middle = (low + high) / 2
        found = at(middle)
        low, high, best = (low, middle, best) if found is None else (middle, high, found)
    return np.minimum(best, 1.0)


def share_of(target: dict[str, float], values: list[str], present: np.ndarray) -> np.ndarray:
    """Target shares of ``values`` that are present, summing to 1; OTHER without a target keeps its present share."""
    total = present.sum()
    if not target:
        return present / max(total, 1e-300)
    kept = present[values.index(OTHER)] / max(total, 1e-300) if OTHER not in target else 0.0
    named = np.array([target.get(v, 0.0) if p > 0 else 0.0 for v, p in zip(values, present, strict=True)])
    if OTHER not in target:
        named = named / max(named.sum(), 1e-300) * (1 - kept) if named.sum() else named
        named[values.index(OTHER)] = kept if named.sum() else 1.0
    return named / max(named.sum(), 1e-300)


@dataclass(frozen=True)
class Mix:
    """The fitted probability of each cell, by its values."""

    targets: Targets
    cells: list[tuple[str, str, str, float, float, float]]  # source, lang, topic, tokens, weight, probability

    def residuals(self) -> dict[tuple[str, str], float]:
        """By dimension and value, how far the expected share of kept tokens is from the target; values without documents
        have all of theirs missing."""
        kept = sum(c[3] * c[5] for c in self.cells)
        out = {}
        for k, dimension in enumerate(DIMENSIONS):
            for value, share in self.targets.of(dimension).items():
                held = sum(c[3] * c[5] for c in self.cells if c[k] == value)
                out[dimension, value] = (held / kept if kept else 0.0) - share
        return out

    def probability(self, source: Column, lang: Column, topic: Column) -> Column:
        key = F.concat_ws("\x1f", *[folded(c, self.targets.of(d)) for c, d in zip((source, lang, topic), DIMENSIONS, strict=True)])
        pairs = [x for *values, _, _, p in self.cells for x in (F.lit("\x1f".join(values)), F.lit(float(p)))]
        if not pairs:
            return F.lit(0.0)
        return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.0))


def fit_mix(
    docs: DataFrame, source: Column, lang: Column, topic: Column, tokens: Column, targets: Targets, keep: float = 0.5, rounds: int = 25,
    within: bool = False,
) -> Mix:
    """Rake the corpus's token counts to ``targets``.

    ``keep`` is the share of the corpus's tokens that the mix aims at; where cells can't give their part of that even
    whole, they stay whole, and with ``within`` the others are raked again until the marginals hold; raking then goes on
    until it has converged rather than for ``rounds`` rounds.
    """
    columns = [folded(c, targets.of(d)).alias(d) for c, d in zip((source, lang, topic), DIMENSIONS, strict=True)]
    sums = docs.select(*columns, tokens.alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    found = {tuple(r[:3]): float(r.tokens) for r in sums.collect()}  # a cell for each combination of target values at most
    values = [[*(v for v in targets.of(d) if v != OTHER), OTHER] for d in DIMENSIONS]
    cube = np.zeros([len(v) for v in values])
    for key, n in found.items():
        cube[tuple(v.index(k) for v, k in zip(values, key, strict=True))] = n
    total = cube.sum()
    marginals = [
        share_of(targets.of(d), values[a], cube.sum(axis=tuple(b for b in range(3) if b != a))) for a, d in enumerate(DIMENSIONS)
    ]
    weights = rake(cube, marginals, 1000, 1e-9) if within else rake(cube, marginals, rounds)
    ratio = np.divide(weights * total * keep, cube, out=np.zeros_like(cube), where=cube > 0)
    if within:
        ratio = rake_within(cube, weights, keep)
    cells = []
    for key, n in sorted(found.items()):
        at = tuple(v.index(k) for v, k in zip(values, key, strict=True))
        # a cell without tokens has no ratio of its own: its documents stay
        cells.append((*key, n, float(weights[at]), float(min(1.0, ratio[at])) if n else 1.0))
    return Mix(targets, cells)


def mix(
    docs: DataFrame, targets: Targets, keep: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, tokens: Callable[[Column], Column] = tokens_of,
) -> tuple[Mix, Column, Column]:
    """The fitted mix, and two columns over ``docs``: a row's probability, and whether it stays.

    ``tokens`` counts a text's tokens: words, or what a tokenizer makes of it.
    """
    text = text_or_empty(docs[text_col])
    topic = topic_of(text) if topic is None else topic
    source, lang = docs[source_col].cast("string"), docs[lang_col].cast("string")
    fitted = fit_mix(docs, source, lang, topic, tokens(text), targets, keep, within=True)
    probability = fitted.probability(source, lang, topic)
    return fitted, probability, uniform_of(docs[id_col], text) < probability


