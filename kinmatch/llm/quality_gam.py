"""A quality classifier: an additive model of single features and pairs of features.

Each text becomes a few numbers (``FEATURES``).  The model is a sum of lookup tables,
one per feature over quantile bins and one per chosen pair over a coarse grid, learnt by
cyclic boosting: in every round each feature in turn gets a tree of at most four leaves
over its bins, shrunk and added to its table; pairs are boosted the same way on what
the single features left.  A score is the logistic function of the looked-up numbers'
sum, computed for a batch of texts at a time.

The tables are fitted on the driver on at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id, of which only the features are gathered.  Scoring is a
map over all documents without a shuffle; the model travels with the task.

Defined results: a null text is an empty one, whose features are zero; rows with a
null id are held out and scored; repeated ids are scored row by row; a document with
several labels has their mean, at least a half counting as 1; without labels of both
kinds every score is the smoothed share of 1; an empty table gives an empty one; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import fold, slices

SAMPLE = 20_000
BINS = 32
GRID = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
RIDGE = 1.0
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&|<>@^~=+\\/{}[]_"

FEATURES = [
    "log_words",
    "word_length",
    "symbols_per_word",
    "shouts_per_word",
    "upper_share",
    "digit_share",
    "stops_per_word",
    "distinct_words",
    "top_word",
    "distinct_pairs",
    "doubled_words",
    "repeated_lines",
    "log_line_words",
    "ended_lines",
    "pipes_per_word",
    "links_per_word",
]


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES`` for a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)

    def count(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    size = sum(map(len, words))
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    # zip stops at the shorter side, so this pairs each word with its successor.
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    return [
        math.log1p(n),
        size / n,
        count(SYMBOLS) / n,
        count(b"!?") / n,
        count(UPPER) / size,
        count(DIGITS) / size,
        count(b".,;:") / n,
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        len(set(zip(words, words[1:]))) / n,
        doubled / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(x.endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        raw.count(b"|") / n,
        raw.count(b"://") / n,
    ]


def _matrix(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        total = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for (i, j), grid in zip(self.pairs, self.grids):
            total += grid[_coarse(bins[i], self.edges[i]), _coarse(bins[j], self.edges[j])]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of a feature gathered to at most ``GRID`` cells."""
    return bins * GRID // (len(edges) + 1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """The best place to split bins in two, 0 if there is none."""
    if len(g) < 2:
        return 0
    left, weight = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left, weight) + _gain(g.sum() - left, h.sum() - weight)
    best = int(np.argmax(gains))
    return best + 1 if gains[best] > _gain(g.sum(), h.sum()) + 1e-9 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of depth two over ordered bins."""
    top = _cut(g, h)
    bounds = {0, len(g), top}
    for a, b in ((0, top), (top, len(g))):
        if b > a and (at := _cut(g[a:b], h[a:b])):
            bounds.add(a + at)
    out, marks = np.zeros(len(g)), sorted(bounds)
    for a, b in zip(marks, marks[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree over a grid: the best cut of the rows with a cut of the columns on either side."""
    best, out = -np.inf, np.zeros_like(g)
    for top in range(1, len(g)):
        made, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, top), slice(top, len(g))):
            at = _cut(g[rows].sum(0), h[rows].sum(0)) or g.shape[1]
            for cols in (slice(0, at), slice(at, g.shape[1])):
                slope, weight = g[rows, cols].sum(), h[rows, cols].sum()
                made[rows, cols] = slope / (weight + RIDGE)
                gain += float(_gain(slope, weight))
        if gain > best:
            best, out = gain, made
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The tables for features ``x`` and labels ``y`` of 0 and 1."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    # Edges lie on values of the sample; a constant feature has none and a single bin.
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) if n else np.zeros(0) for j in range(width)]
    model = Model(math.log(share / (1 - share)), edges, [np.zeros(len(e) + 1) for e in edges])
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    cells = [_coarse(b, e) for b, e in zip(bins, edges)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * GRID + cells[j], values, GRID * GRID).reshape(GRID, GRID)

    g, h = slopes()
    strength = {
        (i, j): float(_gain(grid(i, j, g), grid(i, j, h)).sum()) for i in range(width) for j in range(i + 1, width)
    }
    model.pairs = sorted(strength, key=lambda p: (-strength[p], p))[:PAIRS]
    model.grids = [np.zeros((GRID, GRID)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.grids):
            g, h = slopes()
            step = RATE * grid_tree(grid(i, j, g), grid(i, j, h))
            table += step
            total += step[cells[i], cells[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents for which ``allowed`` (over ``doc_id``) holds."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).dropna()
    if allowed is not None:
        known = known.filter(allowed)
    one = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = _matrix(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("y"), *[pa.array(c) for c in x.T]], ["y", *names])

    measured = rows.select("y", "text").mapInArrow(over, "y int, " + ", ".join(f"{c} double" for c in names))
    got = measured.orderBy(*names, "y").limit(sample).toPandas()
    return fit(got[names].to_numpy(dtype=np.float64), got["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            got = model.scores(_matrix(part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(over, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document scored by a model that saw no label of the held-out fifth."""
    model = learn(docs, labels, allowed=fold(F.col("doc_id"), 5) != 0)
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
