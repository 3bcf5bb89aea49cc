"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  A category's model is a logistic
regression over words and word beginnings, and over the probabilities of the categories
before it.  In training those probabilities are out of fold: each document's comes from
a model that did not see it, so a later model learns how far an earlier one can be
trusted on new texts.

Training uses at most ``SAMPLE`` labelled documents, those with the smallest hash of
their id.  Their words are counted in Spark; the driver gets at most ``VOCABULARY``
words and the sample's word numbers.  Scoring is a map over all documents, each
in one pass over its whole text, without a shuffle.

Defined results: a null or blank text has no words and gets the intercepts' answer;
rows with a null id are scored like any other; repeated ids are scored row by row; a
document with several labels has a category if any row says so; a category without
both kinds of rows has a constant probability; an empty table gives an empty one; extra
columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kinmatch.llm.common import fresh, slices
from kinmatch.session import durable

SAMPLE = 20_000
VOCABULARY = 2_000
FOLDS = 4
STEPS = 150
RIDGE = 1e-4
THRESHOLD = 0.5
#: A word or beginning is a feature when it is in this many sample documents of a category ...
LEAST_DOCS = 4
#: ... and its count there is this many standard deviations above what independence gives.
LEAST_Z = 6.0
BEGINNINGS = (4, 5, 6)

WORD = re.compile(rb"[^\x00-\x60\x7B-\x7F]+")

#: The chain over the columns of ``labels``: toxic prose, toxic junk, then any toxicity.
CATEGORIES = {
    "toxic_prose": "toxic = 1 AND quality = 1",
    "toxic_junk": "toxic = 1 AND quality = 0",
    "toxic": "toxic = 1",
}


def marks(text: str | None) -> set[bytes]:
    """The distinct words of a text and the beginnings of longer words (ending in ``*``)."""
    words = set(WORD.findall(text.encode().lower())) if text else set()
    for n in BEGINNINGS:
        words |= {w[:n] + b"*" for w in words if len(w) > n and w[-1:] != b"*"}
    return words


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[bytes, int]
    #: Per category: a weight per word, one per earlier category, and the intercept.
    words: list[np.ndarray]
    earlier: list[np.ndarray]
    intercepts: list[float]

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        vocabulary, keys = self.vocabulary, self.vocabulary.keys()
        found = [[vocabulary[w] for w in marks(t) & keys] for t in texts]
        out = np.zeros((len(found), len(self.categories)))
        for c, (weights, before, start) in enumerate(zip(self.words, self.earlier, self.intercepts)):
            logits = np.array([weights[i].sum() for i in found], dtype=np.float64) + start
            out[:, c] = logistic(logits + out[:, :c] @ before)
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def regression(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of a logistic regression over sparse 0/1 words and dense columns, both kinds weighted alike.

    Accelerated gradient descent over all rows; ``rows`` and ``cols`` are the places of the ones.
    """
    n = len(y)
    positive = y.sum()
    if positive == 0 or positive == n:
        share = (positive + 0.5) / (n + 1)
        return np.zeros(width), np.zeros(dense.shape[1]), math.log(share / (1 - share))
    weight = np.where(y > 0, n / (2 * positive), n / (2 * (n - positive))) / n
    w, d, b = np.zeros(width), np.zeros(dense.shape[1]), 0.0
    at = (w.copy(), d.copy(), b)
    # A bound of the curvature: a quarter of the largest weighted row norm sum.
    per_row = np.bincount(rows, minlength=n) + 1 + (dense**2).sum(1)
    pace = 4.0 / (float(weight @ per_row) + RIDGE)
    for k in range(STEPS):
        vw, vd, vb = at
        z = np.bincount(rows, vw[cols], n) + dense @ vd + vb
        g = weight * (y - logistic(z))
        new = (
            vw + pace * (np.bincount(cols, g[rows], width) - RIDGE * vw),
            vd + pace * (g @ dense - RIDGE * vd),
            vb + pace * g.sum(),
        )
        push = k / (k + 3)
        at = tuple(a + push * (a - c) for a, c in zip(new, (w, d, b)))
        w, d, b = new
    return w, d, float(b)


def fit_chain(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, folds: np.ndarray, width: int):
    """Word weights, weights of earlier categories and intercepts, category by category."""
    n, many = labels.shape
    out_of_fold = np.zeros((n, many))
    models = []
    for c in range(many):
        y = labels[:, c]
        for f in range(FOLDS):
            seen = folds != f
            place = np.cumsum(seen) - 1
            inside = seen[rows]
            w, d, b = regression(place[rows[inside]], cols[inside], out_of_fold[seen, :c], y[seen], width) if seen.any() else (np.zeros(width), np.zeros(c), 0.0)
            z = np.bincount(rows, w[cols], n) + out_of_fold[:, :c] @ d + b
            out_of_fold[~seen, c] = logistic(z)[~seen]
        models.append(regression(rows, cols, out_of_fold[:, :c], y, width) if n else (np.zeros(width), np.zeros(c), -20.0))
    return models


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Train the chain on at most ``sample`` labelled documents."""
    names = [f"y{i}" for i in range(len(categories))]
    flags = [F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(n) for n, e in zip(names, categories.values())]
    known = labels.filter("doc_id IS NOT NULL").select("doc_id", *flags).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids, so the broadcast is bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = pa.array([sorted(marks(t)) for t in part.column("text").to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("fold", *names)], found], ["fold", *names, "marks"])

    kind = "fold int, " + ", ".join(f"{n} int" for n in names) + ", marks array<binary>"
    measured = durable(texts.select("text", fold.alias("fold"), *names).mapInArrow(over, kind))

    # A mark's count in a category against what independence gives, over the whole sample.
    sizes = measured.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    counts = measured.select(F.explode("marks").alias("mark"), *names).groupBy("mark").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]
    )

    def surplus(name: str) -> Column:
        mean = F.col("n") * F.lit((sizes[name] or 0) / max(1, sizes["n"]))
        return F.when(F.col(name) >= LEAST_DOCS, (F.col(name) - mean) / F.sqrt(mean + F.lit(1e-9))).otherwise(0.0)

    best = counts.withColumn("z", F.greatest(*[surplus(n) for n in names], F.lit(0.0))).filter(F.col("z") >= LEAST_Z)
    words = [bytes(r[0]) for r in best.orderBy(F.desc("z"), "mark").limit(VOCABULARY).select("mark").collect()]
    vocabulary = {w: i for i, w in enumerate(words)}

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [[vocabulary[w] for w in ws if w in vocabulary] for ws in part.column("marks").to_pylist()]
            yield part.set_column(part.num_columns - 1, "marks", pa.array(found, pa.list_(pa.int32())))

    table = measured.mapInArrow(numbered, kind.replace("binary", "int")).limit(sample).toArrow()
    ids = table.column("marks").to_pylist()
    rows = np.repeat(np.arange(len(ids)), [len(i) for i in ids]).astype(np.int64)
    cols = np.array([x for i in ids for x in i], dtype=np.int64)
    y = np.array([table.column(n).to_numpy() for n in names], dtype=np.float64).T.reshape(-1, len(names))
    models = fit_chain(rows, cols, y, table.column("fold").to_numpy(), len(words))
    return Chain(list(categories), vocabulary, [m[0] for m in models], [m[1] for m in models], [m[2] for m in models])


def with_probabilities(docs: DataFrame, chain: Chain, name: str, text: str = "text") -> DataFrame:
    """``docs`` with an array column of the categories' probabilities, in the chain's order."""
    columns = [c for c in docs.columns if c != name]

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            got = chain.probabilities(part.column(text).to_pylist())
            scores = pa.array(list(got), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    base = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = StructType([*base.schema.fields, StructField(name, ArrayType(DoubleType()))])
    return base.mapInArrow(over, schema)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose last category, any toxicity, stays below the threshold."""
    name = fresh(docs, "probabilities")
    scored = with_probabilities(docs, chain, name)
    kept = F.element_at(F.col(name), -1) < threshold
    return scored.filter(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: a probability per category and the verdict."""
    chain = learn(docs, labels)
    scored = with_probabilities(docs.select("doc_id", "text"), chain, "probabilities")
    each = [F.get("probabilities", i).alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return scored.select(
        "doc_id", *each, F.element_at("probabilities", -1).alias("score"), (F.element_at("probabilities", -1) >= THRESHOLD).alias("toxic")
    )
