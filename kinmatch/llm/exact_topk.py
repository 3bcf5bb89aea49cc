"""Exact top-k inner products, pruned by segment statistics from coarse to fine.

Vectors are cut in segments, at several resolutions.  With ``m`` the mean and ``s`` the
deviation of a segment of length ``n``, the squared distance of two vectors is at least
the sum over segments of ``n * ((mq - mx)^2 + (sq - sx)^2)``, and since
``2 * <q, x> = |q|^2 + |x|^2 - |q - x|^2`` the inner product is at most the sum of
``n * (mq * mx + sq * sx)``.  A task keeps each query's k best so far; vectors whose bound
is below the k-th are dropped, resolution by resolution, and only the survivors'
products are computed, in whole numbers.

The queries go to the tasks in blocks of at most ``QUERY_BLOCK``, so what is broadcast is
bounded; each block is one scan of the vectors, which are never shuffled.  A task
returns at most k rows for each query of the block.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part, nor do rows without id; shorter vectors count as padded with
zeros; repeated rows are candidates each on their own; of repeated query ids the
smallest vector asks; equal scores are ordered by id; an empty table gives an empty
one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.operators.ranking import numbered, top_k_per_group

SCALE = 256
K = 5
QUERY_BLOCK = 4096
TILE = 1024
RESOLUTIONS = (1, 4, 16)
EXACT_FLOAT = 2.0**53


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector in whole numbers, of the rows that take part."""
    e = F.col(embedding)

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    usable = F.col(vec_id).isNotNull() & e.isNotNull() & F.forall(e, finite)
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Per row: means, then deviations, of ``parts`` segments, each times the root of its length."""
    cuts = np.unique(np.linspace(0, x.shape[1], parts + 1).astype(int))
    lengths = np.diff(cuts)
    if not len(lengths):
        return np.zeros((len(x), 0))
    real = x.astype(np.float64)
    sums = np.add.reduceat(real, cuts[:-1], axis=1)
    squares = np.add.reduceat(real**2, cuts[:-1], axis=1)
    means = sums / lengths
    return np.concatenate([means, np.sqrt(np.maximum(squares / lengths - means**2, 0))], axis=1) * np.tile(np.sqrt(lengths), 2)


class Searcher:
    """The k best candidates seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.best = np.zeros((0, 3), dtype=np.int64)  # query number, score, candidate id
        self.floor = np.full(len(ids), -np.inf)
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        self.statistics: dict = {}

    def _query_side(self, width: int, parts: int) -> np.ndarray:
        if (width, parts) not in self.statistics:
            self.statistics[width, parts] = segment_statistics(widened(self.queries, width), parts)
        return self.statistics[width, parts]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Look at candidates ``ids`` with vectors ``x``."""
        width = max(x.shape[1], self.queries.shape[1])
        q, x = widened(self.queries, width), widened(x, width)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        alive = np.ones((len(q), len(x)), dtype=bool)
        if np.isfinite(self.floor).any():
            for parts in RESOLUTIONS:
                bound = self._query_side(width, parts) @ segment_statistics(x, parts).T
                slack = 1e-9 * self.norms[:, None] * norms[None, :] + 1e-6
                alive &= bound + slack >= self.floor[:, None]
                # Vectors that no query wants any more are not looked at again.
                wanted = alive.any(0)
                ids, x, norms, alive = ids[wanted], x[wanted], norms[wanted], alive[:, wanted]
        alive &= self.ids[:, None] != ids[None, :]
        row, col = np.nonzero(alive)
        if not len(row):
            return
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
        if len(row) * 4 > alive.size and largest < EXACT_FLOAT:
            # Sums of whole numbers below 2^53 are exact in doubles.
            scores = (q.astype(np.float64) @ x.astype(np.float64).T)[row, col].astype(np.int64)
        else:
            scores = np.concatenate([np.einsum("ij,ij->i", q[row[i : i + 65536]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
        good = scores >= self.floor[row]
        new = np.stack([row[good], scores[good], ids[col[good]]], axis=1)
        merged = np.concatenate([self.best, new])
        merged = merged[np.lexsort((merged[:, 2], -merged[:, 1], merged[:, 0]))]
        start = np.searchsorted(merged[:, 0], np.arange(len(q)))
        place = np.arange(len(merged)) - start[merged[:, 0]]
        self.best = merged[place < self.k]
        last = self.best[place[place < self.k] == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]


def top_products(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the other rows.

    Both inputs are (vec_id long, v array<long>).
    """
    spark = candidates.sparkSession
    asked = numbered(queries.groupBy("vec_id").agg(F.min("v").alias("v")), [F.col("vec_id")], "n", start=0)
    total = asked.count()

    def block(first: int) -> DataFrame:
        part = asked.filter(F.col("n").between(first, first + QUERY_BLOCK - 1)).select("vec_id", "v").toArrow().combine_chunks()
        vectors = part.column("v").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.int64()))
        shared = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), matrix(vectors)))

        def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, wanted = shared.value
            found = Searcher(ids, wanted, k)
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    tile = batch.slice(at, TILE)
                    found.add(tile.column("vec_id").to_numpy(), matrix(tile.column("v")))
            best = found.best
            columns = [ids[best[:, 0]], best[:, 2], best[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        return candidates.mapInArrow(over, "query_id long, vec_id long, score long")

    found = reduce(DataFrame.union, [block(first) for first in range(0, max(total, 1), QUERY_BLOCK)])
    ranked = top_k_per_group(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = K) -> DataFrame:
    """The k best of each fiftieth id among all other rows."""
    rows = whole_vectors(embeddings)
    return top_products(rows, rows.filter(F.col("vec_id") % 50 == 0), k)


ORACLE = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE}))::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {K}"""
