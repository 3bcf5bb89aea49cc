"""Centroid clustering with bounds that are loosened by geometry.

Every vector keeps its cluster, an upper bound of the distance to its centroid and a
lower bound of the distance to every other one.  When centroids move, the upper bound
grows by the move of its own.  The lower bound would shrink by the largest move of any
other centroid; here it shrinks by less, as only moves towards the cluster count:

A cluster's vectors lie in the sphere around its old centroid that has their largest
upper bound as its radius.  Let ``m`` be the middle of the move of another centroid, of
length ``D``.  A vector that is seen from ``m`` at the angle ``t`` to the move comes nearer
by at most ``D * cos(t)``.  All this happens in the plane through the move and the centre of
the sphere: the smallest ``t`` belongs to the tangent from ``m`` to the sphere.  Where that is
beyond a right angle, the bound stays as it is.

Vectors whose upper bound is below their lower one, or below half the way to the next
centroid, keep their cluster.  The others are compared with all centroids, exactly.

Everything that is decided is decided in whole numbers: distances are exact, centroids are floors of
exact means, and sums follow from the vectors that changed their cluster.  Bounds are doubles with slack.

Scale.  Vectors are stored once, bucketed by a row number; the state (cluster and bounds,
some twenty bytes a vector) is stored in the same buckets each round, and joined without a shuffle of either.  A
round sends to the driver one sum per cluster and component.  Nothing is broadcast but
the centroids.  A round in which no centroid moves is the last.

Defined results: vectors that are null, have another number of components, or hold a null or a component that
is not finite take no part; components beyond ``MOST`` end the job with an error, as their
distances do not fit 64 bits; a null id counts as an empty text in the draw of the
first centroids; repeated rows are vectors each on their own, and of equal draws the smaller
vector comes first; with fewer vectors than clusters every vector starts one; an
empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.buckets import Bucketed
from kinmatch.session import durable

SCALE = 1024
SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Groups in which the sums of tasks are added up before they meet.
SALTS = 64
#: The largest magnitude of a component: differences of whole components then stay below 2^28.
MOST = 131072.0
EXACT_FLOAT = 2.0**53


def whole_vectors(vectors: DataFrame, size: int = SIZE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the vector in whole numbers, of the rows that take part."""
    e = F.col(embedding)

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def whole(x: Column) -> Column:
        x = x.cast("double")
        error = F.raise_error(F.lit(f"a component is beyond {MOST}")).cast("int")
        return F.when(F.abs(x) > MOST, error).otherwise(F.floor(x * SCALE).cast("int"))

    kept = vectors.filter(e.isNotNull() & (F.size(e) == size) & F.forall(e, finite))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors and centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4.0 * x.shape[1] * most**2 < EXACT_FLOAT:
        # Sums of whole numbers below 2^53 are exact in doubles.
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much at most any other centroid came nearer to a vector within ``radius`` of its old centroid."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    moved = b - a
    length = np.sqrt((moved**2).sum(1))
    unit = np.divide(moved, length[:, None], out=np.zeros_like(moved), where=length[:, None] > 0)
    seen = a[:, None, :] - ((a + b) / 2)[None, :, :]  # from the middle of each move to each centre
    far = np.sqrt((seen**2).sum(2))
    along = (seen * unit[None, :, :]).sum(2)
    reach = np.maximum(radius, 0)[:, None]
    inside = reach >= far
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(along / far, -1, 1)) - np.arcsin(np.clip(reach / far, 0, 1))
    nearer = np.where(inside, length[None, :], length[None, :] * np.cos(np.clip(np.nan_to_num(angle), 0, np.pi / 2)))
    nearer = np.where(length[None, :] > 0, np.minimum(nearer + 1e-9 * (1 + length[None, :]), length[None, :]), 0.0)
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(1, initial=0.0)


@dataclass
class Step:
    """What the tasks of a round need: the centroids, and how bounds change for each cluster."""

    centres: np.ndarray
    drift: np.ndarray
    loose: np.ndarray
    last: bool

    def __post_init__(self):
        apart = np.sqrt(np.maximum(distances(self.centres, self.centres), 0).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """New clusters and bounds of vectors ``x`` (cluster -1 for none), exact distances if this is the last round, and which were scanned."""
        k = len(self.centres)
        known = cluster >= 0
        at = np.maximum(cluster, 0)
        upper = np.where(known, upper + self.drift[at], np.inf)
        lower = np.where(known, lower - self.loose[at], 0.0)
        open_ = np.flatnonzero(upper * (1 + 1e-9) + 1e-6 >= np.maximum(lower, self.half[at]) * (1 - 1e-9))
        cluster, distance = cluster.copy(), None
        if len(open_):
            d = distances(x[open_], self.centres)
            best = d.argmin(1)  # the first of equal ones
            near = d[np.arange(len(best)), best]
            d[np.arange(len(best)), best] = np.iinfo(np.int64).max
            cluster[open_] = best
            upper[open_] = np.sqrt(near.astype(np.float64))
            lower[open_] = np.sqrt(d.min(1).astype(np.float64)) if k > 1 else np.inf
        if self.last:
            distance = ((x - self.centres[cluster]) ** 2).sum(1) if len(x) else np.zeros(0, dtype=np.int64)
        return cluster, upper, lower, distance, open_


STATE = "row long, vec_id long, cluster int, upper double, lower double, distance long, moved array<long>, reach array<double>"


def _kernel(step, size):
    """A round over Arrow batches; one row of each task carries its sums, counts, number of scans and radii."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = step.value
        k = len(todo.centres)
        sums = np.zeros((k, size + 2), dtype=np.int64)
        reach = np.full(k, -1.0)
        held = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, size).astype(np.int64)
            if "cluster" in batch.schema.names:
                was, up, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
            else:
                was, up, low = np.full(n, -1), np.zeros(n), np.zeros(n)
            now, up, low, distance, scanned = todo.assign(x, np.asarray(was).astype(np.int64), up, low)
            for c in range(k):
                into, out = (now == c) & (was != c), (was == c) & (now != c)
                sums[c, :size] += x[into].sum(0) - x[out].sum(0)
                sums[c, size] += into.sum() - out.sum()
                reach[c] = max(reach[c], up[now == c].max(initial=-1.0))
            sums[0, size + 1] += len(scanned)
            if held:
                yield _state(held, None)
            held = [
                batch.column("row"),
                batch.column("vec_id"),
                pa.array(now.astype(np.int32)),
                pa.array(up),
                pa.array(low),
                pa.nulls(n, pa.int64()) if distance is None else pa.array(distance),
            ]
        if held:
            yield _state(held, (sums, reach))

    return run


def _state(columns: list, totals: tuple | None) -> pa.RecordBatch:
    """State rows; the first carries the totals, if there are any."""
    n = len(columns[0])
    lists = []
    for values, kind in zip(totals or (None, None), (pa.int64(), pa.float64())):
        first = [None if values is None else values.reshape(-1).tolist()]
        lists.append(pa.concat_arrays([pa.array(first, pa.list_(kind)), pa.nulls(n - 1, pa.list_(kind))]))
    return pa.RecordBatch.from_arrays([*columns, *lists], ["row", "vec_id", "cluster", "upper", "lower", "distance", "moved", "reach"])


def _totals(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what the tasks' rows carry, and the largest radii; ``SALTS`` groups are added up by themselves first."""

    def add(table: pa.Table) -> pa.Table:
        moved = np.array(table.column("moved").to_pylist(), dtype=object).sum(0)
        reach = np.array(table.column("reach").to_pylist(), dtype=np.float64).max(0)
        return pa.table({"moved": pa.array([moved.tolist()], pa.list_(pa.int64())), "reach": pa.array([reach.tolist()], pa.list_(pa.float64()))})

    parts = state.filter("moved IS NOT NULL").select("moved", "reach", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    moved, reach = np.zeros(k * (size + 2), dtype=object), np.full(k, -1.0)
    for r in parts.groupBy("salt").applyInArrow(add, "moved array<long>, reach array<double>").collect():
        moved, reach = moved + np.array(r["moved"], dtype=object), np.maximum(reach, r["reach"])
    return moved.reshape(k, size + 2), reach


@dataclass
class Clusters:
    """Vectors with their cluster and exact squared distance, the final centroids, and how many vectors each round compared with all of them."""

    members: DataFrame
    centres: np.ndarray
    scanned: list[int] = field(default_factory=list)


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose hashed ids are the smallest, in that order."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = rows.select("v", draw.alias("draw")).orderBy("draw", "v").limit(k).collect()
    return np.array([r["v"] for r in drawn], dtype=np.int64)


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> Clusters:
    """Clusters of whole vectors (vec_id, v) after ``rounds`` rounds and a last assignment."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = Bucketed(rows.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), "row", buckets)
    centres = first_centres(vectors.rows, k, seed)
    if not len(centres):
        vectors.drop()
        empty = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).filter("false")
        return Clusters(empty, centres)
    k = len(centres)
    sums = np.zeros((k, size + 1), dtype=object)
    drift = loose = np.zeros(k)
    state, scanned, still = None, [], False
    for n in range(rounds + 1):
        last = n == rounds or still
        step = spark.sparkContext.broadcast(Step(centres, drift, loose, last))
        known = vectors.rows
        if state is not None:
            known = known.join(state.rows.select("row", "cluster", "upper", "lower").hint("shuffle_hash"), "row")
        new = Bucketed(known.mapInArrow(_kernel(step, size), STATE), "row", buckets)
        if state is not None:
            state.drop()
        state = new
        moved, radius = _totals(state.rows, k, size)
        step.unpersist()
        scanned.append(int(moved[0, size + 1]))
        if last:
            break
        sums += moved[:, : size + 1]
        before = centres
        centres = np.array([[s // c[-1] for s in c[:-1]] if c[-1] else old for c, old in zip(sums.tolist(), before.tolist())], dtype=np.int64)
        drift = np.sqrt(((centres - before) ** 2).sum(1).astype(np.float64))
        loose = loosening(before, centres, radius)
        still = not drift.any()
    members = durable(state.rows.select("vec_id", "cluster", "distance"))
    state.drop()
    vectors.drop()
    return Clusters(members, centres, scanned)


def clustering(embeddings: DataFrame) -> DataFrame:
    """One row per vector that takes part: cluster, distance, inertia of the cluster and of all, digest of the centroid."""
    got = cluster(whole_vectors(embeddings))
    spark = embeddings.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in got.centres.tolist()]
    inertia = {r["cluster"]: r["i"] for r in got.members.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    rows = [(c, i, sum(inertia.values()), digests[c]) for c, i in inertia.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.members.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _rounds(n: int) -> str:
    """The centroids after each round; vectors are lists of doubles that hold whole numbers."""
    out = [
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v)) - 1 AS cluster, v AS c
  FROM usable ORDER BY 1 LIMIT {CLUSTERS})"""
    ]
    for i in range(n):
        out.append(f"a{i} AS MATERIALIZED ({_assigned(f'c{i}')})")
        out.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY place) AS c FROM (
    SELECT cluster, place, floor(sum(x)::DOUBLE / count(*)) AS m
    FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {SIZE} + 1)) AS place FROM a{i}) GROUP BY 1, 2) GROUP BY 1)""")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (cluster))")
    return ",\n".join([*out, f"a{n} AS MATERIALIZED ({_assigned(f'c{n}')})"])


def _assigned(centres: str) -> str:
    return f"""SELECT nth, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance
  FROM (SELECT nth, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM usable, {centres}) GROUP BY nth"""


ORACLE = f"""
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE}))::DOUBLE[] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
{_rounds(ROUNDS)}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)"""
