"""Nearest companies per field, and the two-stage search, from a store by pivot."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import similarity as S
from kinmatch.plans.search import _best
from kinmatch.schemas import FIELD_WEIGHTS, TOP_K_PER_FIELD, TOP_N
from kinmatch.session import durable
from kinmatch.sources.pivots import PivotStore

#: What the distance to a pivot may be off by, relative to the vectors' size.
SLACK = 1e-6


@dataclass
class Share:
    """How much of a store a search read: vectors that are in a pivot that some query wanted, and pairs that were compared at most."""

    vectors: int = 0
    read: int = 0
    pairs: int = 0
    wanted: int = 0


@dataclass
class _Field:
    """The queries of a block for one field and length, and the pivots."""

    ids: list
    matrix: object
    pivots: list
    members: object
    apart: object = None
    lower: object = None
    cut: object = None
    read: object = None


def _fields(block: S.Block, store: PivotStore, k: int) -> dict:
    """Per field and length: lower bounds of queries to pivots, and which pivots are read first: the nearest that hold ``k`` vectors."""
    import numpy as np

    spheres = {(r["field_name"], r["pivot"]): r for r in store.spheres.collect()}  # one row per pivot
    centres: dict = {}
    for r in store.pivots.orderBy("field_name", "pivot").collect():
        if (r["field_name"], r["pivot"]) in spheres:
            centres.setdefault((r["field_name"], len(r["embedding"])), []).append((r["pivot"], np.array(r["embedding"], dtype=np.float64)))
    out = {}
    for name, groups in block.matrices.items():
        for ids, matrix in groups:
            found = centres.get((name, matrix.shape[1]))
            if not found:
                continue
            pivots = [p for p, _ in found]
            held = [spheres[name, p] for p in pivots]
            members, least, most = (np.array([h[c] for h in held], dtype=np.float64) for c in ("members", "least", "most"))
            middle = np.stack([v for _, v in found])
            apart = np.sqrt(np.stack([((matrix - c) ** 2).sum(1) for c in middle], axis=1))
            slack = SLACK * (1 + np.abs(middle).sum(1))
            f = _Field(list(ids), matrix, pivots, members.astype(np.int64), apart)
            f.lower = np.maximum(0, np.maximum(apart - most, least - apart) - slack)
            order = np.argsort(apart, axis=1, kind="stable")
            before = np.cumsum(members[order], axis=1) - members[order]
            f.read = np.zeros(apart.shape, dtype=bool)
            np.put_along_axis(f.read, order, before < k, axis=1)
            # Within the largest reach of the first pivots there are k vectors, if there are so many.
            reach = np.where(f.read, apart + most + slack, 0).max(1)
            f.cut = np.where(members.sum() >= k, reach, np.inf)
            out[name, matrix.shape[1]] = f
    return out


def _scan(store: PivotStore, fields: dict, wanted: dict, k: int) -> DataFrame:
    """query_id, company_id, field_name, distance of the pairs that can be among the ``k`` nearest, from the wanted pivots alone."""
    import numpy as np

    todo, cond = {}, F.lit(False)
    for (name, length), f in fields.items():
        use = wanted[name, length]
        pivots = [p for j, p in enumerate(f.pivots) if use[:, j].any()]
        if pivots:
            cond = cond | ((F.col("field_name") == name) & F.col("pivot").isin(pivots))
        for j, p in enumerate(f.pivots):
            if use[:, j].any():
                queries = np.flatnonzero(use[:, j])
                todo[name, p] = (queries, f.apart[queries, j])
    cuts = {(name, f"{length}"): (f.ids, f.matrix, f.cut) for (name, length), f in fields.items()}
    shared = store.spark.sparkContext.broadcast((todo, cuts))  # as large as the block and the pivots

    def run(batches):
        import pyarrow as pa

        todo, cuts = shared.value
        # The ``k`` smallest distances of each query, infinite where fewer are known.
        seen = {key: np.full((0, len(ids)), np.inf) for key, (ids, _, _) in cuts.items()}
        for batch in batches:
            names, pivots = batch.column("field_name").to_pylist(), batch.column("pivot").to_pylist()
            apart = batch.column("apart").to_numpy(zero_copy_only=False)
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            places: dict = {}
            for i, key in enumerate(zip(names, pivots)):
                places.setdefault(key, []).append(i)
            for key, own in places.items():
                if key not in todo:
                    continue
                queries, far = todo[key]
                group = key[0], key[1].split("-")[0]
                ids, vectors, cut = cuts[group]
                matrix = vectors[queries]
                for at in range(0, len(own), max(1, S.CELLS // len(queries))):
                    rows = np.array(own[at : at + max(1, S.CELLS // len(queries))])
                    held = seen[group][:, queries]
                    last = held.max(axis=0) if len(held) == k else np.inf
                    most = np.minimum(cut[queries], last)
                    # The distances to the pivot bound the distance of the pair.
                    maybe = (np.abs(apart[rows][:, None] - far[None, :]) <= most[None, :] + SLACK * (1 + far)[None, :]).any(1)
                    rows = rows[maybe]
                    if not len(rows):
                        continue
                    block = flat[starts[rows][:, None] + np.arange(matrix.shape[1])[None, :]].astype(np.float64)
                    i, q, distance = S._within(block, matrix, most)
                    every = np.concatenate([held, np.full((len(rows), len(queries)), np.inf)])
                    every[len(held) + i, q] = distance
                    if len(every) > k:
                        every.partition(k - 1, axis=0)
                        every = every[:k]
                    if len(every) > len(held):
                        seen[group] = np.concatenate([seen[group], np.full((len(every) - len(held), len(ids)), np.inf)])
                    seen[group][:, queries] = every
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[x] for x in queries[q]], pa.string()),
                            batch.column("company_id").take(pa.array(rows[i])),
                            pa.array([key[0]] * len(i), pa.string()),
                            pa.array(distance),
                        ],
                        ["query_id", "company_id", "field_name", "distance"],
                    )

    return store.vectors.filter(cond).mapInArrow(run, "query_id string, company_id string, field_name string, distance double")


def nearest_from_pivots(
    store: PivotStore, queries: S.QuerySet, k: int = TOP_K_PER_FIELD, min_similarity: float | None = None, share: Share | None = None
) -> DataFrame:
    """The ``k`` nearest companies by distance for each query and field, as ``similarity.nearest_per_field`` gives them.

    The pivots next to a query that hold ``k`` vectors are read first.  Their ``k``-th distance then says which other
    pivots can hold anything nearer; only those are read as well.
    """

    def over(block: S.Block) -> DataFrame:
        import numpy as np

        fields = _fields(block, store, k)
        if share is not None:
            share.vectors += sum(r["members"] for r in store.spheres.select("members").collect())
            share.pairs += sum(len(f.ids) * int(f.members.sum()) for f in fields.values())
        first = durable(S.rank_by_distance(_scan(store, fields, {key: f.read for key, f in fields.items()}, k), k))
        place = {key: {q: i for i, q in enumerate(f.ids)} for key, f in fields.items()}
        # One number per query vector of the block.
        for r in first.filter(F.col("rank") == k).select("query_id", "field_name", "distance").collect():
            for (name, _), f in fields.items():
                if name == r["field_name"] and r["query_id"] in place[name, _]:
                    i = place[name, _][r["query_id"]]
                    f.cut[i] = min(f.cut[i], r["distance"])
        more = {key: ~f.read & (f.lower <= f.cut[:, None]) for key, f in fields.items()}
        if share is not None:
            for key, f in fields.items():
                used = f.read | more[key]
                share.read += int(f.members[used.any(0)].sum())
                share.wanted += int((used * f.members[None, :]).sum())
        found = first.drop("rank")
        if any(np.any(m) for m in more.values()):
            found = found.unionByName(_scan(store, fields, more, k))
        return S.rank_by_distance(found, k, min_similarity)

    return queries.scan(over)


def scores_of(corpus: DataFrame, pairs: DataFrame, queries: S.QuerySet) -> DataFrame:
    """Total and similarities of the listed (query_id, company_id) alone; profiles of other companies do not reach Python."""
    weights = queries.weights
    asked = pairs.groupBy("company_id").agg(F.collect_set("query_id").alias("asked"))
    rows = S.profiles(corpus).join(durable(asked), "company_id")

    def over(block: S.Block) -> DataFrame:
        def run(batches):
            import numpy as np

            scorer = S._Scorer(block, weights)
            place = {q: i for i, q in enumerate(scorer.ids)}
            for batch in batches:
                at, asked = 0, batch.column("asked").to_pylist()
                for companies, similarities, total, _ in scorer.slices(batch):
                    hits = [(i, place[q]) for i, names in enumerate(asked[at : at + len(companies)]) for q in names if q in place]
                    at += len(companies)
                    if hits:
                        i, q = np.array(hits).T
                        yield S._scored(scorer, companies, similarities, total, i, q)

        return rows.mapInArrow(run, S._SCORED)

    return S._shown(queries.scan(over), queries)


def search_two_stage_pivots(
    store: PivotStore,
    corpus: DataFrame,
    query: DataFrame,
    n: int = TOP_N,
    k: int = TOP_K_PER_FIELD,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    exclude_self: bool = False,
    min_similarity: float | None = None,
) -> DataFrame:
    """``plans.search.search_two_stage`` with candidates from a store by pivot; ``corpus`` scores them."""
    queries = S.query_set(query, weights)
    found = S.candidate_companies(nearest_from_pivots(store, queries, k, min_similarity))
    scores = scores_of(corpus, found, queries)
    if exclude_self:
        scores = scores.filter(F.col("company_id") != F.col("query_id"))
    return _best(scores, n)
