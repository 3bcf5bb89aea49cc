"""Weighted multi-field similarity of a query set against a corpus of vectors.

Corpus rows are ``(company_id, field_name, embedding)``, one per company and field, or
profiles ``(company_id, fields)`` with all fields of a company in one row.  Query rows
are ``(query_id, field_name, embedding)``.

The query set is cut in blocks of a bounded size.  A block travels to the tasks as one
matrix per field, and each Arrow batch of corpus vectors is multiplied with it; all query
sets, of whatever size, take this way.  With profiles a task also adds up the total
scores, and only what can be among the best leaves it.

A null, empty or zero vector, one of another length, and one with a null or a value that
is not finite have similarity 0.0 and no distance; as a query it is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import vectors as V
from kinmatch.operators.ranking import top_k_per_group
from kinmatch.schemas import FIELD_WEIGHTS, TOP_K_PER_FIELD
from kinmatch.session import durable

# A block of queries has about this many vectors and elements (64 MB).
BLOCK_ROWS = 5_000
BLOCK_ELEMENTS = 8_000_000
# Pairs of a company and a query that a task holds at a time.
CELLS = 1_000_000


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """Drop records without company, field or vector."""
    named = (F.col("company_id") != "") & (F.col("field_name") != "")
    return vectors.filter(named & F.col("embedding").isNotNull())


def weighted_fields(query: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """Query rows whose field carries a weight other than zero and whose vector can be compared."""
    listed = F.col("field_name").isin([f for f, w in weights.items() if w])
    return query.filter(listed & V.is_finite(F.col("embedding")) if "embedding" in query.columns else listed)


def weight_of(name: Column, weights: Mapping[str, float] = FIELD_WEIGHTS) -> Column:
    """Weight of a field name, 0.0 when the field is not listed."""
    value = F.lit(0.0)
    for listed, weight in weights.items():
        value = F.when(name == listed, F.lit(float(weight))).otherwise(value)
    return value


@dataclass
class Block:
    """Some queries with all their fields: ids, and per field ``(ids, matrix)`` pairs, one per vector length."""

    ids: list[str] = field(default_factory=list)
    matrices: dict = field(default_factory=dict)


@dataclass
class QuerySet:
    """Weighted query vectors, read block by block."""

    rows: DataFrame
    weights: Mapping[str, float]
    size: int = 1

    @property
    def listed(self) -> list[str]:
        return [f for f, w in self.weights.items() if w]

    def blocks(self) -> Iterator[Block]:
        """One block after the other, so that the driver holds a single one."""
        import numpy as np

        for n in range(self.size):
            part = self.rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(self.size)) == n) if self.size > 1 else self.rows
            vectors: dict = {}
            for row in part.toArrow().to_pandas().sort_values(["query_id", "field_name"]).itertuples():
                vectors[row.field_name, row.query_id] = np.asarray(row.embedding, dtype=np.float64)
            by_length: dict = {}
            for (name, query), vector in vectors.items():
                by_length.setdefault(name, {}).setdefault(len(vector), []).append((query, vector))
            matrices = {
                name: [(np.array([q for q, _ in pairs], dtype=object), np.stack([v for _, v in pairs])) for _, pairs in sorted(groups.items())]
                for name, groups in by_length.items()
            }
            yield Block(sorted({q for _, q in vectors}), matrices)

    def scan(self, over: Callable[[Block], DataFrame]) -> DataFrame:
        """``over`` of every block; with more than one each result is stored before the next block is read."""
        if self.size == 1:
            return over(next(self.blocks()))
        return reduce(DataFrame.unionByName, [durable(over(block)) for block in self.blocks()])


def query_set(
    query: DataFrame,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    block_rows: int = BLOCK_ROWS,
    block_elements: int = BLOCK_ELEMENTS,
) -> QuerySet:
    """The usable query vectors, in as many blocks as keep a block to the given size."""
    rows = weighted_fields(query, weights).select("query_id", "field_name", "embedding")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("elements")).first()
    size = max(1, -(-total["n"] // block_rows), -(-(total["elements"] or 0) // block_elements))
    return QuerySet(rows if size == 1 else durable(rows), weights, size)


def _batch_kernel(matrices, new_rule, scores, cells=CELLS):
    """An Arrow batch function that scores each corpus row with its field's queries.

    ``new_rule`` makes the rule of a task, which picks rows and queries and gives one array of values
    per name in ``scores``.  ``cells`` bounds the pairs that are held at a time.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rule = new_rule()

        def emit(companies, rows, ids, name, values):
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    companies.take(pa.array(rows)).cast(pa.string()),
                    pa.repeat(pa.scalar(name, pa.string()), len(rows)),
                    *values,
                ],
                names=["query_id", "company_id", "field_name", *scores],
            )

        def parts(rows, width):
            """Row slices that keep the pairs of one output batch, and its memory, bounded."""
            step = max(1, min(4096, cells // max(1, width)))
            return [rows[at : at + step] for at in range(0, len(rows), step)]

        for batch in batches:
            companies = batch.column("company_id")
            names = batch.column("field_name").to_numpy(zero_copy_only=False)
            arrays = batch.column("embedding")
            lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            # Vectors of one length are one matrix; otherwise each is cut out of the flat values.
            filled = lengths > 0
            # A vector with a null or a value that is not finite compares like one of another length.
            usable = lengths.copy()
            if not np.isfinite(flat).all():
                usable[np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(flat)]] = -1
            even = len(set(lengths[filled])) == 1
            places = np.cumsum(filled) - 1 if even else np.concatenate([[0], np.cumsum(lengths)])
            for name in sorted(set(names)):
                of_field = np.flatnonzero(names == name)
                groups = matrices.get(name, [])
                for ids, matrix in groups:
                    width = matrix.shape[1]
                    queries_here = pa.array(ids, pa.string())
                    for rows in parts(of_field, len(ids)):
                        fits = rows[usable[rows] == width]
                        if not len(fits) or not width:
                            block = np.zeros((len(fits), width))
                        elif even:
                            block = flat.reshape(-1, width)[places[fits]].astype(np.float64)
                        else:
                            block = flat[places[fits][:, None] + np.arange(width)[None, :]].astype(np.float64)
                        picked, queries, values = rule(rows, fits, block, matrix)
                        if len(picked):
                            columns = [pa.array(v, pa.float64(), from_pandas=True) for v in values]
                            yield emit(companies, picked, queries_here.take(pa.array(queries)), name, columns)

    return run


def _cosines(block, matrix):
    """Twelve decimals make equal vectors tie whatever their place in the batch."""
    import numpy as np

    norms = np.linalg.norm(block, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        values = np.where((norms > 0) & np.isfinite(norms), block @ matrix.T / norms, 0.0)
    return np.round(np.clip(np.nan_to_num(values), -1.0, 1.0), 12)


def _pair_rule(rows, fits, block, matrix):
    """Cosine of every row and query of a field; rows of another length have 0."""
    import numpy as np

    cosines = np.zeros((len(rows), len(matrix)))
    cosines[np.searchsorted(rows, fits)] = _cosines(block, matrix)
    return np.repeat(rows, len(matrix)), np.tile(np.arange(len(matrix)), len(rows)), [cosines.ravel()]


class _Smallest:
    """The ``k`` smallest distances that a task has seen so far, for each query of a matrix."""

    def __init__(self, width: int, k: int):
        import numpy as np

        self.k = k
        self.seen = np.full((0, width), np.inf)

    @property
    def last(self):
        """The ``k``-th smallest distance of each query, infinite while fewer are known."""
        import numpy as np

        return self.seen.max(axis=0) if len(self.seen) == self.k else np.full(self.seen.shape[1], np.inf)

    def near(self, block, matrix):
        """Pairs that can be among the ``k`` nearest, and their exact distances."""
        import numpy as np

        at, queries, exact = _within(block, matrix, self.last)
        found = np.full((len(block), len(matrix)), np.inf)
        found[at, queries] = exact
        every = np.concatenate([self.seen, found])
        self.seen = np.partition(every, self.k - 1, axis=0)[: self.k] if len(every) > self.k else every
        kept = exact <= self.last[queries]
        return at[kept], queries[kept], exact[kept]


def _within(block, matrix, most):
    """Pairs at most ``most`` (one value per query) apart, and their exact distances."""
    import numpy as np

    squares = (block * block).sum(axis=1)[:, None] + (matrix * matrix).sum(axis=1)[None, :]
    # The product form only pre-selects; survivors get the exact distance.
    near = squares - 2 * (block @ matrix.T) <= (most * most)[None, :] * (1 + 1e-9) + 1e-6 * (1 + squares)
    queries, at = np.nonzero(near.T)
    exact = np.empty(len(at))
    ends = np.cumsum(near.sum(axis=0))
    for q, end in enumerate(ends.tolist()):
        start = int(ends[q - 1]) if q else 0
        if end > start:
            apart = (block if end - start == len(block) else block[at[start:end]]) - matrix[q]
            exact[start:end] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    exact = np.round(exact, 12)
    kept = exact <= most[queries]
    return at[kept], queries[kept], exact[kept]


def _nearest_rule(k):
    """A rule for one task: what cannot be among the ``k`` nearest of what the task has seen stays in it."""
    known: dict = {}

    def rule(rows, fits, block, matrix):
        import numpy as np

        if not len(fits):
            return fits, fits, [np.zeros(0)]
        smallest = known.setdefault(id(matrix), _Smallest(len(matrix), k))
        at, queries, exact = smallest.near(block, matrix)
        return fits[at], queries, [exact]

    return rule


def field_similarities(vectors: DataFrame, queries: QuerySet) -> DataFrame:
    """``(query_id, company_id, field_name, similarity)`` for every shared field."""
    corpus = vectors.select("company_id", "field_name", "embedding")

    def over(block: Block) -> DataFrame:
        return corpus.filter(F.col("field_name").isin(sorted(block.matrices))).mapInArrow(
            _batch_kernel(block.matrices, lambda: _pair_rule, ["similarity"]),
            "query_id string, company_id string, field_name string, similarity double",
        )

    return queries.scan(over)


def nearest_per_field(
    vectors: DataFrame, queries: QuerySet, k: int = TOP_K_PER_FIELD, min_similarity: float | None = None
) -> DataFrame:
    """The ``k`` nearest companies by distance for each query and field.

    ``min_similarity`` is an opt-in cut on the similarity implied by the distance.
    A task hands on only what is among the ``k`` nearest of all it has seen so far, which can only drop rows that
    could not be among the ``k`` nearest of the whole corpus.
    """
    corpus = vectors.select("company_id", "field_name", "embedding")

    def over(block: Block) -> DataFrame:
        near = corpus.filter(F.col("field_name").isin(sorted(block.matrices))).mapInArrow(
            _batch_kernel(block.matrices, lambda: _nearest_rule(k), ["distance"]),
            "query_id string, company_id string, field_name string, distance double",
        )
        return rank_by_distance(near, k, min_similarity)

    return queries.scan(over)


def profiles(vectors: DataFrame) -> DataFrame:
    """``(company_id, fields)``: all fields of a company in one row; profiles are given back as they are.

    Of several vectors of a field the last one counts (by ``seq``, if there is one).
    Search repeatedly on a stored table of these.
    """
    if "fields" in vectors.columns:
        return vectors
    seq = F.col("seq") if "seq" in vectors.columns else F.lit(0).alias("seq")
    rows = F.sort_array(F.collect_list(F.struct("field_name", seq, "embedding")))
    grouped = usable_vectors(vectors).groupBy("company_id").agg(rows.alias("fields"))
    return grouped.withColumn("fields", F.transform("fields", lambda r: F.struct(r["field_name"], r["embedding"])))


class _Scorer:
    """Scores slices of profiles with the queries of a block."""

    def __init__(self, block: Block, weights: Mapping[str, float]):
        import numpy as np

        self.ids = block.ids
        place = {q: i for i, q in enumerate(block.ids)}
        self.weights = {f: w for f, w in weights.items() if w}
        self.groups = {
            f: [(np.array([place[q] for q in ids]), matrix) for ids, matrix in block.matrices.get(f, [])] for f in self.weights
        }
        self.lacks = {f: np.ones(len(block.ids), dtype=bool) for f in self.weights}
        for f, groups in self.groups.items():
            for places, _ in groups:
                self.lacks[f][places] = False

    def _parts(self, batch, cells=None):
        """Slices of a batch: its first company, how many there are, and per field and query group which have a vector, and the vectors."""
        import numpy as np
        import pyarrow.compute as pc

        lists = batch.column("fields")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        entries = lists.flatten()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        names = pc.struct_field(entries, "field_name").to_numpy(zero_copy_only=False)
        arrays = pc.struct_field(entries, "embedding")
        lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = arrays.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        usable = lengths.copy()
        if not np.isfinite(flat).all():
            usable[np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(flat)]] = -1
        step = max(1, (cells or CELLS) // max(1, len(self.ids) * len(self.weights)))
        for first in range(0, len(sizes), step):
            count = min(step, len(sizes) - first)
            here = np.flatnonzero((owner >= first) & (owner < first + count))
            blocks = []
            for f in self.weights:
                own = here[names[here] == f]
                # The last of several vectors of a field counts.
                own = own[np.append(owner[own][1:] != owner[own][:-1], True)] if len(own) else own
                for queries, matrix in self.groups[f]:
                    fits = own[usable[own] == matrix.shape[1]]
                    if len(fits):
                        vectors = flat[starts[fits][:, None] + np.arange(matrix.shape[1])[None, :]].astype(np.float64)
                        blocks.append((f, owner[fits] - first, queries, vectors, matrix))
            yield first, count, blocks

    def vectors(self, batch):
        """Field, queries, vectors and query matrix of all slices."""
        for _, _, blocks in self._parts(batch):
            for f, _, queries, vectors, matrix in blocks:
                yield f, queries, vectors, matrix

    def slices(self, batch, cells=None):
        """Companies of a batch, their similarities and totals, and their vectors by field and query group."""
        import numpy as np

        names_of = batch.column("company_id")
        for first, count, blocks in self._parts(batch, cells):
            similarities = {f: np.zeros((count, len(self.ids))) for f in self.weights}
            for f, own, queries, vectors, matrix in blocks:
                similarities[f][np.ix_(own, queries)] = _cosines(vectors, matrix)
            total = np.zeros((count, len(self.ids)))
            for f, weight in self.weights.items():
                total = total + similarities[f] * weight
            yield names_of.slice(first, count).to_pylist(), similarities, total, blocks


_SCORED = "query_id string, company_id string, total_score double, similarities array<double>"


def _similarity_lists(scorer, similarities, rows, queries):
    """Similarities by field of companies ``rows`` and ``queries`` as an Arrow list column, null for fields that a query lacks."""
    import numpy as np
    import pyarrow as pa

    fields = list(similarities)
    values = np.stack([similarities[f][rows, queries] for f in fields], axis=1) if fields else np.zeros((len(rows), 0))
    lacks = np.stack([scorer.lacks[f][queries] for f in fields], axis=1) if fields else np.zeros((len(rows), 0), dtype=bool)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(fields)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), mask=lacks.reshape(-1)))


def _scored(scorer, companies, similarities, total, rows, queries, **more):
    """An Arrow batch of the pairs of ``rows`` and ``queries``."""
    import pyarrow as pa

    columns = {
        "query_id": pa.array(scorer.ids, pa.string()).take(pa.array(queries)),
        "company_id": pa.array(companies, pa.string()).take(pa.array(rows)),
        "total_score": pa.array(total[rows, queries]),
        "similarities": _similarity_lists(scorer, similarities, rows, queries),
        **more,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def every_score(corpus: DataFrame, queries: QuerySet) -> DataFrame:
    """Total and similarities of every company for every query: the result itself is all pairs."""

    weights = queries.weights

    def over(block: Block) -> DataFrame:
        def run(batches):
            import numpy as np

            scorer = _Scorer(block, weights)
            n = len(scorer.ids)
            for batch in batches:
                for companies, similarities, total, _ in scorer.slices(batch):
                    rows = np.repeat(np.arange(len(companies)), n)
                    if len(rows):
                        yield _scored(scorer, companies, similarities, total, rows, np.tile(np.arange(n), len(companies)))

        return profiles(corpus).mapInArrow(run, _SCORED)

    return _shown(queries.scan(over), queries)


class _Best:
    """The ``n`` best companies of each query that a task has seen; equal totals are ordered by company."""

    def __init__(self, scorer, n: int):
        import numpy as np

        self.scorer, self.n = scorer, n
        self.least = np.full(len(scorer.ids), -np.inf)
        self.held, self.rows = [], 0

    def add(self, companies, similarities, total, allowed) -> None:
        """Look at a slice of companies; ``allowed`` marks the pairs that count."""
        import numpy as np

        shown = np.where(allowed, total, -np.inf)
        cut = np.partition(shown, -self.n, axis=0)[-self.n] if len(shown) > self.n else np.full(len(self.least), -np.inf)
        rows, queries = np.nonzero((shown >= np.maximum(cut, self.least)[None, :]) & allowed)
        if not len(rows):
            return
        self.held.append(_scored(self.scorer, companies, similarities, total, rows, queries, place=_ints(queries)))
        self.rows += len(rows)
        if self.rows > 4 * self.n * len(self.least) + 10_000:
            self.cut()

    def cut(self) -> None:
        """Drop all but the ``n`` best of each query."""
        import numpy as np
        import pyarrow as pa

        if not self.held:
            return
        table = pa.Table.from_batches(self.held).sort_by([("place", "ascending"), ("total_score", "descending"), ("company_id", "ascending")])
        place = table.column("place").to_numpy()
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        last = nth == self.n - 1
        self.least[place[last]] = table.column("total_score").to_numpy()[last]
        table = table.filter(pa.array(nth < self.n)).combine_chunks()
        self.held, self.rows = table.to_batches(), table.num_rows

    def batches(self):
        self.cut()
        for batch in self.held:
            yield batch.drop_columns(["place"])


def _ints(values):
    import pyarrow as pa

    return pa.array(values, pa.int64())


def best_scores(corpus: DataFrame, queries: QuerySet, n: int, exclude_self: bool) -> DataFrame:
    """Each task's ``n`` best companies of every query: all that can be among the ``n`` best of the corpus."""

    weights = queries.weights

    def over(block: Block) -> DataFrame:
        def run(batches):
            import numpy as np

            scorer = _Scorer(block, weights)
            best = _Best(scorer, n)
            place = {q: i for i, q in enumerate(scorer.ids)}
            for batch in batches:
                for companies, similarities, total, _ in scorer.slices(batch):
                    allowed = np.ones(total.shape, dtype=bool)
                    for i, c in enumerate(companies) if exclude_self else ():
                        if c in place:
                            allowed[i, place[c]] = False
                    best.add(companies, similarities, total, allowed)
            yield from best.batches()

        return profiles(corpus).mapInArrow(run, _SCORED)

    return _shown(queries.scan(over), queries)


def _kth_distances(corpus: DataFrame, block: Block, weights: Mapping[str, float], k: int) -> dict:
    """The ``k``-th smallest distance of every query of a block, by field, and how many are smaller.

    A task gives its ``k`` smallest distances per query and field as one array; arrays are merged by query
    and field.  The result is as small as the block.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scorer = _Scorer(block, weights)
        known: dict = {}
        for batch in batches:
            for f, places, vectors, matrix in scorer.vectors(batch):
                smallest = known.setdefault((f, tuple(places.tolist())), _Smallest(len(places), k))
                smallest.near(vectors, matrix)
        for (f, places), smallest in known.items():
            seen = np.sort(smallest.seen, axis=0)
            rows = [seen[np.isfinite(seen[:, i]), i].tobytes() for i in range(len(places))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(places)), pa.array(places, pa.int32()), pa.array(rows, pa.binary())], ["field_name", "place", "distances"]
            )

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for key, raw in zip(zip(*(batch.column(c).to_pylist() for c in ("field_name", "place"))), batch.column("distances").to_pylist()):
                both = np.concatenate([held.get(key, np.zeros(0)), np.frombuffer(raw, dtype=np.float64)])
                held[key] = np.partition(both, k - 1)[:k] if len(both) > k else both
        lasts = [float(v.max()) if len(v) == k else float("inf") for v in held.values()]
        columns = [
            pa.array([f for f, _ in held], pa.string()),
            pa.array([q for _, q in held], pa.int32()),
            pa.array(lasts, pa.float64()),
            pa.array([int((v < last).sum()) for v, last in zip(held.values(), lasts)], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["field_name", "place", "last", "nearer"])

    parts = corpus.mapInArrow(run, "field_name string, place int, distances binary").repartition("field_name", "place")
    merged = parts.mapInArrow(merge, "field_name string, place int, last double, nearer long")
    return {(r["field_name"], r["place"]): (r["last"], r["nearer"]) for r in merged.collect()}


def near_scores(
    corpus: DataFrame, queries: QuerySet, k: int, min_similarity: float | None, n: int | None = None
) -> DataFrame:
    """Scores of the companies that are among the ``k`` nearest of a query by one of its fields.

    A first scan finds the ``k``-th distance of every query and field, one number each.  A second one scores what is
    nearer; only companies at exactly that distance have to be ranked, by id.  With ``n`` a task
    hands on its ``n`` best per query and those at the edge.
    """

    weights = queries.weights
    rows = profiles(corpus)
    rows = rows if rows is corpus else durable(rows)
    least = None if min_similarity is None else float(min_similarity)

    def over(block: Block) -> DataFrame:
        last = _kth_distances(rows, block, weights, k)

        def run(batches):
            import numpy as np
            import pyarrow as pa

            scorer = _Scorer(block, weights)
            most = {f: np.array([last.get((f, q), (np.inf, 0))[0] for q in range(len(scorer.ids))]) for f in scorer.weights}
            best = _Best(scorer, n) if n else None
            nothing = pa.list_(pa.string())
            for batch in batches:
                for companies, similarities, total, blocks in scorer.slices(batch):
                    sure = np.zeros(total.shape, dtype=bool)
                    edges: dict = {}
                    for f, own, places, vectors, matrix in blocks:
                        at, cols, distances = _within(vectors, matrix, most[f][places])
                        if least is not None:
                            fits = np.maximum(0.0, 1 - distances**2 / 2) >= least
                            at, cols, distances = at[fits], cols[fits], distances[fits]
                        i, q = own[at], places[cols]
                        nearer = distances < most[f][q]
                        sure[i[nearer], q[nearer]] = True
                        for x, y in zip(i[~nearer].tolist(), q[~nearer].tolist()):
                            edges.setdefault((x, y), []).append(f)
                    edges = {pair: fields for pair, fields in edges.items() if not sure[pair]}
                    if edges:
                        i, q = np.array(list(edges)).T
                        yield _scored(scorer, companies, similarities, total, i, q, edge=pa.array(list(edges.values()), nothing))
                    if best:
                        best.add(companies, similarities, total, sure)
                        continue
                    i, q = np.nonzero(sure)
                    if len(i):
                        yield _scored(scorer, companies, similarities, total, i, q, edge=pa.nulls(len(i), nothing))
            for got in best.batches() if best else ():
                yield got.append_column("edge", pa.nulls(got.num_rows, nothing))

        found = durable(rows.mapInArrow(run, _SCORED + ", edge array<string>"))
        spark = rows.sparkSession
        open_ = [(block.ids[q], f, k - nearer) for (f, q), (_, nearer) in last.items()]
        # As many rows as the block has vectors.
        room = spark.createDataFrame(open_, "query_id string, field_name string, room long") if open_ else None
        sure = found.filter("edge IS NULL").drop("edge")
        if room is None:
            return sure
        at_edge = found.filter("edge IS NOT NULL")
        each = at_edge.select("query_id", "company_id", F.explode("edge").alias("field_name"))
        ranked = top_k_per_group(each, ["query_id", "field_name"], [F.col("company_id")], k, "nth")
        kept = ranked.join(F.broadcast(room), ["query_id", "field_name"]).filter("nth <= room").select("query_id", "company_id").distinct()
        return sure.unionByName(at_edge.drop("edge").join(kept, ["query_id", "company_id"], "left_semi"))

    return _shown(queries.scan(over), queries)


def _shown(scores: DataFrame, queries: QuerySet) -> DataFrame:
    """Similarities as a map of the fields that the query has."""
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.get("similarities", i).alias("v")) for i, f in enumerate(queries.listed)])
    shown = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return scores.select("query_id", "company_id", "total_score", shown.alias("field_scores"))


def rank_by_distance(near: DataFrame, k: int, min_similarity: float | None = None) -> DataFrame:
    """The ``k`` rows of smallest distance of each query and field."""
    near = near.select("query_id", "company_id", "field_name", "distance")
    ranked = top_k_per_group(near, ["query_id", "field_name"], [F.col("distance"), F.col("company_id")], k)
    if min_similarity is not None:
        ranked = ranked.filter(V.distance_to_similarity(F.col("distance")) >= min_similarity)
    return ranked


def candidate_companies(nearest: DataFrame) -> DataFrame:
    """Distinct union of the per-field hits of each query."""
    return nearest.select("query_id", "company_id").distinct()


def contributions(scores: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """One row per (query, company, field): similarity, weight and their product."""
    rows = scores.select("*", F.explode("field_scores").alias("field_name", "similarity")).drop("field_scores")
    weight = weight_of(F.col("field_name"), weights)
    return rows.withColumn("weight", weight).withColumn("contribution", F.col("similarity") * F.col("weight"))


def profile_maps(vectors: DataFrame) -> DataFrame:
    """Company to map of field to vector; one vector per company and field expected."""
    pair = F.struct("field_name", "embedding")
    return vectors.groupBy("company_id").agg(F.map_from_entries(F.collect_list(pair)).alias("profile"))
