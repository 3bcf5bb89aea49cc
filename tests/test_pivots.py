"""Searches from a store by pivot give what scans of all vectors give, and read less."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_similarity import FIELDS, SCHEMA, corpus

from kinmatch.operators import similarity as S
from kinmatch.plans import pivot_search as PP
from kinmatch.plans import search as P
from kinmatch.sources.pivots import store_by_pivot


def rows_of(df):
    return sorted((r.query_id, r.field_name, r["rank"], r.company_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_nearest_are_those_of_a_scan(spark, tmp_path, k):
    vectors = S.usable_vectors(spark.createDataFrame([*corpus(3), ("bad", "icp", [float("nan")] * 8)], SCHEMA).repartition(5))
    store = store_by_pivot(vectors, str(tmp_path / "store"), 5)
    query = vectors.filter("company_id < 'c012'").withColumnRenamed("company_id", "query_id")
    queries = S.query_set(query)
    assert rows_of(PP.nearest_from_pivots(store, queries, k)) == rows_of(S.nearest_per_field(vectors, queries, k))
    wanted = [tuple(r) for r in P.search_two_stage(vectors, query, 6, k).orderBy("query_id", "rank").collect()]
    got = [tuple(r) for r in PP.search_two_stage_pivots(store, vectors, query, 6, k).orderBy("query_id", "rank").collect()]
    assert got == wanted


def test_far_pivots_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 40
    rows = [(f"c{i:04d}", FIELDS[0], [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=8))]) for i in range(1200)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    store = store_by_pivot(vectors, str(tmp_path / "store"), 40)
    queries = S.query_set(vectors.filter("company_id IN ('c0003', 'c0015')").withColumnRenamed("company_id", "query_id"))
    share = PP.Share()
    near = PP.nearest_from_pivots(store, queries, 20, share=share)
    assert rows_of(near) == rows_of(S.nearest_per_field(vectors, queries, 20))
    # Both queries are in the same of twelve clusters.
    assert share.vectors == 1200 and share.read <= 200 and share.wanted < 0.2 * share.pairs
    read = store.vectors.filter(F.col("pivot").isin("8-1", "8-2"))
    assert "PartitionFilters: [pivot" in read._jdf.queryExecution().executedPlan().toString()


def test_no_vectors_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([("c", FIELDS[0], [])], SCHEMA)
    some = spark.createDataFrame([("c", FIELDS[0], [1.0, 2.0])], SCHEMA)
    asked = some.withColumnRenamed("company_id", "query_id")
    assert PP.nearest_from_pivots(store_by_pivot(some, str(tmp_path / "b")), S.query_set(asked.limit(0)), 3).count() == 0
    assert PP.nearest_from_pivots(store_by_pivot(some, str(tmp_path / "c")), S.query_set(asked), 3).count() == 1
    empty = store_by_pivot(none, str(tmp_path / "a"))
    assert PP.nearest_from_pivots(empty, S.query_set(asked), 3).count() == 0


def test_a_pivot_takes_room_for_its_own_queries(spark):
    """What a task holds for a pivot that few queries want does not depend on how many queries there are."""
    ids, rows = 2_000, 8_000
    rng = np.random.default_rng(1)

    class Held(SimpleNamespace):
        def filter(self, cond):
            return self

        def mapInArrow(self, run, schema):
            return run

    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    store = SimpleNamespace(vectors=Held(), spark=SimpleNamespace(sparkContext=context))
    matrix = rng.random((ids, 8))
    f = PP._Field([f"q{i}" for i in range(ids)], matrix, ["8-1"], np.array([rows]), np.zeros((ids, 1)), cut=np.full(ids, np.inf))
    use = np.zeros((ids, 1), dtype=bool)
    use[[3, 700, 1999]] = True
    vectors = rng.random((rows, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([f"c{i}" for i in range(rows)]),
            pa.array(np.zeros(rows)),
            pa.array(list(vectors), pa.list_(pa.float32())),
            pa.array(["icp"] * rows),
            pa.array(["8-1"] * rows),
        ],
        ["company_id", "apart", "embedding", "field_name", "pivot"],
    )
    run = PP._scan(store, {("icp", 8): f}, {("icp", 8): use}, 2)
    tracemalloc.start()
    found = pa.Table.from_batches(list(run([batch, batch]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for q in (3, 700, 1999):
        best = found[found.query_id == f"q{q}"].sort_values("distance")["distance"].to_numpy()[:2]
        every = np.sort(np.tile(np.sqrt(((vectors - matrix[q]) ** 2).sum(1)), 2))[:2]
        assert np.allclose(best, every)
    assert peak < 40e6
