"""Search against a plain model of it, on random vectors with planted oddities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.functions import vectors as V
from kinmatch.operators import similarity as S
from kinmatch.plans import search as P
from kinmatch.schemas import FIELD_WEIGHTS

FIELDS = list(FIELD_WEIGHTS)
SCHEMA = "company_id string, field_name string, embedding array<float>"


def corpus(seed=1, companies=60, dim=8):
    rng = random.Random(seed)
    rows = []
    for c in range(companies):
        for f in FIELDS:
            if rng.random() < 0.15:
                continue
            vector = [rng.gauss(0, 1) for _ in range(dim)]
            if rng.random() < 0.05:
                vector = rng.choice([[0.0] * dim, [], vector[:-1]])
            rows.append((f"c{c:03d}", f, [float(np.float32(x)) for x in vector]))
    rows.append(("only_list", "customer_list", [1.0] * dim))
    rows += [(f"twin{i}", "icp", [1.0] * dim) for i in range(5)]
    return rows


def cosine(a, b):
    if a is None or len(a) != len(b) or not len(a):
        return 0.0
    a, b = np.array(a), np.array(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.clip(a @ b / n, -1, 1)) if n else 0.0


def model(rows, query, exclude_self=True, members=None):
    profiles = {}
    for c, f, v in rows:
        profiles.setdefault(c, {})[f] = v
    wanted = {f: v for f, v in query.items() if FIELD_WEIGHTS.get(f)}
    out = {}
    for c, fields in profiles.items():
        if (exclude_self and c == "c005") or (members is not None and c not in members):
            continue
        out[c] = sum(cosine(fields.get(f), v) * FIELD_WEIGHTS[f] for f, v in wanted.items())
    return sorted(out.items(), key=lambda x: (-round(x[1], 12), x[0]))


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    query = vectors.filter("company_id = 'c005'").withColumnRenamed("company_id", "query_id")
    wanted = {f: v for c, f, v in rows if c == "c005"}
    return rows, vectors, query, wanted


def close(got, wanted):
    assert [c for c, _ in got] == [c for c, _ in wanted]
    assert np.allclose([s for _, s in got], [s for _, s in wanted], atol=1e-6)


def result(df):
    return [(r.company_id, r.total_score) for r in df.orderBy("rank").collect()]


def test_exact(data):
    rows, vectors, query, wanted = data
    close(result(P.search_exact(vectors, query, 1000)), model(rows, wanted))
    close(result(P.search_exact(vectors, query, 7)), model(rows, wanted)[:7])
    close(result(P.search_exact(vectors, query, 9, exclude_self=False)), model(rows, wanted, False)[:9])


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_two_stage(data, k):
    rows, vectors, query, wanted = data
    members = set()
    for f, v in wanted.items():
        if not FIELD_WEIGHTS.get(f) or not v:
            continue
        near = [
            (round(float(np.linalg.norm(np.array(x) - np.array(v))), 12), c)
            for c, g, x in rows
            if g == f and len(x) == len(v)
        ]
        members |= {c for _, c in sorted(near)[:k]}
    close(result(P.search_two_stage(vectors, query, 1000, k)), model(rows, wanted, False, members))


def test_two_stage_with_all_candidates_is_exact(data):
    rows, vectors, query, _ = data
    exact = dict(result(P.search_exact(vectors, query, 1000, exclude_self=False)))
    found = dict(result(P.search_two_stage(vectors, query, 1000, 1000)))
    assert all(abs(exact[c] - s) < 1e-9 for c, s in found.items())
    assert set(exact) - set(found) <= {c for c, s in exact.items() if s == 0.0}


@pytest.mark.parametrize("limits", [{"block_rows": 4}, {"block_elements": 40}])
def test_blocks_of_queries_give_the_same(data, limits):
    _, vectors, _, _ = data
    usable = S.usable_vectors(vectors)
    query = vectors.filter("company_id < 'c002'").withColumnRenamed("company_id", "query_id")
    whole, cut = S.query_set(query), S.query_set(query, **limits)
    assert whole.size == 1 and cut.size > 1

    def found(queries):
        return [
            sorted(map(repr, df.collect()))
            for df in (
                S.field_similarities(usable, queries),
                S.nearest_per_field(usable, queries, 3),
                S.every_score(vectors, queries),
                P._best(S.best_scores(vectors, queries, 4, True), 4),
                P._best(S.near_scores(vectors, queries, 3, None), 4),
            )
        ]

    assert found(whole) == found(cut)


def test_stored_profiles_give_the_same(spark, data, tmp_path):
    _, vectors, query, _ = data
    S.profiles(vectors).write.parquet(str(tmp_path / "profiles"))
    stored = spark.read.parquet(str(tmp_path / "profiles"))
    assert result(P.search_exact(stored, query, 9)) == result(P.search_exact(vectors, query, 9))
    assert result(P.search_two_stage(stored, query, 9, 3)) == result(P.search_two_stage(vectors, query, 9, 3))
    plan = P.search_exact(stored, query, 9)
    below_scan = plan._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]
    assert "Exchange" not in below_scan


def test_the_last_of_several_vectors_counts(spark):
    rows = [("a", "icp", [1.0, 0.0], 1), ("a", "icp", [0.0, 1.0], 2), ("b", "icp", [1.0, 1.0], 1)]
    vectors = spark.createDataFrame(rows, SCHEMA + ", seq int")
    query = spark.createDataFrame([("q", "icp", [1.0, 0.0])], "query_id string, field_name string, embedding array<float>")
    got = {r.company_id: r.field_scores["icp"] for r in P.score_all(vectors, query).collect()}
    assert got["a"] == 0.0 and abs(got["b"] - 0.5**0.5) < 1e-9


def test_small_slices_give_the_same(data, monkeypatch):
    _, vectors, query, _ = data
    rows, queries = S.usable_vectors(vectors), S.query_set(query)

    def scores():
        found = [S.field_similarities(rows, queries), S.nearest_per_field(rows, queries, 3), S.every_score(vectors, queries)]
        best = [P.search_exact(vectors, query, 5), P.search_two_stage(vectors, query, 5, 2)]
        return [sorted(map(repr, df.collect())) for df in found + best]

    wanted = scores()
    monkeypatch.setattr(S._batch_kernel, "__defaults__", (3,))
    monkeypatch.setattr(S, "CELLS", 20)
    assert scores() == wanted


def test_one_bad_vector_costs_only_itself(spark, data):
    """NaN, infinite, null and empty vectors score zero and are nobody's neighbour, in blocks of any size."""
    rows, vectors, query, _ = data
    bad = [[float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0] * 7 + [None], []]
    odd = spark.createDataFrame([(f"bad{i}", "icp", v) for i, v in enumerate(bad)], SCHEMA)
    mixed = S.usable_vectors(vectors.unionByName(odd)).coalesce(1)
    asked = query.unionByName(odd.withColumnRenamed("company_id", "query_id"))
    for limit in (5000, 1):
        queries = S.query_set(asked, block_rows=limit)
        near = S.nearest_per_field(mixed, queries, 3).collect()
        clean = S.nearest_per_field(S.usable_vectors(vectors), S.query_set(query), 3).collect()
        assert sorted(map(repr, near)) == sorted(map(repr, clean))
        scores = {(r.query_id, r.company_id): r.similarity for r in S.field_similarities(mixed, queries).collect()}
        assert {q for q, _ in scores} == {"c005"}
        assert all(scores["c005", f"bad{i}"] == 0.0 for i in range(4))
        clean = vectors.filter("company_id NOT LIKE 'bad%'")
        for search in (lambda v: P.search_exact(v, asked, 5), lambda v: P.search_two_stage(v, asked, 5, 3)):
            assert result(search(mixed)) == result(search(clean))


def test_missing_fields_show_as_zero(data):
    _, vectors, query, wanted = data
    scores = P.score_all(vectors, query).filter("company_id = 'only_list'").first()
    assert scores.total_score == 0.0
    assert scores.field_scores == {f: 0.0 for f in wanted if FIELD_WEIGHTS.get(f)}


def test_query_with_one_field_still_sees_every_company(data):
    rows, vectors, query, _ = data
    scores = P.score_all(vectors, query.filter("field_name = 'icp'"), exclude_self=False).collect()
    wanted = dict(model(rows, {"icp": next(v for c, f, v in rows if (c, f) == ("c005", "icp"))}, False))
    assert {r.company_id for r in scores} == set(wanted)
    assert all(abs(r.total_score - wanted[r.company_id]) < 1e-6 for r in scores)
    assert all(set(r.field_scores) == {"icp"} for r in scores)


def test_min_similarity_is_off_by_default(data):
    _, vectors, query, _ = data
    queries = S.query_set(query)
    rows = S.usable_vectors(vectors)
    assert S.nearest_per_field(rows, queries, 1000, 0.99).count() < S.nearest_per_field(rows, queries, 1000).count()


def test_vector_functions(spark):
    row = spark.range(1).select(
        F.array(*[F.lit(float(x)) for x in (3, 4)]).alias("a"),
        F.array(*[F.lit(float(x)) for x in (0, 0)]).alias("z"),
        F.array(F.lit(1.0)).alias("short"),
    )
    a, z, short = F.col("a"), F.col("z"), F.col("short")
    got = row.select(
        V.cosine(a, a), V.cosine(a, z), V.cosine(a, short), V.cosine(a, F.lit(None).cast("array<double>")),
        V.l2_norm(a), V.l2_distance(a, z), V.l2_distance(a, short), V.normalise(z), V.normalise(a),
        V.distance_to_similarity(F.lit(0.0)), V.distance_to_similarity(F.lit(2.0)), V.blend(a, z, 0.5),
    ).first()
    assert list(got[:7]) == [1.0, 0.0, 0.0, 0.0, 5.0, 5.0, None]
    assert [list(got[7]), list(got[8])] == [[0.0, 0.0], [0.6, 0.8]]
    assert list(got[9:11]) == [1.0, 0.0] and np.allclose(got[11], [0.6, 0.8])


def test_equal_distances_at_the_cut_go_by_id(spark):
    """Twins at the k-th distance, spread over many tasks: the smallest ids stay."""
    vector = [1.0, 0.0]
    rows = [(f"c{i:02d}", "icp", vector) for i in range(40)] + [(f"far{i}", "icp", [0.0, 1.0 + i]) for i in range(5)]
    rows += [(f"c{i:02d}", "job_to_be_done", [0.5, float(i)]) for i in range(40)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(7)
    query = spark.createDataFrame([("q", "icp", [1.0, 0.5]), ("q", "job_to_be_done", [0.5, 39.0])], "query_id string, field_name string, embedding array<float>")
    near = S.nearest_per_field(vectors, S.query_set(query), 6)
    wanted = {r.company_id for r in near.collect()}
    assert wanted == {f"c{i:02d}" for i in [*range(6), *range(34, 40)]}
    for n in (3, 50):
        found = {r.company_id for r in P.search_two_stage(vectors, query, n, 6).collect()}
        assert found <= wanted and len(found) == min(n, 12)
    every = S.near_scores(vectors, S.query_set(query), 6, None).collect()
    assert {r.company_id for r in every} == wanted


def test_running_cuts_keep_little(spark):
    """A task hands on little more than k rows per query and field, however small its batches are."""
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(5, 4))
    smallest = S._Smallest(5, 10)
    handed = sum(len(smallest.near(rng.normal(size=(8, 4)), matrix)[0]) for _ in range(200))
    assert handed < 5 * 10 * 8
