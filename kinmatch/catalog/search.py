"""Catalog: vector table, vector functions and company search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import LABELLED_PROFILES, VIEWS, cosine, with_views
from kinmatch.functions import vectors as V
from kinmatch.operators import similarity as S
from kinmatch.plans import pivot_search as PP
from kinmatch.plans import search as P
from kinmatch.plans.reported import search_reported
from kinmatch.session import shared_folder
from kinmatch.sources.pivots import store_by_pivot
from kinmatch.sources.vectors import scan_companies

CUT = 5
SWEEP_CUT = 12


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


def vec_cosine(spark, sf_dir):
    """Every vector against the first field vector of its company."""
    rows = X.company_vec(spark, sf_dir)
    first = rows.groupBy("company_id").agg(F.min_by("embedding", "seq").alias("first"))
    return rows.join(first, "company_id").select(
        "doc_id", F.round(V.cosine(F.col("embedding"), F.col("first")), 4).alias("sim")
    )


def vec_l2(spark, sf_dir):
    rows = X.company_vec(spark, sf_dir)
    first = rows.groupBy("company_id").agg(F.min_by("embedding", "seq").alias("first"))
    return rows.join(first, "company_id").select(
        "doc_id", F.round(V.l2_distance(F.col("embedding"), F.col("first")), 4).alias("d")
    )


def vec_normalise(spark, sf_dir):
    """Norm before and after, and every component after."""
    rows = X.company_vec(spark, sf_dir).withColumn("doubled", F.transform("embedding", lambda x: x * 2))
    unit = rows.withColumn("unit", V.normalise(F.col("doubled")))
    return unit.select(
        "doc_id",
        F.round(V.l2_norm(F.col("doubled")), 4).alias("norm_before"),
        F.round(V.l2_norm(F.col("unit")), 4).alias("norm_after"),
        F.posexplode("unit").alias("place", "value"),
    ).withColumn("value", F.round("value", 4))


def vec_blend(spark, sf_dir):
    """Each vector mixed with the first vector of its company."""
    rows = X.company_vec(spark, sf_dir)
    first = rows.groupBy("company_id").agg(F.min_by("embedding", "seq").alias("first"))
    mixed = rows.join(first, "company_id").filter(F.size("embedding") == F.size("first"))
    return mixed.withColumn("mix", V.blend(F.col("embedding"), F.col("first"), 0.8)).select(
        "doc_id",
        F.round(V.l2_norm(F.col("mix")), 4).alias("norm"),
        F.posexplode("mix").alias("place", "value"),
    ).withColumn("value", F.round("value", 4))


def vec_cosine_batch(spark, sf_dir):
    queries = S.query_set(X.query_profile(spark, sf_dir))
    return S.field_similarities(X.company_vec(spark, sf_dir), queries).select(
        "query_id", "company_id", "field_name", _r("similarity")
    )


def distance_to_similarity(spark, sf_dir):
    rows = X.company_vec(spark, sf_dir)
    first = rows.groupBy("company_id").agg(F.min_by("embedding", "seq").alias("first"))
    d = V.l2_distance(F.col("embedding"), F.col("first"))
    return rows.join(first, "company_id").select("doc_id", F.round(V.distance_to_similarity(d), 4).alias("sim"))


def weight_filter(spark, sf_dir):
    query = S.weighted_fields(X.query_profile(spark, sf_dir))
    return query.select("query_id", "field_name", S.weight_of(F.col("field_name")).alias("weight"))


def join_query_fields(spark, sf_dir):
    """The companies that each query field meets in the corpus."""
    queries = S.query_set(X.query_profile(spark, sf_dir))
    met = S.field_similarities(X.company_vec(spark, sf_dir), queries)
    return met.select("query_id", "field_name", "company_id")


def join_missing_as_zero(spark, sf_dir):
    """Per query field similarity of every company, 0.0 where the company lacks it."""
    scores = P.score_all(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), exclude_self=False)
    return scores.select("query_id", "company_id", F.explode("field_scores").alias("field_name", "similarity")).select(
        "query_id", "company_id", "field_name", _r("similarity")
    )


def weighted_score(spark, sf_dir):
    scores = P.score_all(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), exclude_self=False)
    return scores.select("query_id", "company_id", _r("total_score"))


def exclude_self(spark, sf_dir):
    scores = P.score_all(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return scores.select("query_id", "company_id")


def score_exact(spark, sf_dir):
    scores = P.score_all(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return scores.select("query_id", "company_id", _r("total_score"))


def field_score_map(spark, sf_dir):
    scores = P.score_all(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return scores.select("query_id", "company_id", F.explode("field_scores").alias("field_name", "similarity")).select(
        "query_id", "company_id", "field_name", _r("similarity")
    )


def score_contributions(spark, sf_dir):
    best = P.search_exact(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return S.contributions(best).select(
        "query_id", "company_id", "rank", "field_name", _r("similarity"), "weight", _r("contribution")
    )


def topn_exact(spark, sf_dir):
    best = P.search_exact(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def rank_results(spark, sf_dir):
    best = P.search_exact(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), n=100)
    return best.select("query_id", "rank", "company_id")


def topk_per_field(spark, sf_dir):
    queries = S.query_set(X.query_profile(spark, sf_dir))
    near = S.nearest_per_field(X.company_vec(spark, sf_dir), queries, CUT)
    return near.select("query_id", "field_name", "company_id", _r("distance"), "rank")


def candidate_union(spark, sf_dir):
    queries = S.query_set(X.query_profile(spark, sf_dir))
    return S.candidate_companies(S.nearest_per_field(X.company_vec(spark, sf_dir), queries, CUT))


def semi_candidates(spark, sf_dir):
    rows = X.company_vec(spark, sf_dir)
    queries = S.query_set(X.query_profile(spark, sf_dir))
    found = S.candidate_companies(S.nearest_per_field(rows, queries, CUT))
    return scan_companies(rows, found).select("doc_id", "company_id", "field_name")


def topn_two_stage(spark, sf_dir):
    best = P.search_two_stage(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), k=CUT)
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def topn_two_stage_default(spark, sf_dir):
    """The default cut of 500 per field."""
    best = P.search_two_stage(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def topn_size_sweep(spark, sf_dir):
    swept = P.size_sweep(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), k=SWEEP_CUT)
    return swept.select("query_id", "top_n", "results", _r("best_score"), _r("last_score"))


def two_stage_recall(spark, sf_dir):
    return P.two_stage_recall(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), k=CUT).select(
        "query_id", "hits", "wanted", _r("recall")
    )


def topn_exact_many(spark, sf_dir):
    """A search for every company that has a vector with a given label."""
    best = P.search_exact(X.company_vec(spark, sf_dir), X.labelled_profiles(spark, sf_dir))
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def topn_two_stage_many(spark, sf_dir):
    best = P.search_two_stage(X.company_vec(spark, sf_dir), X.labelled_profiles(spark, sf_dir), k=CUT)
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def _pivots(spark, rows):
    return store_by_pivot(rows, f"{shared_folder(spark)}/pivots", 16)


def topk_per_field_pivots(spark, sf_dir):
    """The nearest per field from a store by pivot."""
    store = _pivots(spark, X.company_vec(spark, sf_dir))
    near = PP.nearest_from_pivots(store, S.query_set(X.query_profile(spark, sf_dir)), CUT)
    return near.select("query_id", "field_name", "company_id", _r("distance"), "rank")


def topn_two_stage_pivots(spark, sf_dir):
    """The two-stage search for many companies, its candidates from a store by pivot."""
    rows = X.company_vec(spark, sf_dir)
    best = PP.search_two_stage_pivots(_pivots(spark, rows), rows, X.labelled_profiles(spark, sf_dir), k=CUT)
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def topn_reported(spark, sf_dir):
    """The best companies among those whose vectors can be compared."""
    best, _ = search_reported(X.damaged_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return best.select("query_id", "company_id", _r("total_score"), "rank")


def score_failures(spark, sf_dir):
    """The companies that the same search leaves out, with the reason."""
    return search_reported(X.damaged_vec(spark, sf_dir), X.query_profile(spark, sf_dir))[1]


QUERIES = {
    f.__name__: f
    for f in [
        vec_cosine, vec_l2, vec_normalise, vec_blend, vec_cosine_batch, distance_to_similarity, weight_filter,
        join_query_fields, join_missing_as_zero, weighted_score, exclude_self, score_exact, field_score_map,
        score_contributions, topn_exact, rank_results, topk_per_field, candidate_union, semi_candidates,
        topn_two_stage, topn_two_stage_default, topn_size_sweep, two_stage_recall, topn_exact_many, topn_two_stage_many,
        topk_per_field_pivots, topn_two_stage_pivots, topn_reported, score_failures,
    ]
}

_PAIR = "FROM company_vec JOIN firsts USING (company_id)"
_NOT_SELF = "WHERE company_id <> query_id"
_TOP = "SELECT query_id, company_id, round(total, 4) AS total_score, rank FROM {0} WHERE rank <= 10"


def _near(k: int, body: str, scored: bool = True) -> str:
    """``body`` over the per-field hits, the candidates and the two-stage ranking."""
    tables = f"""near AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field_name ORDER BY d, company_id) AS rank
                     FROM distances) WHERE rank <= {k}),
    found AS (SELECT DISTINCT query_id, company_id FROM near)"""
    if scored:
        tables += """, two_stage AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, company_id) AS rank
      FROM scores SEMI JOIN found USING (query_id, company_id))"""
    views = "distances scores" if scored else "distances"
    return with_views(views, "").rstrip() + f",\n{tables}\n{body}"


ORACLES = {
    "vec_cosine": with_views("firsts", f"SELECT doc_id, round({cosine('embedding', 'first')}, 4) AS sim {_PAIR}"),
    "vec_l2": with_views(
        "firsts",
        f"""SELECT doc_id, round(CASE WHEN len(embedding) = len(first) AND len(first) > 0
              THEN list_distance(embedding, first) WHEN len(embedding) = len(first) THEN 0.0 END, 4) AS d {_PAIR}""",
    ),
    "vec_normalise": with_views(
        "company_vec",
        """SELECT doc_id, round(2 * n, 4) AS norm_before, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4)
             AS norm_after, place::INTEGER AS place,
             round(CASE WHEN n > 0 THEN embedding[place + 1] / n ELSE embedding[place + 1] END, 4) AS value
           FROM (SELECT *, unnest(range(len(embedding))) AS place, sqrt(coalesce(list_sum(list_transform(embedding, lambda x: x * x)), 0)) AS n
                 FROM company_vec)""",
    ),
    "vec_blend": with_views(
        "firsts",
        f"""SELECT doc_id, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS norm,
             place::INTEGER AS place, round(CASE WHEN n > 0 THEN mix[place + 1] / n ELSE mix[place + 1] END, 4) AS value
           FROM (SELECT *, unnest(range(len(mix))) AS place, sqrt(coalesce(list_sum(list_transform(mix, lambda x: x * x)), 0)) AS n FROM (
             SELECT doc_id, list_transform(list_zip(embedding, first),
                      lambda z: 0.8::DOUBLE * z[1] + 0.2::DOUBLE * z[2]) AS mix
             {_PAIR} WHERE len(embedding) = len(first)))""",
    ),
    "vec_cosine_batch": with_views(
        "pairs",
        "SELECT query_id, company_id, field_name, round(sim, 4) AS similarity FROM pairs WHERE present",
    ),
    "distance_to_similarity": with_views(
        "firsts",
        f"""SELECT doc_id, round(CASE WHEN len(embedding) = len(first) AND len(first) > 0
              THEN greatest(0.0::DOUBLE, 1 - list_distance(embedding, first) ** 2 / 2)
              WHEN len(embedding) = len(first) THEN 1.0 ELSE 0.0 END::DOUBLE, 4) AS sim {_PAIR}""",
    ),
    "weight_filter": with_views("weighted_query", "SELECT query_id, field_name, weight FROM weighted_query"),
    "join_query_fields": with_views(
        "pairs", "SELECT query_id, field_name, company_id FROM pairs WHERE present"
    ),
    "join_missing_as_zero": with_views(
        "pairs", "SELECT query_id, company_id, field_name, round(sim, 4) AS similarity FROM pairs"
    ),
    "weighted_score": with_views("scores", "SELECT query_id, company_id, round(total, 4) AS total_score FROM scores"),
    "exclude_self": with_views("scores", f"SELECT query_id, company_id FROM scores {_NOT_SELF}"),
    "score_exact": with_views(
        "scores", f"SELECT query_id, company_id, round(total, 4) AS total_score FROM scores {_NOT_SELF}"
    ),
    "field_score_map": with_views(
        "pairs",
        f"SELECT query_id, company_id, field_name, round(sim, 4) AS similarity FROM pairs {_NOT_SELF}",
    ),
    "score_contributions": with_views(
        "pairs ranked",
        """SELECT query_id, company_id, rank, field_name, round(sim, 4) AS similarity, weight,
             round(sim * weight, 4) AS contribution
           FROM ranked JOIN pairs USING (query_id, company_id) WHERE rank <= 10""",
    ),
    "topn_exact": with_views("ranked", _TOP.format("ranked")),
    "rank_results": with_views("ranked", "SELECT query_id, rank, company_id FROM ranked WHERE rank <= 100"),
    "topk_per_field": _near(
        CUT, "SELECT query_id, field_name, company_id, round(d, 4) AS distance, rank FROM near", False
    ),
    "candidate_union": _near(CUT, "SELECT query_id, company_id FROM found", False),
    "semi_candidates": _near(
        CUT,
        """SELECT doc_id, company_id, field_name FROM company_vec
           WHERE company_id IN (SELECT company_id FROM found)""",
        False,
    ),
    "topn_two_stage": _near(CUT, _TOP.format("two_stage")),
    "topn_two_stage_default": _near(500, _TOP.format("two_stage")),
    "topn_size_sweep": _near(
        SWEEP_CUT,
        """SELECT query_id, top_n, count(*) AS results, round(max(total), 4) AS best_score,
             round(min(total), 4) AS last_score
           FROM two_stage JOIN (SELECT unnest([10, 25, 50, 100]) AS top_n) ON rank <= top_n GROUP BY 1, 2""",
    ),
    "two_stage_recall": _near(
        CUT,
        """SELECT query_id, count(t.company_id) AS hits, count(*) AS wanted,
             round(count(t.company_id) / count(*), 4) AS recall
           FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, company_id)
                                AS r FROM scores) WHERE r <= 10) e
           LEFT JOIN (SELECT * FROM two_stage WHERE rank <= 10) t USING (query_id, company_id) GROUP BY 1""",
    ),
}

# The same searches, for many companies.
ORACLES |= {
    f"{name}_many": ORACLES[name].replace(VIEWS["query_profile"][1], LABELLED_PROFILES) for name in ("topn_exact", "topn_two_stage")
}

ORACLES["topk_per_field_pivots"] = ORACLES["topk_per_field"]
ORACLES["topn_two_stage_pivots"] = ORACLES["topn_two_stage_many"]

_FAULTS = """SELECT company_id, field_name, CASE
       WHEN seq % 97 = 0 OR len(embedding) = 0 THEN 'no values'
       WHEN seq % 89 = 0 THEN 'a value is null or not finite'
       WHEN len(embedding) NOT IN (SELECT len(q.embedding) FROM weighted_query q WHERE q.field_name = v.field_name)
       THEN 'length differs from the query''s' END AS reason
     FROM company_vec v WHERE field_name IN (SELECT field_name FROM weighted_query)"""
ORACLES["score_failures"] = with_views(
    "weighted_query company_vec", f"SELECT company_id, 'score' AS stage, field_name, reason FROM ({_FAULTS}) WHERE reason IS NOT NULL"
)
ORACLES["topn_reported"] = with_views(
    "scores weighted_query company_vec",
    f"""SELECT query_id, company_id, round(total, 4) AS total_score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, company_id) AS rank FROM scores
          WHERE company_id <> query_id AND company_id NOT IN (SELECT company_id FROM ({_FAULTS}) WHERE reason IS NOT NULL)
        ) WHERE rank <= 10""",
)
