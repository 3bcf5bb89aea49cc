"""Company search: exact scan, two-stage search, and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import similarity as S
from kinmatch.operators.ranking import top_k_per_group
from kinmatch.schemas import FIELD_WEIGHTS, SWEEP_SIZES, TOP_K_PER_FIELD, TOP_N


def _best(scores: DataFrame, n: int) -> DataFrame:
    return top_k_per_group(scores, ["query_id"], [F.desc("total_score"), F.asc("company_id")], n)


def score_all(
    vectors: DataFrame, query: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS, exclude_self: bool = True
) -> DataFrame:
    """Weighted score of every company for every query."""
    scores = S.every_score(vectors, S.query_set(query, weights))
    return scores.filter(F.col("company_id") != F.col("query_id")) if exclude_self else scores


def search_exact(
    vectors: DataFrame,
    query: DataFrame,
    n: int = TOP_N,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    exclude_self: bool = True,
) -> DataFrame:
    """The ``n`` best companies per query, by a scan of the whole corpus.

    ``vectors`` are field vectors or, for repeated searches, stored profiles.
    """
    return _best(S.best_scores(vectors, S.query_set(query, weights), n, exclude_self), n)


def search_two_stage(
    vectors: DataFrame,
    query: DataFrame,
    n: int = TOP_N,
    k: int = TOP_K_PER_FIELD,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    exclude_self: bool = False,
    min_similarity: float | None = None,
) -> DataFrame:
    """The ``n`` best companies among the ``k`` nearest per field.

    A company found through one field is scored on all fields of the query.
    """
    # The queried company itself may be among them.
    scores = S.near_scores(vectors, S.query_set(query, weights), k, min_similarity, n + exclude_self)
    if exclude_self:
        scores = scores.filter(F.col("company_id") != F.col("query_id"))
    return _best(scores, n)


def size_sweep(
    vectors: DataFrame, query: DataFrame, sizes: Sequence[int] = SWEEP_SIZES, k: int = TOP_K_PER_FIELD
) -> DataFrame:
    """Result count, best and last score for each result size, from one search."""
    best = search_two_stage(vectors, query, max(sizes), k)
    sized = best.withColumn("top_n", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return (
        sized.filter(F.col("rank") <= F.col("top_n"))
        .groupBy("query_id", "top_n")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.max("total_score").alias("best_score"),
            F.min("total_score").alias("last_score"),
        )
    )


def two_stage_recall(vectors: DataFrame, query: DataFrame, n: int = TOP_N, k: int = TOP_K_PER_FIELD) -> DataFrame:
    """Share of the exact ``n`` best that the two-stage search also returns."""
    exact = search_exact(vectors, query, n, exclude_self=False).select("query_id", "company_id")
    found = search_two_stage(vectors, query, n, k).select("query_id", "company_id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", "company_id"], "left")
        .groupBy("query_id")
        .agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))
        .withColumn("recall", F.col("hits") / F.col("wanted"))
    )
