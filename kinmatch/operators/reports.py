"""Summaries of scores and of search runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.text import NOT_AVAILABLE
from kinmatch.schemas import LATENCY_SPREAD_GOOD, SCORE_VARIANCE_GOOD
from kinmatch.sources.vectors import display_text


def score_distribution(scores: DataFrame, group: Sequence[str] = ("query_id",), score: str = "total_score") -> DataFrame:
    """Count, range, mean and population variance, with a diversity label."""
    return (
        scores.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.max(score).alias("highest"),
            F.min(score).alias("lowest"),
            F.avg(score).alias("average"),
            F.var_pop(score).alias("variance"),
        )
        .withColumn("score_range", F.col("highest") - F.col("lowest"))
        .withColumn("diversity", F.when(F.col("variance") > SCORE_VARIANCE_GOOD, "Good").otherwise("Low"))
    )


def latency_summary(runs: DataFrame, group: Sequence[str] = ("grp",), elapsed: str = "elapsed_s") -> DataFrame:
    """Mean, fastest and slowest run, with a consistency label."""
    return (
        runs.groupBy(*group)
        .agg(F.avg(elapsed).alias("average"), F.min(elapsed).alias("fastest"), F.max(elapsed).alias("slowest"))
        .withColumn("spread", F.col("slowest") - F.col("fastest"))
        .withColumn("consistency", F.when(F.col("spread") < LATENCY_SPREAD_GOOD, "Good").otherwise("Variable"))
    )


def results_per_second(elapsed: Column, results: Column) -> Column:
    return F.when(elapsed > 0, results / elapsed)


def ms_per_result(elapsed: Column, results: Column) -> Column:
    return F.when(results > 0, elapsed / results * 1000)


def with_field_texts(best: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the industry, product and customer texts of each result company.

    ``best`` should be a stored table of bounded size: its ids then travel to the
    vector scan, instead of the texts being shuffled.
    """
    shown = {"industry": "industry_vertical", "product": "product_form", "icp": "icp"}
    texts = display_text(vectors).select("company_id", "field_name", "shown_text")
    wanted = texts.join(best.select("company_id").distinct(), "company_id", "left_semi")
    wide = wanted.groupBy("company_id").agg(
        *[F.max(F.when(F.col("field_name") == f, F.nullif("shown_text", F.lit("")))).alias(n) for n, f in shown.items()]
    )
    filled = [F.coalesce(n, F.lit(NOT_AVAILABLE)).alias(n) for n in shown]
    return best.join(wide, "company_id", "left").select(*best.columns, *filled)
