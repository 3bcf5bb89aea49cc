"""Catalog: score, latency and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.search import _near

from kinmatch.operators import reports as R
from kinmatch.plans import lookalikes as L
from kinmatch.plans import search as P
from kinmatch.session import durable


def _r(name: str, digits: int = 4):
    return F.round(name, digits).alias(name)


def score_distribution(spark, sf_dir):
    best = P.search_two_stage(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir), n=20)
    return R.score_distribution(best).select(
        "query_id", "results", _r("highest"), _r("lowest"), _r("average"), _r("score_range"), _r("variance", 6), "diversity"
    )


def latency_summary(spark, sf_dir):
    return R.latency_summary(X.run_log(spark, sf_dir)).select(
        "grp", _r("average", 6), _r("fastest", 6), _r("slowest", 6), _r("spread", 6), "consistency"
    )


def throughput_summary(spark, sf_dir):
    """Per run: results per second and milliseconds per result."""
    elapsed, results = F.col("elapsed_s"), F.col("result_count")
    return X.run_log(spark, sf_dir).select(
        "run_id",
        F.round(R.results_per_second(elapsed, results), 3).alias("per_second"),
        F.round(R.ms_per_result(elapsed, results), 7).alias("ms_per_result"),
    )


def topk_with_text(spark, sf_dir):
    vectors = X.company_vec(spark, sf_dir)
    best = P.search_two_stage(vectors, X.query_profile(spark, sf_dir)).select("query_id", "company_id", "rank")
    return R.with_field_texts(durable(best), vectors)


def quality_report(spark, sf_dir):
    report = L.quality_report(X.company_vec(spark, sf_dir), X.query_profile(spark, sf_dir))
    return report.select(
        "query_id", "rank", "company_id", _r("total_score"), "industry", "product", "icp", "results", "diversity"
    )


QUERIES = {
    f.__name__: f for f in [score_distribution, latency_summary, throughput_summary, topk_with_text, quality_report]
}

_RUNS = """(SELECT event_id AS run_id, event_type AS grp, value / 1000 AS elapsed_s, user_id % 30 AS result_count
  FROM events)"""
_TEXTS = """(SELECT company_id, max(CASE WHEN field_name = 'industry_vertical' THEN t END) AS industry,
    max(CASE WHEN field_name = 'product_form' THEN t END) AS product, max(CASE WHEN field_name = 'icp' THEN t END) AS icp
  FROM (SELECT *, coalesce(field_text, text_content) AS t FROM company_vec) GROUP BY 1)"""
_SHOWN = ", ".join(f"coalesce({c}, 'N/A') AS {c}" for c in ("industry", "product", "icp"))

ORACLES = {
    "score_distribution": _near(
        500,
        """SELECT query_id, count(*) AS results, round(max(total), 4) AS highest, round(min(total), 4) AS lowest,
             round(avg(total), 4) AS average, round(max(total) - min(total), 4) AS score_range,
             round(var_pop(total), 6) AS variance,
             CASE WHEN var_pop(total) > 0.001 THEN 'Good' ELSE 'Low' END AS diversity
           FROM two_stage WHERE rank <= 20 GROUP BY 1""",
    ),
    "latency_summary": f"""SELECT grp, round(avg(elapsed_s), 6) AS average, round(min(elapsed_s), 6) AS fastest,
        round(max(elapsed_s), 6) AS slowest, round(max(elapsed_s) - min(elapsed_s), 6) AS spread,
        CASE WHEN max(elapsed_s) - min(elapsed_s) < 0.5 THEN 'Good' ELSE 'Variable' END AS consistency
        FROM {_RUNS} GROUP BY 1""",
    "throughput_summary": f"""SELECT run_id,
        round(CASE WHEN elapsed_s > 0 THEN result_count / elapsed_s END, 3) AS per_second,
        round(CASE WHEN result_count > 0 THEN elapsed_s / result_count * 1000 END, 7) AS ms_per_result FROM {_RUNS}""",
    "topk_with_text": _near(
        500,
        f"""SELECT query_id, company_id, rank, {_SHOWN} FROM two_stage LEFT JOIN {_TEXTS} USING (company_id)
            WHERE rank <= 10""",
    ),
    "quality_report": _near(
        500,
        f"""SELECT query_id, rank, company_id, round(total, 4) AS total_score, {_SHOWN}, results, diversity
            FROM two_stage LEFT JOIN {_TEXTS} USING (company_id)
            JOIN (SELECT query_id, count(*) AS results,
                    CASE WHEN var_pop(total) > 0.001 THEN 'Good' ELSE 'Low' END AS diversity
                  FROM two_stage WHERE rank <= 20 GROUP BY 1) USING (query_id) WHERE rank <= 10""",
    ),
}
