"""Catalog: the competitor graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import with_views
from kinmatch.operators import graph as G
from kinmatch.plans.research import landscape
from kinmatch.session import durable

START = "https://company00000.com"
DEPTH = 3


def _walk(spark, sf_dir, depth=DEPTH):
    edges = durable(X.edges(spark, sf_dir))
    return edges, G.expand(edges, START, depth, X.failed_sources(spark, sf_dir))


def bfs_visited(spark, sf_dir):
    return _walk(spark, sf_dir)[1].visited.select("url", "depth")


def bfs_visited_shallow(spark, sf_dir):
    """The default depth of 2."""
    return _walk(spark, sf_dir, 2)[1].visited.select("url", "depth")


def bfs_superset(spark, sf_dir):
    found = _walk(spark, sf_dir)[1].superset
    return found.select("link", "depth", "pos", "src", "name", "overlap_score")


def bfs_summary(spark, sf_dir):
    return G.summary(_walk(spark, sf_dir)[1])


def bfs_fanout(spark, sf_dir):
    edges, walk = _walk(spark, sf_dir)
    return G.competitors_per_company(walk, edges)


def superset_ranked(spark, sf_dir):
    return G.ranked_superset(_walk(spark, sf_dir)[1]).select("rank", "link", "name", "overlap_score")


def landscape_visited(spark, sf_dir):
    """The walk that researches every round's companies; stand-in models read the rivals off the page."""
    edges = X.edges(spark, sf_dir)
    rival = F.to_json(F.struct("name", "description", "overlap_score", "link"), {"ignoreNullFields": "false"})
    rivals = F.transform(F.sort_array(F.collect_list(F.struct("pos", rival.alias("r")))), lambda x: x["r"])
    lists = edges.groupBy(F.col("src").alias("url")).agg(F.array_join(rivals, ",").alias("rivals"))
    known = edges.select(F.explode(F.array("src", "link")).alias("url")).filter("url IS NOT NULL").distinct()
    failed = X.failed_sources(spark, sf_dir).select(F.col("src").alias("url"))
    content = F.concat(F.lit("["), F.coalesce("rivals", F.lit("")), F.lit("]")).alias("content")
    pages = durable(known.join(failed, "url", "left_anti").join(lists, "url", "left").select("url", content))

    def describe(rows):
        texts = ["target_audience", "problem_solved", "solution_approach", "market_universe", "universe_boundaries"]
        answer = F.struct(
            F.col("content").alias("description_summary"),
            F.lit(True).alias("uses_ai_automation"),
            *[F.lit("x").alias(t) for t in texts],
        )
        return rows.withColumn("response", F.to_json(answer))

    def compete(rows):
        rest = "".join(f', "{t}": ""' for t in ("summary", "market_map", "features", "positioning_analysis"))
        rest += "".join(f', "{t}": []' for t in ("segments", "differentiators", "matrix"))
        first_line = F.substring_index("prompt", "\n", 1)
        head = F.lit('{"search_query_used": "", "comprehensive_analysis": {"competitors": ')
        return rows.withColumn("response", F.concat(head, first_line, F.lit(rest + "}}")))

    return landscape(pages, describe, compete, START, DEPTH)[0].visited.select("url", "depth")


QUERIES = {
    f.__name__: f for f in [bfs_visited, bfs_visited_shallow, bfs_superset, bfs_summary, bfs_fanout, superset_ranked, landscape_visited]
}


def _graph(body: str, depth: int = DEPTH) -> str:
    tables = f"""good AS (SELECT * FROM edges WHERE link IS NOT NULL AND src NOT IN (SELECT src FROM failed)),
    walk AS (
      SELECT link, 1 AS depth, [pos] AS path, src, name, overlap_score FROM good WHERE src = '{START}'
      UNION ALL
      SELECT g.link, w.depth + 1, list_append(w.path, g.pos), g.src, g.name, g.overlap_score
      FROM walk w JOIN good g ON g.src = w.link WHERE w.depth < {depth}),
    superset AS (
      SELECT * EXCLUDE (n) FROM (
        SELECT *, row_number() OVER (PARTITION BY link ORDER BY depth, path) AS n FROM walk) WHERE n = 1),
    visited AS (
      SELECT '{START}' AS url, 1 AS depth WHERE '{START}' NOT IN (SELECT src FROM failed)
      UNION ALL
      SELECT link, depth + 1 FROM superset
      WHERE depth < {depth} AND link <> '{START}' AND link NOT IN (SELECT src FROM failed))"""
    return with_views("edges failed", "", recursive=True).rstrip() + f",\n{tables}\n{body}"


ORACLES = {
    "bfs_visited": _graph("SELECT url, depth FROM visited"),
    "bfs_visited_shallow": _graph("SELECT url, depth FROM visited", 2),
    "bfs_superset": _graph(
        "SELECT link, depth, path[-1] AS pos, src, name, overlap_score FROM superset"
    ),
    "bfs_summary": _graph(
        f"""SELECT '{START}' AS initial_company, {DEPTH}::INTEGER AS depth_analyzed,
              (SELECT count(*) FROM visited) AS total_companies_analyzed,
              (SELECT count(*) FROM superset) AS total_competitors_found"""
    ),
    "bfs_fanout": _graph(
        """SELECT url, depth, coalesce(n, 0)::BIGINT AS competitors FROM visited
           LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) ON src = url"""
    ),
    "superset_ranked": _graph(
        """SELECT row_number() OVER (ORDER BY overlap_score DESC, depth, path) AS rank, link, name, overlap_score
           FROM superset"""
    ),
}
ORACLES["landscape_visited"] = ORACLES["bfs_visited"]
