"""Depth-limited breadth-first expansion of a competitor graph.

Edges are ``(src, pos, name, description, overlap_score, link)``; ``pos`` orders the
competitors of a source.  A first-in-first-out queue meets the edges of a round in the
order of their sources, which is the order in which those were met the round before, and
then of position.  So a round needs one join, one minimum per link over a single
number, and numbers for what it met; no queue and no paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.operators.joins import except_known
from kinmatch.operators.ranking import numbered
from kinmatch.session import durable, shared_folder

_EDGE = ["name", "description", "overlap_score"]
# Place of a source in its round (18 digits) and position (19 digits) in one number.
_SHIFT = "10000000000000000000BD"


@dataclass
class Expansion:
    """``visited(url, depth, place)`` and ``superset(link, depth, met, src, pos, ...)``.

    ``depth`` of a superset row is the depth of the company that named it first, and
    ``met`` its order within that depth; ``place`` is the order of a company in its round.
    """

    start: str
    depth: int
    visited: DataFrame
    superset: DataFrame


def expand(edges: DataFrame, start: str, depth: int = 2, failed: DataFrame | None = None) -> Expansion:
    """Walk a table of edges from ``start``, which has depth 1, down to ``depth``.

    A source listed in ``failed.src`` is neither visited nor expanded.
    """

    def visit(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        if failed is None:
            return frontier, edges
        return except_known(frontier, failed.select(F.col("src").alias("url")), "url"), edges

    return walk(edges.sparkSession, visit, start, depth)


def walk(
    spark: SparkSession, visit: Callable[[DataFrame], tuple[DataFrame, DataFrame]], start: str, depth: int
) -> Expansion:
    """Walk from ``start``; ``visit`` gives the companies reached and their edges.

    Edges without a link are ignored.  A link is followed only where it is first
    seen.  Every round is written to a table, which keeps the plan of the next
    round short.
    """
    root = shared_folder(spark)
    frontier = spark.range(1).select(F.lit(start).alias("url"), F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("place"))
    visited: list[DataFrame] = []
    superset: list[DataFrame] = []
    for level in range(1, depth + 1):
        reached, edges = visit(frontier)
        reached = durable(reached, f"{root}/visited/{level}")
        visited.append(reached)
        links = edges.filter(F.col("link") != "")
        met = reached.join(links, reached.url == links.src)
        order = F.expr(f"CAST(CAST(place AS DECIMAL(18,0)) * {_SHIFT} + pos AS DECIMAL(38,0))")
        first = met.groupBy("link").agg(F.min(order).alias("met"))
        if superset:
            first = except_known(first, reduce(DataFrame.unionByName, superset), "link")
        first = durable(_with_edges(first, reached, links, level), f"{root}/superset/{level}")
        superset.append(first)
        if level == depth or first.isEmpty():
            break
        followed = first.filter(F.col("link") != start).select(F.col("link").alias("url"), "met")
        frontier = numbered(followed, [F.col("met")], "place", start=0).select("url", F.lit(level + 1).alias("depth"), "place")
    return Expansion(start, depth, reduce(DataFrame.unionByName, visited), reduce(DataFrame.unionByName, superset))


def _with_edges(first: DataFrame, reached: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """The edge behind each first-met link; of repeated edges the first by its texts."""
    place = F.expr(f"CAST(met DIV {_SHIFT} AS BIGINT)")
    pos = F.expr(f"CAST(met % {_SHIFT} AS BIGINT)")
    winners = first.select("link", "met", place.alias("place"), pos.alias("pos"))
    named = winners.join(reached.select("place", F.col("url").alias("src")), "place")
    edges = named.join(links.select("src", "pos", "link", *_EDGE), ["src", "pos", "link"])
    one = Window.partitionBy("link").orderBy(*_EDGE)
    once = edges.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    return once.select("link", F.lit(level).alias("depth"), "met", "src", "pos", *_EDGE)


def summary(walk: Expansion) -> DataFrame:
    """One row: start, depth, and the sizes of both results."""
    rows = F.count(F.lit(1))
    return walk.visited.agg(rows.alias("total_companies_analyzed")).select(
        F.lit(walk.start).alias("initial_company"),
        F.lit(walk.depth).alias("depth_analyzed"),
        "total_companies_analyzed",
        walk.superset.select(rows).scalar().alias("total_competitors_found"),
    )


def competitors_per_company(walk: Expansion, edges: DataFrame) -> DataFrame:
    """Number of listed competitors of each visited company, with or without link."""
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("competitors"))
    return walk.visited.join(counts, F.col("url") == F.col("src"), "left").select(
        "url", "depth", F.coalesce("competitors", F.lit(0).cast("bigint")).alias("competitors")
    )


def ranked_superset(walk: Expansion) -> DataFrame:
    """The superset by falling overlap; equal overlap keeps the first-seen order."""
    order = [F.desc("overlap_score"), F.asc("depth"), F.asc("met")]
    return numbered(walk.superset, order)
