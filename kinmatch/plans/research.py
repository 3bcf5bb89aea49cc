"""Research documents about captured pages, one level deep or as a walk.

A responder takes rows with a ``content`` or ``prompt`` column and adds the model's
answer as ``response``; see ``operators.inference``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.text import features_line, labelled_lines, yes_no
from kinmatch.operators import documents as N
from kinmatch.operators.graph import Expansion, walk
from kinmatch.schemas import ANALYSIS_DEFAULTS, ANALYSIS_RESPONSE, COMPANY_DESCRIPTION, OVERLAP_RESPONSE
from kinmatch.session import durable
from kinmatch.sources import captures as C

Responder = Callable[[DataFrame], DataFrame]


def descriptions(captures: DataFrame, describe: Responder) -> DataFrame:
    """Captured pages with a valid company ``description``."""
    answered = describe(C.successful(captures)).drop("content")
    return N.valid_documents(answered, "response", COMPANY_DESCRIPTION, name="description")


def with_competitor_prompt(described: DataFrame) -> DataFrame:
    """Adds the ``prompt`` that asks for competitors of a described company."""
    d = F.col("description")
    lines = [
        ("", d["description_summary"]),
        ("Target audience", d["target_audience"]),
        ("Problem solved", d["problem_solved"]),
        ("Solution approach", d["solution_approach"]),
        ("Market universe", d["market_universe"]),
        ("Universe boundaries", d["universe_boundaries"]),
        ("Uses AI or automation", yes_no(d["uses_ai_automation"])),
        ("Unique features", features_line(d["unique_features"])),
    ]
    return described.withColumn("prompt", labelled_lines(lines))


def research(captures: DataFrame, describe: Responder, compete: Responder) -> DataFrame:
    """Captured pages with ``description`` and competitive-analysis ``document``.

    A page whose capture, description or analysis fails drops out.
    """
    prompted = with_competitor_prompt(descriptions(captures, describe))
    return N.valid_documents(compete(prompted), "response", ANALYSIS_RESPONSE, ANALYSIS_DEFAULTS).drop("prompt")


def overlap_profile(captures: DataFrame, respond: Responder, keys: list[str]) -> DataFrame:
    """Six-dimension profiles of captured pages, one shown value per row."""
    answered = respond(C.successful(captures)).drop("content")
    return N.overlap_rows(N.valid_documents(answered, "response", OVERLAP_RESPONSE), keys)


def landscape(
    captures: DataFrame, describe: Responder, compete: Responder, start: str, depth: int = 2
) -> tuple[Expansion, list[DataFrame]]:
    """Research a company, its competitors, theirs, and so on down to ``depth``.

    Only the pages of a round's frontier are researched.  Returns the walk and the
    stored analyses of each round.
    """
    analyses: list[DataFrame] = []

    def visit(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        pages = captures.join(frontier.select("url"), "url", "left_semi")
        found = durable(research(pages, describe, compete))
        analyses.append(found)
        reached = frontier.join(found.select("url").distinct(), "url", "left_semi")
        return reached, N.competitors(found.withColumnRenamed("url", "src"), ["src"])

    return walk(captures.sparkSession, visit, start, depth), analyses
