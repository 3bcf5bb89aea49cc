"""Enrichment: from CRM rows over captured pages to stored field vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.bind import with_once
from kinmatch.functions.embed import embed_text
from kinmatch.functions.text import document_id
from kinmatch.functions.urls import is_blank, with_scheme
from kinmatch.operators.documents import profile_rows, valid_documents
from kinmatch.operators.ranking import numbered, top_n
from kinmatch.operators.similarity import weighted_fields
from kinmatch.schemas import COMPANY_PROFILE, FIELD_WEIGHTS
from kinmatch.session import durable
from kinmatch.sources import captures as C

Step = Callable[[DataFrame], DataFrame]


def companies_to_visit(rows: DataFrame, website: str = "website", seq: str = "row_no") -> DataFrame:
    """Distinct companies of the CRM rows, with their first row number.

    Many rows may name the same site; it is read once, since its later vectors
    would find their ids already stored.
    """
    named = rows.filter(~is_blank(F.col(website))).withColumn("company_id", with_scheme(F.col(website)))
    return named.groupBy("company_id").agg(F.min(seq).alias(seq))


def first_successes(rows: DataFrame, n: int, seq: str = "row_no") -> DataFrame:
    """The first ``n`` rows in order; failures were dropped before and cost nothing."""
    return top_n(rows, [F.asc(seq)], n)


def first_answered(rows: DataFrame, answer: Step, n: int, order: tuple[str, ...] = ("row_no", "company_id"), grow: int = 2) -> DataFrame:
    """The first ``n`` rows in order to which ``answer`` gives a result; few more than needed are asked about.

    ``answer`` keeps the rows that succeed.  It sees ``grow * n`` rows first, in order, and as long as there are fewer than ``n``
    successes the next rows, twice as many each time, so at most about twice as many rows as one by
    one would take are asked about.  Rows and answers are stored, so a lost task asks no
    other rows again.
    """
    placed = durable(numbered(rows, [F.col(c) for c in order], "_place", 0))
    total = placed.count()
    found, successes, at, size = [], 0, 0, max(1, grow * n)
    while at < total and successes < n or not found:
        batch = placed.filter(F.col("_place").between(at, at + size - 1))
        found.append(durable(answer(batch)))
        successes += found[-1].count()
        at, size = at + size, 2 * size
    every = reduce(DataFrame.unionByName, found)
    return top_n(every, [F.col(c) for c in order], n).drop("_place")


def profiles(visited: DataFrame, respond: Step) -> DataFrame:
    """Companies whose answer is a valid profile; ``respond`` adds ``response``."""
    valid = valid_documents(respond(visited).drop("content"), "response", COMPANY_PROFILE, name="_profile")
    return valid.select(*[c for c in valid.columns if c != "_profile"], "_profile.*")


def field_texts(companies: DataFrame, seq: str = "row_no") -> DataFrame:
    """Field records, without vectors yet, of valid profiles."""
    rows = profile_rows(companies, ["company_id", seq])
    return rows.select(
        document_id(F.col("company_id"), F.col("field_name")).alias("doc_id"),
        "company_id",
        "field_name",
        "text_content",
        F.col("company_id").alias("source_url"),
        seq,
    )


def with_embedding(rows: DataFrame) -> DataFrame:
    """Add the default embedding; records without one drop out."""
    embedded = with_once(rows, "embedding", embed_text(F.col("text_content")))
    return embedded.filter(F.col("embedding").isNotNull())


def enrich_texts(rows: DataFrame, captures: DataFrame, respond: Step, quota: int | None = None) -> DataFrame:
    """Field records, without vectors yet, of the companies behind the CRM rows.

    ``quota`` keeps the first companies that had a page and a valid answer, and asks about few more.
    """
    visited = C.lookup(companies_to_visit(rows), captures)
    if quota is None:
        return field_texts(profiles(visited, respond))
    return field_texts(first_answered(visited, lambda batch: profiles(batch, respond), quota))


def enrich(
    rows: DataFrame, captures: DataFrame, respond: Step, embed: Step = with_embedding, quota: int | None = None
) -> DataFrame:
    """Field vectors of the companies behind the CRM rows.

    To store them, ``sources.vectors.insert_texts_if_absent`` with ``enrich_texts``
    embeds only what is not stored yet.
    """
    return embed(enrich_texts(rows, captures, respond, quota))


def query_profiles(
    sites: DataFrame, captures: DataFrame, respond: Step, embed: Step = with_embedding, weights=FIELD_WEIGHTS
) -> DataFrame:
    """Query rows of the given sites; a site without any vector has no rows."""
    visited = C.lookup(companies_to_visit(sites), captures)
    rows = weighted_fields(field_texts(profiles(visited, respond)), weights)
    return embed(rows).select(F.col("company_id").alias("query_id"), "field_name", "embedding")
