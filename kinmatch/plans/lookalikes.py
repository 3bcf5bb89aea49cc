"""Look-alikes of sites, and the report on a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.operators import details as D
from kinmatch.operators import reports as R
from kinmatch.plans.search import search_exact, search_two_stage
from kinmatch.schemas import LOOKALIKES, TOP_K_PER_FIELD
from kinmatch.session import durable
from kinmatch.sources.vectors import scan_companies


def lookalikes_by_domain(
    sites: DataFrame, directory: DataFrame, vectors: DataFrame, details: DataFrame, n: int = LOOKALIKES
) -> DataFrame:
    """Details of the ``n`` companies most like each site's company: query, rank, batch, kind, name, website, json.

    ``directory`` is ``(domain, entity_id)`` with the entity id a company id of the
    vector table; ``details`` has ``id`` and ``urn`` besides ``json``.  The ids found are
    listed once each and looked up in batches.  The short lists between the steps are
    stored, so that their sizes are known where they meet the large tables.
    """
    entities = D.entity_by_domain(sites, directory).select(F.col("entity_id").alias("company_id"))
    found = scan_companies(vectors, entities)
    query = durable(found.select(F.col("company_id").alias("query_id"), "field_name", "embedding"))
    best = durable(search_exact(vectors, query, n).select("query_id", "company_id", "rank"))
    batched = D.id_batches(best.select(F.col("company_id").alias("id")).distinct(), [F.asc("id")])
    records = durable(D.names_and_sites(D.detail_lookup(batched, details)))
    return best.join(records.withColumnRenamed("id", "company_id"), "company_id")


def quality_report(
    vectors: DataFrame, query: DataFrame, n: int = 20, shown: int = 10, k: int = TOP_K_PER_FIELD
) -> DataFrame:
    """The first results of each query with their texts, next to the score statistics."""
    best = durable(search_two_stage(vectors, query, n, k).drop("field_scores"))
    top = R.with_field_texts(best.filter(F.col("rank") <= shown), vectors)
    return top.join(R.score_distribution(best), "query_id")
