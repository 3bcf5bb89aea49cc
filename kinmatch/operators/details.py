"""Detail records of look-alike companies: id lookups, shapes, and the flat table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.bind import with_once
from kinmatch.functions.documents import display_name, display_website, envelope_items
from kinmatch.functions.urls import domain, strip
from kinmatch.operators.ranking import batch_number, numbered
from kinmatch.schemas import DETAIL_BATCH
from kinmatch.session import durable
from kinmatch.sources.crm import write_csv

URN = "urn:"


def entity_by_domain(sites: DataFrame, directory: DataFrame, url: str = "url") -> DataFrame:
    """Sites with the entity registered for their domain; others drop out.

    ``directory`` is ``(domain, entity_id)``.
    """
    return sites.withColumn("domain", domain(F.col(url))).join(directory, "domain")


def id_batches(ids: DataFrame, order: Sequence[Column], size: int = DETAIL_BATCH) -> DataFrame:
    """Ids with their list position and batch number, both from 0."""
    placed = numbered(ids, order, "position", start=0)
    return placed.withColumn("batch", batch_number(F.col("position"), size))


def batch_kinds(batched: DataFrame, identifier: str = "id", position: str = "position") -> DataFrame:
    """How each batch is looked up: ``urns`` or ``ids``.

    The first id decides for ``urns``; otherwise all ids must be whole numbers.
    """
    value = F.col(identifier)
    per_batch = batched.groupBy("batch").agg(
        F.min_by(value, position).alias("_first"),
        F.bool_and(is_number(value)).alias("_numbers"),
        F.count(F.lit(1)).alias("size"),
    )
    urns = F.startswith("_first", F.lit(URN)) | ~F.col("_numbers")
    return per_batch.select("batch", "size", F.when(urns, "urns").otherwise("ids").alias("kind"))


def is_number(value: Column) -> Column:
    """Whole numbers of any length; single underscores may separate digits."""
    return F.coalesce(strip(value).rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*\z"), F.lit(False))


def canonical_number(value: Column) -> Column:
    """Digits of a whole number, without sign of a positive one, leading zeros and separators."""
    digits = F.regexp_replace(F.regexp_replace(strip(value), "_", ""), r"^\+", "")
    bare = F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(is_number(value), F.when(bare == "-0", "0").otherwise(bare))


def detail_lookup(batched: DataFrame, details: DataFrame, identifier: str = "id") -> DataFrame:
    """Details of the listed ids, in batches that each use one kind of id.

    ``details`` has ``id`` (a number) and ``urn`` besides its payload.  The ids are
    resolved against ``id`` and ``urn`` alone; payloads are fetched for the hits.  Numbers
    are compared as digits, so they may have any length.
    """
    kinds = batch_kinds(batched, identifier).select("batch", "kind")
    asked = batched.join(kinds, "batch")
    key = F.when(F.col("kind") == "ids", canonical_number(F.col(identifier))).otherwise(F.col(identifier))
    number = canonical_number(F.col("id").cast("string"))
    keys = F.array(
        F.struct(F.lit("ids").alias("kind"), number.alias("_key")),
        F.struct(F.lit("urns").alias("kind"), F.col("urn").alias("_key")),
    )
    names = details.select(F.col("id").alias("_id"), F.col("urn").alias("_urn"), F.inline(keys)).distinct()
    hits = durable(asked.withColumn("_key", key).join(names, ["kind", "_key"]))
    same = details["id"].eqNullSafe(hits["_id"]) & details["urn"].eqNullSafe(hits["_urn"])
    payload = [details[c] for c in details.columns if c not in ("id", "urn")]
    return hits.join(details, same).select(*[hits[c] for c in hits.columns if c not in ("_key", "_id", "_urn")], *payload)


def unwrap(answers: DataFrame, answer: str, order: str) -> DataFrame:
    """One row per record of the answers, as JSON text, in answer order."""
    items = F.posexplode(envelope_items(F.col(answer))).alias("pos", "_v")
    return answers.select(order, items).select(order, "pos", F.to_json("_v").alias("json"))


def names_and_sites(records: DataFrame, json: str = "json") -> DataFrame:
    """Adds the displayed ``name`` and ``website`` of each record."""
    record = F.try_parse_json(F.col(json))
    return records.withColumn("name", display_name(record)).withColumn("website", display_website(record))


def _cells(json: Column) -> Column:
    """Record as a map of text cells: nested values as JSON, truth values capitalised."""
    cells = F.try_variant_get(F.try_parse_json(json), "$", "map<string, variant>")
    text = lambda k, v: F.when(
        F.schema_of_variant(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))
    ).otherwise(F.try_variant_get(v, "$", "string"))
    return F.transform_values(cells, text)


def key_union(records: DataFrame, json: str = "json") -> DataFrame:
    """Distinct keys of all records."""
    cells = F.try_variant_get(F.try_parse_json(F.col(json)), "$", "map<string, variant>")
    return records.select(F.explode(F.map_keys(cells)).alias("key")).distinct()


def flat_table(records: DataFrame, keys: Sequence[str] = (), json: str = "json") -> DataFrame:
    """Records as one table: a column per key in alphabetical order, gaps empty.

    The key names come to the driver, as they become the columns of the plan.
    """
    names = [r.key for r in key_union(records, json).orderBy("key").collect()]
    cells = with_once(records, "_cells", _cells(F.col(json)))
    return cells.select(*keys, *[F.coalesce(F.col("_cells")[n], F.lit("")).alias(n) for n in names])


def write_flat_table(records: DataFrame, path: str, json: str = "json") -> bool:
    """Write the flat table as CSV; without any record nothing is written."""
    table = flat_table(records, json=json)
    if not table.columns:
        return False
    write_csv(table, path)
    return True


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, as text, under the sorted union of their columns, gaps empty."""
    texts = [t.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in t.columns]) for t in tables]
    rows = texts[0]
    for other in texts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in sorted(rows.columns)])
