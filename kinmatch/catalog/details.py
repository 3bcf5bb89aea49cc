"""Catalog: detail records, id lookups and look-alikes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import VIEWS, site_queries, with_views
from kinmatch.operators import details as D
from kinmatch.plans import lookalikes as L
from kinmatch.session import shared_folder


def _directory(spark, sf_dir):
    """Domain of every company of the vector table, without its scheme."""
    ids = X.company_vec(spark, sf_dir).select("company_id").distinct()
    return ids.select(F.substring_index("company_id", "//", -1).alias("domain"), F.col("company_id").alias("entity_id"))


def _details(spark, sf_dir):
    records = X.detail_json(spark, sf_dir)
    return records.select(
        F.col("rec_no").alias("id"), F.concat(F.lit("urn:company:"), F.col("rec_no").cast("string")).alias("urn"), "json"
    )


def _sites(spark, sf_dir):
    """One raw address per customer, in changing spellings; some are unknown."""
    key = F.col("c_custkey")
    host = F.format_string("company%05d.com", key)
    url = (
        F.when(key % 4 == 0, F.concat(F.lit("https://www."), host, F.lit("/")))
        .when(key % 4 == 1, F.concat(F.lit("http://"), host))
        .when(key % 4 == 2, F.concat(host, F.lit("//")))
        .otherwise(F.concat(F.lit("https://"), host, F.lit("/about/")))
    )
    return X.table(spark, sf_dir, "customer").select("c_custkey", url.alias("url"))


def website_polymorphic(spark, sf_dir):
    return D.names_and_sites(X.detail_json(spark, sf_dir)).select("rec_no", "name", "website")


def detail_key_union(spark, sf_dir):
    return D.key_union(X.detail_json(spark, sf_dir))


def detail_flat_table(spark, sf_dir):
    """The flat table after a trip through a CSV file."""
    path = f"{shared_folder(spark)}/details"
    D.write_flat_table(X.detail_json(spark, sf_dir), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.fillna("")


def union_by_name(spark, sf_dir):
    """Nations, regions and suppliers under one sorted header."""
    return D.union_by_name([X.table(spark, sf_dir, t) for t in ("nation", "region", "supplier")])


def id_batches(spark, sf_dir):
    batched = D.id_batches(X.lookup_ids(spark, sf_dir), [F.asc("pos")])
    return batched.select("id", "position", "batch")


def id_batch_kind(spark, sf_dir):
    batched = D.id_batches(X.lookup_ids(spark, sf_dir), [F.asc("pos")])
    return D.batch_kinds(batched).select("batch", "size", "kind")


def detail_lookup(spark, sf_dir):
    batched = D.id_batches(X.lookup_ids(spark, sf_dir), [F.asc("pos")])
    found = D.names_and_sites(D.detail_lookup(batched, _details(spark, sf_dir)))
    return found.select("position", "batch", "kind", "name", "website")


def envelope_union(spark, sf_dir):
    """Answers that are lists, or objects with a list of companies, or neither."""
    records = X.detail_json(spark, sf_dir).withColumn("batch", F.floor(F.col("rec_no") / 10).cast("bigint"))
    ordered = F.sort_array(F.collect_list(F.struct("rec_no", "json")))
    joined = F.array_join(F.transform(ordered, lambda r: r["json"]), ",")
    lists = records.groupBy("batch").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("list"))
    answer = (
        F.when(F.col("batch") % 3 == 0, F.col("list"))
        .when(F.col("batch") % 3 == 1, F.concat(F.lit('{"companies": '), F.col("list"), F.lit("}")))
        .otherwise(F.lit('{"error": "none"}'))
    )
    items = D.unwrap(lists.withColumn("answer", answer), "answer", "batch")
    return items.select("batch", F.col("pos").alias("pos"), F.get_json_object("json", "$.id").alias("id"))


def entity_by_domain(spark, sf_dir):
    found = D.entity_by_domain(_sites(spark, sf_dir), _directory(spark, sf_dir))
    return found.select("c_custkey", "domain", "entity_id")


def _lookalikes(spark, sf_dir):
    records = X.detail_json(spark, sf_dir)
    details = records.select(F.col("rec_no").alias("id"), X.company_url(F.col("rec_no")).alias("urn"), "json")
    return L.lookalikes_by_domain(_sites(spark, sf_dir), _directory(spark, sf_dir), X.company_vec(spark, sf_dir), details)


def lookalikes_by_domain(spark, sf_dir):
    """The companies most like those of all sites, with their details."""
    return _lookalikes(spark, sf_dir).select("query_id", "rank", "company_id", "kind", "name", "website")


def lookalikes_flat(spark, sf_dir):
    """The same as one flat table, by way of a CSV file."""
    path = f"{shared_folder(spark)}/lookalikes"
    D.write_flat_table(_lookalikes(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).fillna("")


QUERIES = {
    f.__name__: f
    for f in [
        website_polymorphic, detail_key_union, detail_flat_table, union_by_name, id_batches, id_batch_kind,
        detail_lookup, envelope_union, entity_by_domain, lookalikes_by_domain, lookalikes_flat,
    ]
}

_KEYS = ["id", "name", "nation", "segment", "website"]
_UNION = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"],
          "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
_COLUMNS = sorted(c for cols in _UNION.values() for c in cols)



def _by_site(body: str) -> str:
    return with_views("ranked shown_detail detail", body).replace(VIEWS["query_profile"][1], site_queries())


ORACLES = {
    "website_polymorphic": with_views("shown_detail", "SELECT rec_no, name, website FROM shown_detail"),
    # A null website is still a key; the merge that builds the SQL record drops it.
    "detail_key_union": with_views(
        "detail", "SELECT DISTINCT unnest(json_keys(json)) AS key FROM detail"
    ),
    "detail_flat_table": with_views(
        "detail",
        "SELECT " + ", ".join(f"coalesce(json_extract_string(json, '$.{k}'), '') AS {k}" for k in _KEYS) + " FROM detail",
    ),
    "union_by_name": " UNION ALL ".join(
        "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" if c in cols else f"'' AS {c}" for c in _COLUMNS) + f" FROM {t}"
        for t, cols in _UNION.items()
    ),
    "id_batches": with_views("lookup", "SELECT id, pos AS position, batch FROM lookup"),
    "id_batch_kind": with_views("lookup_kinds", "SELECT batch, size, kind FROM lookup_kinds"),
    "detail_lookup": with_views(
        "lookup lookup_kinds shown_detail",
        """SELECT pos AS position, batch, kind, name, website FROM lookup JOIN lookup_kinds USING (batch)
           JOIN shown_detail ON CASE kind WHEN 'ids' THEN rec_no = try_cast(id AS BIGINT)
             ELSE 'urn:company:' || rec_no = id END""",
    ),
    "envelope_union": """SELECT c_custkey // 10 AS batch, (c_custkey % 10)::INTEGER AS pos,
        c_custkey::VARCHAR AS id FROM customer WHERE c_custkey // 10 % 3 < 2""",
    "entity_by_domain": with_views(
        "company_vec",
        """SELECT c_custkey, 'company' || printf('%05d', c_custkey) || '.com' AS domain, company_id AS entity_id
           FROM customer JOIN (SELECT DISTINCT company_id FROM company_vec)
             ON company_id = 'https://company' || printf('%05d', c_custkey) || '.com'
           WHERE c_custkey % 4 <> 3""",
    ),
    "lookalikes_by_domain": _by_site(
        """SELECT query_id, rank, company_id, 'urns' AS kind, name, website FROM ranked
           JOIN shown_detail ON company_id = 'https://company' || printf('%05d', rec_no) || '.com' WHERE rank <= 25"""
    ),
    "lookalikes_flat": _by_site(
        "SELECT "
        + ", ".join(f"coalesce(json_extract_string(json, '$.{k}'), '') AS {k}" for k in _KEYS)
        + """ FROM ranked JOIN detail ON company_id = 'https://company' || printf('%05d', rec_no) || '.com' WHERE rank <= 25"""
    ),
}
