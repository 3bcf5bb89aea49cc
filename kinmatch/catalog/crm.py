"""Catalog: CRM files, websites, names, dates and generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import with_views
from kinmatch.functions import text as T
from kinmatch.functions import urls as U
from kinmatch.plans import prune as P
from kinmatch.session import shared_folder
from kinmatch.sources import crm as C

BY_ROW = {"website": "website", "date": "date_added", "tie_break": "row_no"}


def _export(spark, sf_dir) -> str:
    path = f"{shared_folder(spark)}/crm"
    C.write_csv(X.crm_export(spark, sf_dir), path)
    return path


def scan_crm(spark, sf_dir):
    rows = C.read_crm(spark, _export(spark, sf_dir), na_tokens=C.NA_TOKENS)
    return rows.select(
        F.col("Affinity Row ID").alias("row_id"),
        F.col("Name").alias("name"),
        F.col("Website").alias("website"),
        F.col("Investors").alias("investors"),
        F.col("Date Added").alias("date_added"),
        F.col("`CB Investors - Not available for export`").isNull().alias("cb_absent"),
    )


def csv_roundtrip(spark, sf_dir):
    rows = C.read_crm(spark, _export(spark, sf_dir))
    return rows.select(
        F.col("Affinity Row ID").alias("row_id"),
        F.col("Organization Id").alias("org_id"),
        F.col("Name").alias("name"),
        F.col("Website").alias("website"),
        F.col("Investors").alias("investors"),
    )


def url_valid(spark, sf_dir):
    return X.crm(spark, sf_dir).select("row_no", U.is_valid_website(F.col("website")).alias("valid"))


def url_normalise(spark, sf_dir):
    return X.crm(spark, sf_dir).select("row_no", U.with_scheme(F.col("website")).alias("url"))


def url_domain(spark, sf_dir):
    raw = F.concat(F.lit("https://www."), F.regexp_replace("url", "^https?://", ""), F.lit("//"))
    return X.table(spark, sf_dir, "pages").select(
        "page_id", U.domain(F.col("url")).alias("plain"), U.domain(raw).alias("decorated")
    )


def blank_guard(spark, sf_dir):
    rows = X.crm(spark, sf_dir)
    return rows.filter(~U.is_blank(F.col("website"))).select("row_no", "website")


def date_parse(spark, sf_dir):
    rows = X.crm(spark, sf_dir)
    strict = T.parse_date(F.col("date_added"))
    # The website is never a date: the lenient reading turns it into null.
    lenient = T.parse_date(F.coalesce("website", "date_added"), on_error="null")
    return rows.select(
        "row_no", T.format_date(strict).alias("added"), T.format_date(lenient, "yyyy/MM/dd").alias("lenient")
    )


def text_preview(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.preview(F.col("text")).alias("preview"), T.preview(F.col("text"), 50).alias("short"))


def recent_valid(spark, sf_dir):
    return P.recent_valid(X.crm(spark, sf_dir), **BY_ROW).select("row_no", "website", "date_added")


def prune_profile(spark, sf_dir):
    return P.prune_profile(X.crm(spark, sf_dir), **BY_ROW)


def prune_crm(spark, sf_dir):
    """File to file: scan, parse dates, keep valid websites, newest first, write."""
    rows = C.read_crm(spark, _export(spark, sf_dir))
    path = f"{shared_folder(spark)}/pruned"
    C.write_csv(P.recent_valid(rows), path, single_file=True)
    kept = C.read_crm(spark, path)
    return kept.select(
        F.col("Affinity Row ID").alias("row_id"),
        F.col("Website").alias("website"),
        F.col("Date Added").alias("date_added"),
    )


def id_format(spark, sf_dir):
    key = F.col("o_orderkey")
    return X.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.padded("https://company", key, suffix=".com").alias("company"),
        T.padded("org_", key).alias("org"),
        F.format_string("row_%d", key).alias("row"),
    )


def doc_id(spark, sf_dir):
    return X.company_vec(spark, sf_dir).select(
        "seq", T.document_id(F.col("company_id"), F.col("field_name")).alias("doc_id")
    )


def name_slug(spark, sf_dir):
    parts = X.table(spark, sf_dir, "part")
    raw = F.concat_ws(" & ", "p_name", "p_brand", "p_type")
    return parts.select("p_partkey", T.name_slug(raw).alias("slug"))


def name_class(spark, sf_dir):
    parts = X.table(spark, sf_dir, "part")
    raw = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    docs = X.table(spark, sf_dir, "documents")
    return parts.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), T.name_kind(raw).alias("class")).union(
        docs.select(F.lit("doc"), "doc_id", T.name_kind(F.col("text")))
    )


_KINDS = ["standard", "tech", "developer", "modern", "regional"]


def website_from_name(spark, sf_dir):
    key = F.col("p_partkey")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (key % 5).cast("int"))
    name = F.concat_ws(" ", "p_name", F.lit("Technologies"), "p_type")
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", T.website_from_name(name, kind, key % 6, F.floor(key / 6)).alias("site")
    )


def describe_from_template(spark, sf_dir):
    key = F.col("p_partkey")
    slots = {
        "industry": F.col("p_type"),
        "product_form": F.col("p_name"),
        "icp": F.col("p_brand"),
        "job": F.concat(F.lit("Size "), F.col("p_size").cast("string")),
    }
    return X.table(spark, sf_dir, "part").select("p_partkey", T.describe(key % 7, slots).alias("description"))


QUERIES = {
    f.__name__: f
    for f in [
        scan_crm, csv_roundtrip, url_valid, url_normalise, url_domain, blank_guard, date_parse, text_preview,
        recent_valid, prune_profile, prune_crm, id_format, doc_id, name_slug, name_class, website_from_name,
        describe_from_template,
    ]
}


# The SQL side states its own lists.
_MISSING = "|#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null"
_KIND_WORDS = {"tech": "ai|tech|cyber|data", "developer": "code|dev|stack|ops", "modern": "app|cloud|space"}


def _nullable(column: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in _MISSING.split("|"))
    return f"CASE WHEN {column} NOT IN ({tokens}) THEN {column} END AS {column}"


_NEWEST = """SELECT * FROM checked WHERE valid ORDER BY date_added DESC NULLS LAST, {0} LIMIT 5000"""
_WORDS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{0}}), '{words}') THEN '{kind}'" for kind, words in _KIND_WORDS.items()
) + " ELSE 'standard' END"
_SLUG = "lower(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[ -]', '', 'g'))"
_TEMPLATES = ", ".join("'" + t.replace("'", "''") + "'" for t in T.DESCRIPTION_TEMPLATES)
_ENDINGS = " ".join(
    f"WHEN {i} THEN ([{', '.join(repr(e) for e in T.DOMAIN_ENDINGS[k])}])[(p_partkey // 6) % {len(T.DOMAIN_ENDINGS[k])} + 1]"
    for i, k in enumerate(_KINDS)
)

ORACLES = {
    "scan_crm": with_views(
        "crm",
        f"SELECT row_id, name, {_nullable('website')}, {_nullable('investors')}, date_added, true AS cb_absent FROM crm",
    ),
    "csv_roundtrip": with_views("crm", "SELECT row_id, org_id, name, nullif(website, '') AS website, investors FROM crm"),
    "url_valid": with_views("checked", "SELECT row_no, valid FROM checked"),
    "url_normalise": with_views(
        "crm",
        """SELECT row_no, CASE WHEN starts_with(website, 'http://') OR starts_with(website, 'https://') THEN website
             ELSE 'https://' || website END AS url FROM crm""",
    ),
    "url_domain": """SELECT page_id,
        rtrim(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), '/') AS plain,
        rtrim(replace(replace(replace('https://www.' || regexp_replace(url, '^https?://', '') || '//',
          'https://', ''), 'http://', ''), 'www.', ''), '/') AS decorated FROM pages""",
    "blank_guard": with_views(
        "crm", "SELECT row_no, website FROM crm WHERE trim(website, chr(32) || chr(9) || chr(160)) <> ''"
    ),
    "date_parse": with_views(
        "crm",
        """SELECT row_no, strftime(date_added::DATE, '%Y-%m-%d') AS added,
             strftime(try_cast(coalesce(website, date_added) AS DATE), '%Y/%m/%d') AS lenient FROM crm""",
    ),
    "text_preview": """SELECT doc_id,
        CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview,
        CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short FROM documents""",
    "recent_valid": with_views("checked", f"SELECT row_no, website, date_added FROM ({_NEWEST.format('row_no')})"),
    "prune_profile": with_views(
        "checked",
        f"""SELECT (SELECT count(*) FROM checked) AS input_rows,
             (SELECT count(*) FROM checked WHERE valid) AS valid_rows, count(*) AS output_rows,
             min(date_added) AS first_date, max(date_added) AS last_date, 10::INTEGER AS columns
           FROM ({_NEWEST.format('row_no')})""",
    ),
    "prune_crm": with_views("checked", f"SELECT row_id, website, date_added FROM ({_NEWEST.format('row_id')})"),
    "id_format": """SELECT o_orderkey, 'https://company' || printf('%05d', o_orderkey) || '.com' AS company,
        'org_' || printf('%05d', o_orderkey) AS org, 'row_' || o_orderkey AS "row" FROM orders""",
    "doc_id": with_views("company_vec", "SELECT seq, company_id || '_' || field_name AS doc_id FROM company_vec"),
    "name_slug": f"""SELECT p_partkey, {_SLUG.format("p_name || ' & ' || p_brand || ' & ' || p_type")} AS slug
        FROM part""",
    "name_class": f"""SELECT 'part' AS kind, p_partkey AS id,
          {_WORDS.format("(p_name || ' ' || p_brand || ' ' || p_type)")} AS class FROM part
        UNION ALL SELECT 'doc', doc_id, {_WORDS.format('text')} FROM documents""",
    "website_from_name": f"""SELECT p_partkey,
        CASE WHEN p_partkey % 6 < 5 THEN (['', 'get', 'use', 'try', 'join'])[p_partkey % 6 + 1] || slug
             ELSE replace(slug, 'technologies', 'tech') END
        || CASE p_partkey % 5 {_ENDINGS} END AS site
        FROM (SELECT *, {_SLUG.format("p_name || ' Technologies ' || p_type")} AS slug FROM part)""",
    "describe_from_template": f"""SELECT p_partkey,
        replace(replace(replace(replace(([{_TEMPLATES}])[p_partkey % 7 + 1], '{{industry}}', lower(p_type)),
          '{{product_form}}', lower(p_name)), '{{icp}}', lower(p_brand)), '{{job}}', 'size ' || p_size)
        AS description FROM part""",
}
