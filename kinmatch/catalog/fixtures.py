"""Company-similarity records derived from the star-schema test tables.

Every view reads its whole source table.  Awkward cases are planted by the
values of a row: missing fields, zero, empty and short vectors, bad websites,
null links, polymorphic documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.text import decode_entities, html_element, padded
from kinmatch.schemas import TEXT_FIELDS
from kinmatch.sources.captures import with_content

QUERY_COMPANIES = [13, 25, 37]
FAILED_SOURCE = (13, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; a small one, of few splits, is spread over the cores, with the same rows."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() > cores else rows.repartition(cores)


def company_url(number: Column) -> Column:
    return padded("https://company", number, suffix=".com")


def _names() -> Column:
    return F.array(*[F.lit(f) for f in TEXT_FIELDS])


def _field_vectors(rows: DataFrame, field: Column) -> DataFrame:
    vec = F.col("vec_id")
    embedding = (
        F.when(vec == 100, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
        .when(vec == 200, F.slice("embedding", 1, 0))
        .when(vec == 300, F.slice("embedding", 1, 63))
        .otherwise(F.col("embedding"))
    )
    label = F.col("label").cast("string")
    return rows.select(
        company_url(F.expr("vec_id div 6")).alias("company_id"),
        field.alias("field_name"),
        F.concat(F.lit("label"), label).alias("text_content"),
        F.when(vec % 2 == 0, F.concat(F.lit("field"), label)).alias("field_text"),
        embedding.alias("embedding"),
        vec.alias("seq"),
        F.col("label"),
    ).select(F.concat_ws("_", "company_id", "field_name").alias("doc_id"), "*", F.col("company_id").alias("source_url"))


def company_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (company, field); every 11th row becomes an unweighted field."""
    rows = table(spark, sf_dir, "embeddings")
    field = F.when(F.col("vec_id") % 11 == 5, F.lit("customer_list")).otherwise(
        F.get(_names(), (F.col("vec_id") % 6).cast("int"))
    )
    return _field_vectors(rows, field)


def damaged_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, some of them lost or with a value that is not a number."""
    damaged = F.when(F.col("seq") % 89 == 0, F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x)))
    vector = F.when(F.col("seq") % 97 != 0, damaged.otherwise(F.col("embedding")))
    rows = company_vec(spark, sf_dir)
    return rows.withColumn("embedding", vector.cast(rows.schema["embedding"].dataType))


def vec_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in write order, where some (company, field) pairs are written twice."""
    rows = table(spark, sf_dir, "embeddings")
    field = F.get(_names(), (F.col("vec_id") * F.col("vec_id") % 6).cast("int"))
    return _field_vectors(rows, field)


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the companies that are searched for."""
    ids = [f"https://company{n:05d}.com" for n in QUERY_COMPANIES]
    rows = company_vec(spark, sf_dir).filter(F.col("company_id").isin(ids))
    return rows.select(F.col("company_id").alias("query_id"), "field_name", "embedding")


def labelled_profiles(spark: SparkSession, sf_dir: str, label: int = 1) -> DataFrame:
    """The vectors of all companies that have a vector with this label."""
    rows = company_vec(spark, sf_dir)
    wanted = rows.filter(F.col("label") == label).select("company_id").distinct()
    return rows.join(wanted, "company_id", "left_semi").select(F.col("company_id").alias("query_id"), "field_name", "embedding")


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM export rows: orders with their customer and a captured page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    count = pages.select(F.count("*")).scalar()
    orders = table(spark, sf_dir, "orders").withColumn("page_id", F.col("o_orderkey") % count)
    customers = table(spark, sf_dir, "customer")
    key, url = F.col("o_orderkey"), F.col("url")
    kind = key % 8
    website = (
        F.when(kind == 0, url)
        .when(kind == 1, F.regexp_replace(url, "^https?://", ""))
        .when(kind == 2, F.upper(url))
        .when(kind == 3, F.concat(F.lit("\u00a0 "), url, F.lit(" \t")))
        .when(kind == 4, F.lit(""))
        .when(kind == 6, F.lit("https://"))
        .when(kind == 7, F.lit("not a url"))
    )
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(pages, "page_id")
        .select(
            key.alias("row_no"),
            F.concat(F.lit("row_"), key.cast("string")).alias("row_id"),
            padded("org_", key).alias("org_id"),
            F.col("c_name").alias("name"),
            website.alias("website"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_added"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.col("c_mktsegment").alias("sector"),
            F.when(key % 5 == 0, F.lit("N/A")).when(key % 5 == 1, F.lit("null")).otherwise(
                F.concat(F.lit('The "A" fund,\n'), F.col("c_name"))
            ).alias("investors"),
        )
    )


def crm_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRM rows under the column names of the export file."""
    rows = crm(spark, sf_dir)
    names = {
        "row_id": "Affinity Row ID",
        "org_id": "Organization Id",
        "name": "Name",
        "website": "Website",
        "status": "Status",
        "sector": "Sector",
        "priority": "Priority",
        "investors": "Investors",
        "date_added": "Date Added",
    }
    return rows.select(*[F.col(old).alias(new) for old, new in names.items()])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitor edges between parts; ``pos`` orders the list of each source."""
    items = table(spark, sf_dir, "lineitem")
    count = table(spark, sf_dir, "part").select(F.count("*")).scalar()
    pairs = items.groupBy(
        F.col("l_partkey").alias("src_no"), (F.col("l_orderkey") % count).alias("link_no")
    ).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    link = F.when((F.col("src_no") + F.col("pos")) % 10 == 0, F.lit(None)).otherwise(company_url(F.col("link_no")))
    return pairs.select(
        company_url(F.col("src_no")).alias("src"),
        "pos",
        F.concat(F.lit("Company "), F.col("link_no").cast("string")).alias("name"),
        F.concat(F.lit("Seen from "), F.col("src_no").cast("string")).alias("description"),
        (F.col("pos") % 4).cast("int").alias("overlap_score"),
        link.alias("link"),
    )


def failed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose page could not be analysed."""
    every, rest = FAILED_SOURCE
    parts = table(spark, sf_dir, "part")
    return parts.filter(F.col("p_partkey") % every == rest).select(company_url(F.col("p_partkey")).alias("src"))


def page_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of each address's first page; every 17th capture failed.

    A table of captures has one row per address, as a site is read once; the raw
    pages repeat addresses, and the ingest reads them all.
    """
    pages = texts(spark, sf_dir, "pages")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    read = with_content(pages.join(first, ["url", "page_id"], "left_semi"))
    content = F.when(F.col("page_id") % 17 == 0, F.lit("")).otherwise(F.col("content"))
    return read.select("page_id", "url", content.alias("content"))


PROFILE = [*TEXT_FIELDS, "customer_list"]


def with_profile(pages: DataFrame) -> DataFrame:
    """Adds the profile fields that can be read off the markup of a page."""
    html = F.col("html")
    nav = F.regexp_extract(html, r"(?s)<nav>(.*?)</nav>", 1)
    links = F.transform(F.regexp_extract_all(nav, F.lit(r"<a [^>]*>([^<]*)</a>"), F.lit(1)), decode_entities)
    lang = F.regexp_extract(html, r'<html lang="([^"]*)"', 1)
    return pages.select(
        "*",
        html_element(html, "title").alias("company_description"),
        F.when(F.col("page_id") % 9 == 0, F.lit("  ")).otherwise(lang).alias("industry_vertical"),
        html_element(html, "h1").alias("product_form"),
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("icp"),
        F.get(links, F.lit(0)).alias("job_to_be_done"),
        F.lit(None).cast("string").alias("revenue_model"),
        links.alias("customer_list"),
    )


def with_answer(pages: DataFrame) -> DataFrame:
    """Adds the profile as a JSON ``response``; every 13th page's is unusable."""
    answer = F.to_json(F.struct(*PROFILE), {"ignoreNullFields": "false"})
    response = F.when(F.col("page_id") % 13 == 0, F.lit("no profile")).otherwise(answer)
    return with_profile(pages).withColumn("response", response).drop(*PROFILE)


def profile_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of each page."""
    return with_profile(texts(spark, sf_dir, "pages")).select("page_id", F.col("url").alias("company_id"), *PROFILE)


def profile_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer about each address: that of its first page."""
    pages = with_answer(texts(spark, sf_dir, "pages"))
    return pages.groupBy(F.col("url").alias("company_id")).agg(F.min_by("response", "page_id").alias("response"))


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile answers about each document: valid, broken, mistyped and empty ones."""
    docs = texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id") % 6
    base = [
        F.col("text").alias("company_description"),
        F.col("lang").alias("industry_vertical"),
        F.when(F.col("quality") == 1, F.col("source")).alias("product_form"),
    ]
    extra = F.array("lang", "source").alias("customer_list")
    keep = {"ignoreNullFields": "false"}
    json = (
        F.when(key == 0, F.to_json(F.struct(*base, extra, F.lit(1).alias("other_key")), keep))
        .when(key == 1, F.concat(F.lit('{"company_description": '), F.to_json(F.struct("text"))))
        .when(key == 2, F.to_json(F.struct(*base, F.col("n_chars").alias("icp")), keep))
        .when(key == 3, F.lit("{}"))
        .when(key == 4, F.to_json(F.struct(*base, F.array("doc_id").alias("customer_list")), keep))
        .otherwise(F.to_json(F.array("lang", "source")))
    )
    return docs.select("doc_id", key.alias("kind"), json.alias("json"))


def _upto(count: Column, make) -> Column:
    """Array of ``make(i)`` for i from 0 below ``count``."""
    size = count.cast("int")
    return F.transform(
        F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), make
    )


SIGN_CYCLE = ["✓", "✗", "~", "?", "x"]


def analysis_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitive analysis of each document's source, some lists empty or too long."""
    docs = texts(spark, sf_dir, "documents")
    key = F.col("doc_id")

    def sign(i, shift):
        return F.get(F.array(*[F.lit(s) for s in SIGN_CYCLE]), ((key + i + shift) % 5).cast("int"))

    def name(i):
        return F.concat(F.lit("Rival "), (key * 7 + i).cast("string"))

    competitors = _upto(
        key % 13,
        lambda i: F.struct(
            name(i).alias("name"),
            F.concat(F.col("lang"), F.lit(" rival")).alias("description"),
            ((key + i) % 5).cast("int").alias("overlap_score"),
            F.when((key + i) % 4 != 0, company_url(key * 7 + i)).alias("link"),
        ),
    )
    matrix = _upto(
        key % 13,
        lambda i: F.struct(
            name(i).alias("competitor_name"),
            sign(i, 0).alias("feature_parity"),
            sign(i, 1).alias("icp_overlap"),
            sign(i, 2).alias("gtm_similarity"),
            sign(i, 3).alias("pricing_similarity"),
            F.col("source").alias("notable_edge"),
        ),
    )
    segments = _upto(
        key % 3,
        lambda s: F.struct(
            F.concat(F.col("lang"), F.lit(" segment "), s.cast("string")).alias("segment_name"),
            _upto((key + s) % 5, lambda p: F.concat(F.lit("pain "), p.cast("string"))).alias("pain_points"),
        ),
    )
    analysis = F.struct(
        F.col("text").alias("summary"),
        segments.alias("segments"),
        F.concat_ws(" → ", "lang", "source").alias("market_map"),
        F.col("source").alias("features"),
        _upto(key % 7, lambda i: F.concat(F.lit("edge "), i.cast("string"))).alias("differentiators"),
        competitors.alias("competitors"),
        matrix.alias("matrix"),
        F.col("source").alias("positioning_analysis"),
    )
    return docs.select("doc_id", "source", analysis.alias("analysis"))


def analysis_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyses as JSON answers: by key broken, mistyped, incomplete or valid."""
    docs = analysis_doc(spark, sf_dir)
    keep = {"ignoreNullFields": "false"}
    query = F.concat(F.lit("Analysis of "), F.col("source")).alias("search_query_used")
    body = F.col("analysis").alias("comprehensive_analysis")
    kind = F.col("doc_id") % 6
    mistyped = F.col("analysis").withField("summary", F.col("doc_id")).alias("comprehensive_analysis")
    confidence = "search_confidence"
    json = (
        F.when(kind == 0, F.to_json(F.struct(query, F.lit("high").alias(confidence), body), keep))
        .when(kind == 1, F.concat(F.to_json(F.struct(query)), F.lit("]")))
        .when(kind == 2, F.to_json(F.struct(query, mistyped), keep))
        .when(kind == 3, F.to_json(F.struct(body), keep))
        .when(kind == 4, F.to_json(F.struct(query, F.lit(None).cast("string").alias(confidence), body), keep))
        .otherwise(F.to_json(F.struct(query, body), keep))
    )
    return docs.select("doc_id", json.alias("json"))


def overlap_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-dimension answers about each document; keys 3 and 5 of 6 are incomplete."""
    docs = texts(spark, sf_dir, "documents")
    key = F.col("doc_id")
    keep = {"ignoreNullFields": "false"}

    def strings(*items):
        return F.array(*items).cast("array<string>")

    parts = {
        "target_customer": F.struct(
            F.when(key % 4 != 1, strings("lang", "source")).alias("customer_types"),
            strings().alias("buyer_personas"),
        ),
        "job_to_be_done": F.struct(
            F.col("text").alias("primary_problem"),
            strings("source").alias("key_use_cases"),
            F.lit("").alias("outcome_delivered"),
        ),
        "product_substitutability": F.struct(F.col("lang").alias("customer_comparison_behavior")),
        "channel_distribution": F.struct(F.col("source").alias("gtm_strategy")),
        "competitive_positioning": F.struct(strings("lang").alias("commonly_compared_to")),
        "business_model": F.struct(F.when(key % 2 == 0, F.col("source")).alias("revenue_model")),
    }
    sources = F.when(key % 3 != 0, strings("source", "lang")).alias("sources")
    confidence = F.lit("medium").alias("confidence_level")
    columns = [v.alias(k) for k, v in parts.items()]
    json = (
        F.when(key % 6 == 3, F.to_json(F.struct(*columns[:-1], confidence, sources), keep))
        .when(key % 6 == 5, F.to_json(F.struct(*columns, sources), keep))
        .otherwise(F.to_json(F.struct(*columns, confidence, sources), keep))
    )
    return docs.select("doc_id", json.alias("json"))


def detail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail records of companies: websites in several shapes, keys that come and go."""
    key = F.col("c_custkey")
    site = F.concat(F.lit('"'), company_url(key), F.lit('"'))
    parts = [
        F.concat(F.lit('"id": '), key.cast("string")),
        F.when(key % 7 != 0, F.concat(F.lit('"name": "'), F.col("c_name"), F.lit('"'))),
        F.when(key % 5 == 0, F.concat(F.lit('"website": {"url": '), site, F.lit("}")))
        .when(key % 5 == 1, F.concat(F.lit('"website": '), site))
        .when(key % 5 == 2, F.lit('"website": null'))
        .when(key % 5 == 4, F.lit('"website": {"rank": 1}')),
        F.when(key % 3 == 0, F.concat(F.lit('"segment": "'), F.col("c_mktsegment"), F.lit('"'))),
        F.when(key % 4 == 0, F.concat(F.lit('"nation": '), F.col("c_nationkey").cast("string"))),
    ]
    json = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return table(spark, sf_dir, "customer").select(key.alias("rec_no"), json.alias("json"))


def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to look up, in list order: runs of numbers, urns, and numbers with a stray."""
    key = F.col("c_custkey")
    run = F.floor(key / 500) % 3
    identifier = (
        F.when(run == 1, F.concat(F.lit("urn:company:"), key.cast("string")))
        .when((run == 2) & (key % 500 == 250), F.concat(F.lit("stray-"), key.cast("string")))
        .otherwise(key.cast("string"))
    )
    return table(spark, sf_dir, "customer").select(key.alias("pos"), identifier.alias("id"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search runs: elapsed seconds and result counts by group."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("grp"),
        (F.col("value") / 1000).alias("elapsed_s"),
        (F.col("user_id") % 30).alias("result_count"),
    )
