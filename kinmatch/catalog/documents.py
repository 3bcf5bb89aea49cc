"""Catalog: validation and flattening of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.catalog.views import with_views
from kinmatch.functions import text as T
from kinmatch.functions.documents import validate
from kinmatch.functions.prompts import PARTS, prompt
from kinmatch.operators import documents as N
from kinmatch.schemas import (
    ANALYSIS_DEFAULTS,
    ANALYSIS_RESPONSE,
    COMPANY_PROFILE,
    OVERLAP_RESPONSE,
    PROFILE_FIELDS,
    TEXT_FIELDS,
)


def _profiles(spark, sf_dir):
    rows = X.response_json(spark, sf_dir)
    return rows.select("doc_id", validate(F.col("json"), COMPANY_PROFILE).alias("document"))


def _analyses(spark, sf_dir):
    rows = X.analysis_response(spark, sf_dir)
    return N.valid_documents(rows, "json", ANALYSIS_RESPONSE, ANALYSIS_DEFAULTS)


def _overlaps(spark, sf_dir):
    rows = X.overlap_response(spark, sf_dir)
    return rows.select("doc_id", validate(F.col("json"), OVERLAP_RESPONSE).alias("document"))


def validate_profile_json(spark, sf_dir):
    rows = _profiles(spark, sf_dir)
    return rows.select(
        "doc_id",
        F.col("document").isNotNull().alias("valid"),
        *[f"document.{f}" for f in TEXT_FIELDS],
        F.array_join("document.customer_list", "|").alias("customers"),
    )


def validate_analysis_json(spark, sf_dir):
    rows = X.analysis_response(spark, sf_dir)
    document = validate(F.col("json"), ANALYSIS_RESPONSE, ANALYSIS_DEFAULTS)
    checked = rows.select("doc_id", document.alias("document"))
    return checked.select(
        "doc_id",
        F.col("document").isNotNull().alias("valid"),
        "document.search_query_used",
        F.col("document.comprehensive_analysis.summary").alias("summary"),
        F.col("document.comprehensive_analysis.market_map").alias("market_map"),
    )


def default_on_absent(spark, sf_dir):
    return _analyses(spark, sf_dir).select("doc_id", "document.search_confidence", "document.notes")


def validate_overlap_json(spark, sf_dir):
    return _overlaps(spark, sf_dir).select(
        "doc_id",
        F.col("document").isNotNull().alias("valid"),
        F.col("document.job_to_be_done.primary_problem").alias("primary_problem"),
        F.col("document.confidence_level").alias("confidence_level"),
    )


def profile_unpivot(spark, sf_dir):
    return N.profile_rows(X.profile_doc(spark, sf_dir), ["page_id"])


def field_flatten(spark, sf_dir):
    """List items joined; null and empty items are dropped, a blank one stays."""
    rows = X.profile_doc(spark, sf_dir)
    items = F.concat("customer_list", F.array(F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.col("icp")))
    return rows.select("page_id", T.join_items(items).alias("joined"))


def explode_competitors(spark, sf_dir):
    return N.competitors(_analyses(spark, sf_dir), ["doc_id"])


def explode_segments(spark, sf_dir):
    return N.pain_points(_analyses(spark, sf_dir), ["doc_id"])


def matrix_table(spark, sf_dir):
    return N.matrix_rows(_analyses(spark, sf_dir), ["doc_id"])


def explode_differentiators(spark, sf_dir):
    return N.differentiators(_analyses(spark, sf_dir), ["doc_id"])


def doc_quality_audit(spark, sf_dir):
    return N.quality_audit(_analyses(spark, sf_dir))


def placeholder_fill(spark, sf_dir):
    valid = N.valid_documents(X.overlap_response(spark, sf_dir), "json", OVERLAP_RESPONSE)
    return N.overlap_rows(valid, ["doc_id"])


def bool_label(spark, sf_dir):
    rows = X.table(spark, sf_dir, "labels")
    flag = F.when(F.col("doc_id") % 5 != 0, F.col("toxic") == 1)
    return rows.select("doc_id", T.yes_no(flag).alias("label"))


def prompt_table(spark, sf_dir):
    """Prompts over page profiles; the features line is there only with features."""
    rows = X.profile_doc(spark, sf_dir)
    features = F.when(F.col("page_id") % 3 == 0, F.array()).otherwise(F.col("customer_list"))
    parts = [
        ("", F.coalesce("company_description", F.lit(""))),
        ("Audience", F.col("icp")),
        ("Uses AI", T.yes_no(F.col("page_id") % 2 == 0)),
        ("Features", T.features_line(features)),
    ]
    return rows.select("page_id", T.labelled_lines(parts).alias("prompt"))


def prompt_builders(spark, sf_dir):
    """Every page under each of the prompts; a page without text has none."""
    pages = X.page_capture(spark, sf_dir)
    text = F.when(F.col("page_id") % 7 != 0, F.col("content")).otherwise(F.lit(" \t"))
    made = F.array(*[F.struct(F.lit(p).alias("purpose"), prompt(p, text).alias("prompt")) for p in PARTS])
    return pages.select("page_id", F.inline(made)).filter("prompt IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in [
        validate_profile_json, validate_analysis_json, default_on_absent, validate_overlap_json, profile_unpivot,
        field_flatten, explode_competitors, explode_segments, matrix_table, explode_differentiators,
        doc_quality_audit, placeholder_fill, bool_label, prompt_table, prompt_builders,
    ]
}

_TEXTS = ", ".join(f"CASE WHEN valid THEN json_extract_string(json, '$.{f}') END AS {f}" for f in TEXT_FIELDS)
_BLANK = "regexp_matches({0}, '[^ \\t\\r\\n]')"
_UNPIVOT = " UNION ALL ".join(
    f"SELECT page_id, '{f}' AS field_name, "
    + (f if f in TEXT_FIELDS else f"array_to_string(list_filter({f}, lambda x: x <> ''), ', ')")
    + " AS text_content FROM profile_doc"
    for f in PROFILE_FIELDS
)
_GAP = "coalesce(nullif({0}, ''), '[Not enough information]')"
_OVERLAP = [
    ("target_customer", "customer_types",
     "array_to_string(json_extract_string(json, '$.target_customer.customer_types[*]'), ', ')"),
    ("target_customer", "buyer_personas", "NULL"),
    ("target_customer", "industries_served", "NULL"),
    ("job_to_be_done", "primary_problem", "json_extract_string(json, '$.job_to_be_done.primary_problem')"),
    ("job_to_be_done", "key_use_cases", "json_extract_string(json, '$.job_to_be_done.key_use_cases[0]')"),
    ("job_to_be_done", "outcome_delivered", "json_extract_string(json, '$.job_to_be_done.outcome_delivered')"),
    ("product_substitutability", "substitutable_with", "NULL"),
    ("product_substitutability", "customer_comparison_behavior",
     "json_extract_string(json, '$.product_substitutability.customer_comparison_behavior')"),
    ("channel_distribution", "primary_acquisition_channels", "NULL"),
    ("channel_distribution", "gtm_strategy", "json_extract_string(json, '$.channel_distribution.gtm_strategy')"),
    ("channel_distribution", "positioning_style", "NULL"),
    ("competitive_positioning", "commonly_compared_to",
     "json_extract_string(json, '$.competitive_positioning.commonly_compared_to[0]')"),
    ("competitive_positioning", "presence_on_review_sites", "NULL"),
    ("competitive_positioning", "investor_analyst_mentions", "NULL"),
    ("business_model", "revenue_model", "json_extract_string(json, '$.business_model.revenue_model')"),
    ("business_model", "pricing_strategy", "NULL"),
    ("business_model", "scalability_factors", "NULL"),
]
_OVERLAP_ROWS = " UNION ALL ".join(
    [
        f"SELECT doc_id, '{d}' AS dimension, '{f}' AS field, {_GAP.format(v)} AS shown FROM overlap_valid WHERE valid"
        for d, f, v in _OVERLAP
    ]
    + [
        "SELECT doc_id, 'document', 'confidence_level', json_extract_string(json, '$.confidence_level')"
        " FROM overlap_valid WHERE valid",
        "SELECT doc_id, 'document', 'sources', coalesce(nullif(array_to_string("
        "json_extract_string(json, '$.sources[*]'), ', '), ''), 'No sources provided') FROM overlap_valid WHERE valid",
    ]
)

ORACLES = {
    "validate_profile_json": with_views(
        "profile_valid",
        f"""SELECT doc_id, valid, {_TEXTS}, CASE WHEN valid AND json_type(json, '$.customer_list') = 'ARRAY'
              THEN array_to_string(json_extract_string(json, '$.customer_list[*]'), '|') END AS customers
            FROM profile_valid""",
    ),
    "validate_analysis_json": with_views(
        "analysis_valid",
        """SELECT doc_id, valid, CASE WHEN valid THEN json_extract_string(json, '$.search_query_used') END
             AS search_query_used,
             CASE WHEN valid THEN json_extract_string(json, '$.comprehensive_analysis.summary') END AS summary,
             CASE WHEN valid THEN json_extract_string(json, '$.comprehensive_analysis.market_map') END AS market_map
           FROM analysis_valid""",
    ),
    "default_on_absent": with_views(
        "analysis_valid",
        """SELECT doc_id, CASE WHEN json_type(json, '$.search_confidence') IS NULL THEN 'medium'
             ELSE json_extract_string(json, '$.search_confidence') END AS search_confidence,
             NULL::VARCHAR AS notes FROM analysis_valid WHERE valid""",
    ),
    "validate_overlap_json": with_views(
        "overlap_valid",
        """SELECT doc_id, valid,
             CASE WHEN valid THEN json_extract_string(json, '$.job_to_be_done.primary_problem') END AS primary_problem,
             CASE WHEN valid THEN json_extract_string(json, '$.confidence_level') END AS confidence_level
           FROM overlap_valid""",
    ),
    "profile_unpivot": with_views(
        "profile_doc", f"SELECT * FROM ({_UNPIVOT}) WHERE {_BLANK.format('text_content')}"
    ),
    "field_flatten": with_views(
        "profile_doc",
        """SELECT page_id, array_to_string(list_filter(list_concat(customer_list, ['', NULL, ' ', icp]),
             lambda x: x <> ''), ', ') AS joined FROM profile_doc""",
    ),
    "explode_competitors": with_views(
        "good_analysis",
        """SELECT doc_id, pos::INTEGER AS pos, c.name AS name, c.description AS description,
             c.overlap_score::INTEGER AS overlap_score, c.link AS link
           FROM (SELECT doc_id, unnest(competitors) AS c, generate_subscripts(competitors, 1) AS pos
                 FROM good_analysis)""",
    ),
    "explode_segments": with_views(
        "good_analysis",
        """SELECT doc_id, s::INTEGER AS segment_pos, seg.segment_name AS segment_name, p::INTEGER AS pain_pos,
             seg.pain_points[p] AS pain_point
           FROM (SELECT doc_id, s, seg, unnest(CASE WHEN len(seg.pain_points) > 0
                        THEN range(1, len(seg.pain_points) + 1) ELSE [NULL] END) AS p
                 FROM (SELECT doc_id, s, segments[s] AS seg FROM (
                   SELECT doc_id, segments, unnest(CASE WHEN len(segments) > 0 THEN range(1, len(segments) + 1)
                          ELSE [NULL] END) AS s FROM good_analysis)))""",
    ),
    "matrix_table": with_views(
        "good_analysis",
        """SELECT doc_id, m.competitor_name AS competitor_name, m.feature_parity AS feature_parity,
             m.icp_overlap AS icp_overlap, m.gtm_similarity AS gtm_similarity,
             m.pricing_similarity AS pricing_similarity, m.notable_edge AS notable_edge
           FROM (SELECT doc_id, unnest(matrix) AS m FROM good_analysis)""",
    ),
    "explode_differentiators": with_views(
        "good_analysis",
        """SELECT doc_id, unnest(differentiators) AS differentiator,
             generate_subscripts(differentiators, 1)::INTEGER AS pos FROM good_analysis""",
    ),
    "doc_quality_audit": with_views(
        "good_analysis",
        """SELECT count(*) AS documents,
             sum(len(list_filter(competitors, lambda c: c.overlap_score > 3)))::BIGINT AS bad_overlap,
             sum(len(list_filter(matrix, lambda m: m.feature_parity = 'x'))
               + len(list_filter(matrix, lambda m: m.icp_overlap = 'x'))
               + len(list_filter(matrix, lambda m: m.gtm_similarity = 'x'))
               + len(list_filter(matrix, lambda m: m.pricing_similarity = 'x')))::BIGINT AS bad_signs,
             sum(len(list_filter(segments, lambda s: len(s.pain_points) > 3)))::BIGINT AS long_pain_lists,
             count(*) FILTER (len(competitors) > 10) AS long_competitor_lists,
             count(*) FILTER (len(differentiators) <> 5) AS not_five_differentiators
           FROM good_analysis""",
    ),
    "placeholder_fill": with_views("overlap_valid", _OVERLAP_ROWS),
    "bool_label": """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND toxic = 1 THEN 'Yes' ELSE 'No' END AS label
        FROM labels""",
    "prompt_table": with_views(
        "profile_doc",
        """SELECT page_id, concat_ws(chr(10), coalesce(company_description, ''), 'Audience: ' || icp,
             'Uses AI: ' || CASE WHEN page_id % 2 = 0 THEN 'Yes' ELSE 'No' END,
             CASE WHEN page_id % 3 <> 0 AND len(customer_list) > 0
               THEN 'Features: ' || array_to_string(customer_list, ', ') END) AS prompt
           FROM profile_doc""",
    ),
}

_FRAMES = ", ".join("('{}', '{}', '{}')".format(p, *[t.replace("'", "''") for t in parts]) for p, parts in PARTS.items())
ORACLES["prompt_builders"] = with_views(
    "page_capture",
    f"""SELECT page_id, purpose, head || content || tail AS prompt
        FROM page_capture, (VALUES {_FRAMES}) AS f(purpose, head, tail)
        WHERE page_id % 7 <> 0 AND trim(content) <> ''""",
)
