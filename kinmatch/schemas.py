"""Record shapes and constants of the company-similarity data model.

In the document schemas ``nullable=False`` means "key required and not null";
``nullable=True`` means the key may be absent or null.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType(), False)
VECTOR = T.ArrayType(T.FloatType())


def _struct(required: dict | None = None, optional: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in (required or {}).items()]
    fields += [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    return T.StructType(fields)


S = T.StringType()

# Profile fields in document order, and the weight of each.
TEXT_FIELDS = [
    "company_description",
    "industry_vertical",
    "product_form",
    "icp",
    "job_to_be_done",
    "revenue_model",
]
LIST_FIELDS = ["customer_list"]
PROFILE_FIELDS = TEXT_FIELDS + LIST_FIELDS
FIELD_WEIGHTS = {
    "company_description": 0.30,
    "industry_vertical": 0.20,
    "product_form": 0.15,
    "icp": 0.20,
    "job_to_be_done": 0.10,
    "revenue_model": 0.05,
}

# Search and batch sizes.
TOP_K_PER_FIELD = 500
TOP_N = 10
RECENT_ROWS = 5000
DETAIL_BATCH = 500
LOAD_BATCH = 100
LOOKALIKES = 25
SWEEP_SIZES = [10, 25, 50, 100]
SCORE_VARIANCE_GOOD = 0.001
LATENCY_SPREAD_GOOD = 0.5

# Columns of the CRM export, in file order.
CRM_COLUMNS = [
    "Affinity Row ID",
    "Organization Id",
    "Name",
    "Website",
    "Coverage status",
    "People",
    "Status",
    "Sector",
    "Sub-sector",
    "Investment Manager",
    "Description",
    "Primary Owner",
    "Deal Team",
    "Priority",
    "CB Investors - Not available for export",
    "Investors",
    "Source Name",
    "Source Type",
    "Date Added",
    "Time in Current Status",
    "Investment Stage",
    "AIN PoV",
    "Potential Outlier-Investor flag",
    "Pipeline Type",
]
CRM_SCHEMA = T.StructType([T.StructField(c, S) for c in CRM_COLUMNS])

# Fields of the stored records and of the documents below.
FIELD_VECTOR = _struct(
    optional={
        "doc_id": S,
        "company_id": S,
        "field_name": S,
        "text_content": S,
        "source_url": S,
        "embedding": VECTOR,
    }
)

COMPANY_PROFILE = _struct(optional={**{f: S for f in TEXT_FIELDS}, "customer_list": STRINGS})

COMPANY_DESCRIPTION = _struct(
    required={
        "target_audience": S,
        "problem_solved": S,
        "solution_approach": S,
        "uses_ai_automation": T.BooleanType(),
        "description_summary": S,
        "market_universe": S,
        "universe_boundaries": S,
    },
    optional={"unique_features": STRINGS},
)

SEGMENT = _struct(required={"segment_name": S, "pain_points": STRINGS})
COMPETITOR = _struct(
    required={"name": S, "description": S, "overlap_score": T.IntegerType()}, optional={"link": S}
)
MATRIX_ROW = _struct(
    required={
        "competitor_name": S,
        "feature_parity": S,
        "icp_overlap": S,
        "gtm_similarity": S,
        "pricing_similarity": S,
        "notable_edge": S,
    }
)
ANALYSIS = _struct(
    required={
        "summary": S,
        "segments": T.ArrayType(SEGMENT, False),
        "market_map": S,
        "features": S,
        "differentiators": STRINGS,
        "competitors": T.ArrayType(COMPETITOR, False),
        "matrix": T.ArrayType(MATRIX_ROW, False),
        "positioning_analysis": S,
    }
)
ANALYSIS_RESPONSE = _struct(
    required={"search_query_used": S, "comprehensive_analysis": ANALYSIS},
    optional={"search_confidence": S, "notes": S},
)
ANALYSIS_DEFAULTS = {"search_confidence": "medium"}

OVERLAP_RESPONSE = _struct(
    required={
        "target_customer": _struct(
            optional={"customer_types": STRINGS, "buyer_personas": STRINGS, "industries_served": STRINGS}
        ),
        "job_to_be_done": _struct(
            optional={"primary_problem": S, "key_use_cases": STRINGS, "outcome_delivered": S}
        ),
        "product_substitutability": _struct(
            optional={"substitutable_with": STRINGS, "customer_comparison_behavior": S}
        ),
        "channel_distribution": _struct(
            optional={"primary_acquisition_channels": STRINGS, "gtm_strategy": S, "positioning_style": S}
        ),
        "competitive_positioning": _struct(
            optional={
                "commonly_compared_to": STRINGS,
                "presence_on_review_sites": STRINGS,
                "investor_analyst_mentions": STRINGS,
            }
        ),
        "business_model": _struct(
            optional={"revenue_model": S, "pricing_strategy": S, "scalability_factors": STRINGS}
        ),
        "confidence_level": S,
    },
    optional={"sources": STRINGS},
)
