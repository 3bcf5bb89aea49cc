"""Flattening of validated documents into rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.bind import with_once
from kinmatch.functions.documents import validate
from kinmatch.functions.text import NO_SOURCES, join_items, or_placeholder
from kinmatch.functions.urls import is_blank
from kinmatch.schemas import LIST_FIELDS, OVERLAP_RESPONSE, TEXT_FIELDS


def valid_documents(
    rows: DataFrame, json: str, schema: T.StructType, defaults: Mapping[str, str] | None = None, name: str = "document"
) -> DataFrame:
    """Rows whose JSON fits the schema, with the document as a struct instead."""
    checked = with_once(rows, name, validate(F.col(json), schema, defaults))
    return checked.filter(F.col(name).isNotNull()).drop(json)


def profile_rows(
    profiles: DataFrame, keys: Sequence[str], texts: Sequence[str] = TEXT_FIELDS, lists: Sequence[str] = LIST_FIELDS
) -> DataFrame:
    """One row per filled profile field: ``keys, field_name, text_content``."""
    values = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text_content")) for f in texts]
    values += [F.struct(F.lit(f).alias("field_name"), join_items(F.col(f)).alias("text_content")) for f in lists]
    rows = profiles.select(*keys, F.inline(F.array(*values)))
    return rows.filter(~is_blank(F.col("text_content")))


def competitors(analyses: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    """Competitors of each document, numbered from 1 in list order."""
    listed = F.col(f"{document}.comprehensive_analysis.competitors")
    rows = analyses.select(*keys, F.posexplode(listed).alias("_p", "_c"))
    return rows.select(*keys, (F.col("_p") + 1).alias("pos"), "_c.*")


def pain_points(analyses: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    """Segments and their pain points; a segment without any keeps one row."""
    listed = F.col(f"{document}.comprehensive_analysis.segments")
    segments = analyses.select(*keys, F.posexplode_outer(listed).alias("_s", "_segment"))
    rows = segments.select(
        *keys,
        (F.col("_s") + 1).alias("segment_pos"),
        F.col("_segment.segment_name").alias("segment_name"),
        F.posexplode_outer("_segment.pain_points").alias("_p", "pain_point"),
    )
    return rows.withColumn("pain_pos", F.col("_p") + 1).drop("_p")


def matrix_rows(analyses: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    return analyses.select(*keys, F.inline(F.col(f"{document}.comprehensive_analysis.matrix")))


def differentiators(analyses: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    listed = F.col(f"{document}.comprehensive_analysis.differentiators")
    rows = analyses.select(*keys, F.posexplode(listed).alias("_p", "differentiator"))
    return rows.withColumn("pos", F.col("_p") + 1).drop("_p")


# Signs a matrix cell may hold, and the stated list and score limits.
SIGNS = ["✓", "✗", "~", "?"]
LIMITS = {"pain_points": 3, "competitors": 10, "differentiators": 5, "overlap_score": 3}


def quality_audit(analyses: DataFrame, document: str = "document") -> DataFrame:
    """Counts of values outside the stated ranges; no document is rejected."""
    a = f"{document}.comprehensive_analysis"

    def count(items: Column, bad) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(items, bad))), F.lit(0)).cast("bigint")

    cells = ["feature_parity", "icp_overlap", "gtm_similarity", "pricing_similarity"]
    in_matrix = F.flatten(F.transform(F.col(f"{a}.matrix"), lambda r: F.array(*[r[c] for c in cells])))
    return analyses.agg(
        F.count(F.lit(1)).alias("documents"),
        count(
            F.col(f"{a}.competitors"), lambda c: ~c["overlap_score"].between(0, LIMITS["overlap_score"])
        ).alias("bad_overlap"),
        count(in_matrix, lambda s: ~s.isin(SIGNS)).alias("bad_signs"),
        count(
            F.col(f"{a}.segments"), lambda s: F.size(s["pain_points"]) > LIMITS["pain_points"]
        ).alias("long_pain_lists"),
        F.count_if(F.size(f"{a}.competitors") > LIMITS["competitors"]).alias("long_competitor_lists"),
        F.count_if(F.size(f"{a}.differentiators") != LIMITS["differentiators"]).alias("not_five_differentiators"),
    )


def overlap_rows(documents: DataFrame, keys: Sequence[str], document: str = "document") -> DataFrame:
    """Six-dimension documents as ``keys, dimension, field, shown`` rows, gaps filled."""
    shown = []
    for part in OVERLAP_RESPONSE.fields:
        if not isinstance(part.dataType, T.StructType):
            continue
        for f in part.dataType.fields:
            value = F.col(f"{document}.{part.name}.{f.name}")
            text = or_placeholder(value, isinstance(f.dataType, T.ArrayType))
            shown.append((part.name, f.name, text))
    shown.append(("document", "confidence_level", F.col(f"{document}.confidence_level")))
    shown.append(("document", "sources", or_placeholder(F.col(f"{document}.sources"), True, NO_SOURCES)))
    rows = [
        F.struct(F.lit(d).alias("dimension"), F.lit(f).alias("field"), text.alias("shown")) for d, f, text in shown
    ]
    return documents.select(*keys, F.inline(F.array(*rows)))
