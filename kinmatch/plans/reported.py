"""Company search that reports the candidates it cannot score.

A candidate whose vector cannot be compared does not score 0 among the others, nor end the
job: it is left out and listed with the field and the reason.  Both outputs come from one
stored pass over the vectors, split by whether a company has a fault.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import vectors as V
from kinmatch.operators import similarity as S
from kinmatch.plans.search import search_exact
from kinmatch.schemas import FIELD_WEIGHTS, TOP_N
from kinmatch.session import durable

#: Reasons of a failure.
NO_VALUES, NOT_FINITE, OTHER_LENGTH = "no values", "a value is null or not finite", "length differs from the query's"


@dataclass
class Candidates:
    """``sound`` are profiles (company_id, fields); ``failures`` are company_id, stage, field_name, reason."""

    sound: DataFrame
    failures: DataFrame


def _reason(vector: Column, lengths: Column) -> Column:
    """Why a vector cannot be compared with query vectors of the given lengths, or null."""
    return (
        F.when(F.size(vector) == 0, NO_VALUES)
        .when(~V.is_finite(vector), NOT_FINITE)
        .when(~F.array_contains(lengths, F.size(vector)), OTHER_LENGTH)
    )


def candidates(
    vectors: DataFrame, query: DataFrame, weights: Mapping[str, float] = FIELD_WEIGHTS, stage: str = "score"
) -> Candidates:
    """The companies that can be scored for the queries, and a row for every field that stops another.

    Only fields that a query asks for count, and of several vectors of a field the last.  A company
    without such a field is sound, one without any vector is no candidate.  Rows without company or field are left out.
    """
    asked = S.weighted_fields(query, weights).groupBy("field_name").agg(F.collect_set(F.size("embedding")).alias("lengths"))
    lengths = {r["field_name"]: r["lengths"] for r in asked.collect()}  # a row per weighted field
    filled = vectors.withColumn("embedding", F.coalesce("embedding", F.array().cast(vectors.schema["embedding"].dataType)))
    last = F.filter(
        "fields",
        lambda v, i: F.coalesce(F.get("fields", i + 1)["field_name"] != v["field_name"], F.lit(True)),
    )
    rows = S.profiles(filled).withColumn("fields", last)

    def fault(v: Column) -> Column:
        reason = F.lit(None).cast("string")
        for name, sizes in lengths.items():
            reason = F.when(v["field_name"] == name, _reason(v["embedding"], F.array(*[F.lit(n) for n in sizes]))).otherwise(reason)
        return F.struct(v["field_name"].alias("field_name"), reason.alias("reason"))

    faults = F.filter(F.transform("fields", fault), lambda f: f["reason"].isNotNull())
    checked = durable(rows.withColumn("faults", faults))
    return Candidates(
        checked.filter((F.size("faults") == 0) & F.exists("fields", lambda v: F.size(v["embedding"]) > 0)).select("company_id", "fields"),
        checked.select("company_id", F.lit(stage).alias("stage"), F.inline("faults")),
    )


def search_reported(
    vectors: DataFrame,
    query: DataFrame,
    n: int = TOP_N,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
    exclude_self: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best sound companies per query, and the failures of the rest."""
    found = candidates(vectors, query, weights)
    return search_exact(found.sound, query, n, weights, exclude_self), found.failures
