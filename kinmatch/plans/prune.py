"""CRM pruning: keep the most recent rows that have a usable website."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.text import format_date, parse_date
from kinmatch.functions.urls import is_valid_website
from kinmatch.operators.ranking import top_n
from kinmatch.schemas import RECENT_ROWS


def with_valid_website(rows: DataFrame, website: str = "Website") -> DataFrame:
    return rows.filter(is_valid_website(F.col(website)))


def recent_valid(
    rows: DataFrame,
    n: int = RECENT_ROWS,
    website: str = "Website",
    date: str = "Date Added",
    tie_break: str = "Affinity Row ID",
    on_error: str = "fail",
) -> DataFrame:
    """The ``n`` newest rows with a valid website; rows without a date come last."""
    dated = with_valid_website(rows, website).withColumn("_added", parse_date(F.col(date), on_error=on_error))
    return top_n(dated, [F.desc_nulls_last("_added"), F.asc(tie_break)], n).drop("_added")


def prune_profile(
    rows: DataFrame,
    n: int = RECENT_ROWS,
    website: str = "Website",
    date: str = "Date Added",
    tie_break: str = "Affinity Row ID",
    on_error: str = "fail",
) -> DataFrame:
    """One row: input, valid and output rows, column count, and the kept date range."""
    added = parse_date(F.col(date), on_error=on_error)
    kept = recent_valid(rows, n, website, date, tie_break, on_error).select(
        F.struct(
            F.count(F.lit(1)).alias("output_rows"),
            format_date(F.min(added)).alias("first_date"),
            format_date(F.max(added)).alias("last_date"),
        )
    )
    return rows.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.coalesce(F.count_if(is_valid_website(F.col(website))), F.lit(0)).alias("valid_rows"),
    ).select("*", F.lit(len(rows.columns)).alias("columns"), kept.scalar().alias("_kept")).select(
        "input_rows", "valid_rows", "columns", "_kept.*"
    )
