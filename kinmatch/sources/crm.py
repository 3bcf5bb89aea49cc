"""CRM export files: CSV with a header, everything read as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.schemas import CRM_SCHEMA

# Texts a data-frame CSV reader takes for missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; reads the first line only."""
    return spark.read.option("header", True).option("multiLine", True).csv(path).columns


def read_crm(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CRM_SCHEMA,
    required: Sequence[str] = ("Website",),
    na_tokens: Sequence[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """Read an export by column name; a missing required column is an error.

    Empty cells, and columns the file lacks, come back null.  ``na_tokens`` (for instance
    ``NA_TOKENS``) are texts to read as null.  Quoted values may hold line breaks; without
    ``multi_line`` they may not, and large files are then split.  In a folder, every file
    must have the columns of the first in the same order; another header is an error
    rather than read by position.
    """
    present = header(spark, path)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"column {missing[0]!r} is not in the header {present}")
    in_file = T.StructType([T.StructField(c, T.StringType()) for c in present])
    rows = (
        spark.read.schema(in_file)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    names = [f.name for f in schema.fields]
    cleaned = []
    for name in names:
        value = F.nullif(F.col(f"`{name}`"), F.lit("")) if name in present else F.lit(None).cast("string")
        if na_tokens and name in present:
            value = F.when(~value.isin(*na_tokens), value)
        cleaned.append(value.alias(name))
    return rows.select(*cleaned)


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Write rows with a header and their values untouched.

    One file per task by default; ``single_file`` gathers the rows in one task and
    suits a report of bounded size.
    """
    out = df.coalesce(1) if single_file else df
    (
        out.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
