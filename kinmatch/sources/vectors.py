"""The vector table: Parquet, one row per (company, field), partitioned by field."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinmatch.functions.text import document_id
from kinmatch.operators.ranking import batch_number, first_write
from kinmatch.operators.similarity import usable_vectors
from kinmatch.schemas import FIELD_VECTOR, LOAD_BATCH
from kinmatch.session import durable
from kinmatch.sources import ledger


#: The longest list of companies that is sent to the scan as a condition.
PUSHED = 200


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, or an empty one when nothing is stored yet."""
    try:
        return spark.read.schema(FIELD_VECTOR).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FIELD_VECTOR)


def scan(vectors: DataFrame) -> DataFrame:
    """All usable records, ids and vectors only."""
    return usable_vectors(vectors).select("company_id", "field_name", "embedding")


def scan_field(vectors: DataFrame, name: str) -> DataFrame:
    """Records of one field; reads one partition of a stored table."""
    return vectors.filter(F.col("field_name") == name)


def scan_companies(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the companies listed in ``ids.company_id``.

    The list is stored first.  Up to ``PUSHED`` companies become a condition of the scan, which skips
    the row groups that hold none of them; a longer list is joined, and the planner, which knows its
    size, sends it to the scan instead of shuffling the vectors while it is short.
    """
    listed = durable(ids.filter("company_id IS NOT NULL").select("company_id").distinct())
    few = [r["company_id"] for r in listed.limit(PUSHED + 1).collect()]
    if len(few) > PUSHED:
        return vectors.join(listed, "company_id", "left_semi").select(*vectors.columns)
    # One equality each: of a long IN only the smallest and largest value reach the files.
    return vectors.filter(reduce(Column.__or__, [F.col("company_id") == i for i in sorted(few)], F.lit(False)))


def scan_company(vectors: DataFrame, company_id: str) -> DataFrame:
    """Everything about one company but its vectors; skips row groups as ``scan_companies`` does."""
    kept = [c for c in vectors.columns if c != "embedding"]
    return vectors.filter(F.col("company_id") == company_id).select(*kept)


def display_text(vectors: DataFrame) -> DataFrame:
    """Fill ``shown_text`` from either of the two names the text may be stored under."""
    names = [F.col(c) for c in ("field_text", "text_content") if c in vectors.columns]
    return vectors.withColumn("shown_text", F.coalesce(*names))


def _stored_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in FIELD_VECTOR.fields])


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Store records by field; the rows of a field are balanced over the writing tasks first.

    Files are sorted by company, so that a row group spans few of them, and carry a Bloom filter of
    the companies, so that readers of some companies skip most row groups.
    """
    sorted_rows = _stored_columns(rows).hint("rebalance", "field_name").sortWithinPartitions("field_name", "company_id")
    (
        sorted_rows.write.mode(mode)
        .partitionBy("field_name")
        .option("parquet.bloom.filter.enabled#company_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def recreate(rows: DataFrame, path: str) -> None:
    """Replace the table by ``rows``."""
    ledger.forget(rows.sparkSession, path)
    _write(rows, path, "overwrite")


def insert_if_absent(rows: DataFrame, path: str, seq: str) -> None:
    """Append records that have a vector and are not stored yet, the first of each id.

    Running the same rows again adds nothing.  The rows are stored once, so that
    what makes them runs once; ids alone are compared, with the buckets of the ledger that they fall in.
    """
    filled = durable(rows.filter(F.size("embedding") > 0))
    first = first_write(filled.select("doc_id", seq), ["doc_id"], seq)
    ledger.ready(read_vectors(rows.sparkSession, path), path, "doc_id")
    added = durable(ledger.absent(first, path, "doc_id"))
    _append(first_write(filled.join(added, ["doc_id", seq], "left_semi"), ["doc_id"], seq), added, path)


def insert_texts_if_absent(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, seq: str) -> None:
    """Append records that are not stored yet; only those are embedded.

    ``texts`` are records without a vector, the first text of each id counts, and
    ``embed`` adds the vector.  The model behind the texts runs once, as they are stored.
    """
    first = durable(first_write(texts, ["doc_id"], seq))
    ledger.ready(read_vectors(texts.sparkSession, path), path, "doc_id")
    added = durable(embed(ledger.absent(first, path, "doc_id")).filter(F.size("embedding") > 0))
    _append(added, added, path)


def _append(rows: DataFrame, ids: DataFrame, path: str) -> None:
    """Add rows whose ids are known to be new, and the ids to the ledger."""
    ledger.begin(ids.select(F.col("doc_id").alias("id")), path)
    _write(rows, path, "append")
    ledger.commit(rows.sparkSession, path)


def nested_to_rows(companies: DataFrame, company: str = "company_id", fields: str = "fields") -> DataFrame:
    """Companies with a map of field to ``(text, embedding)`` as long records."""
    rows = companies.select(
        *[c for c in companies.columns if c != fields], F.explode(fields).alias("field_name", "_field")
    )
    return rows.select(
        document_id(F.col(company), F.col("field_name")).alias("doc_id"),
        *[c for c in rows.columns if c != "_field"],
        F.col("_field.text").alias("field_text"),
        F.col("_field.embedding").alias("embedding"),
    )


def added_per_batch(companies: DataFrame, position: str, size: int = LOAD_BATCH, fields: str = "fields") -> DataFrame:
    """Companies and records each load batch adds."""
    sized = companies.select(batch_number(F.col(position), size).alias("batch"), F.size(fields).alias("_n"))
    return sized.groupBy("batch").agg(F.count(F.lit(1)).alias("companies"), F.sum("_n").alias("records"))


def profile_counts(vectors: DataFrame) -> DataFrame:
    return vectors.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("company_id").alias("companies"),
        F.count_distinct("field_name").alias("fields"),
    )


def write_profiles_json(query: DataFrame, path: str, keys: Sequence[str] = ("query_id",)) -> None:
    """One JSON object per line: the query id and its ``field: vector`` profile."""
    profile = query.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "embedding")))).alias("profile")
    )
    profile.write.mode("overwrite").json(path)


def read_profiles_json(spark: SparkSession, path: str, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    schema = ", ".join([f"{k} string" for k in keys] + ["profile map<string, array<float>>"])
    rows = spark.read.schema(schema).json(path)
    return rows.select(*keys, F.explode("profile").alias("field_name", "embedding"))


def read_query_profile(spark: SparkSession, path: str, query_id: str) -> DataFrame:
    """A file that is one object of ``field: vector``, as query rows."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string, array<float>>")).alias("field_name", "embedding"))
    return rows.select(F.lit(query_id).alias("query_id"), "field_name", "embedding")
