"""Incremental ingest of captured pages into the vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.urls import is_blank, with_scheme
from kinmatch.plans.enrich import field_texts, profiles, with_embedding
from kinmatch.sources.captures import successful, with_content
from kinmatch.sources.vectors import insert_texts_if_absent

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def ingest_pages(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    respond: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame], DataFrame] = with_embedding,
    schema: T.StructType = PAGES,
    glob: str = "*.parquet",
    seq: str = "page_id",
    files_per_batch: int = 1000,
) -> None:
    """Load the page files that arrived since the last run, then stop.

    Each micro-batch is compared with the buckets of the table's ledger that its ids fall in, so it reads
    no more of the stored ids, and a batch that is repeated after a crash adds nothing twice.  The
    result does not depend on ``files_per_batch``.
    """
    pages = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .withColumn("_arrival", F.struct("_metadata.file_modification_time", "_metadata.file_path", seq))
    )

    def load(batch: DataFrame, _epoch: int) -> None:
        named = batch.filter(~is_blank(F.col("url"))).withColumn("company_id", with_scheme(F.col("url")))
        valid = profiles(successful(with_content(named)), respond)
        # Of each record the first page with a text counts, in the order in which files arrive.
        insert_texts_if_absent(field_texts(valid, "_arrival"), embed, table, "_arrival")

    stream = (
        pages.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
