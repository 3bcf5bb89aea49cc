"""Lookups by company read few row groups of the stored table."""

import pytest
from pyspark.sql import functions as F

from kinmatch.functions.text import document_id
from kinmatch.sources import vectors as VS

N = 4_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups") / "vectors")
    company = F.format_string("c%06d", (F.col("id") * 7919 % N).cast("int"))
    rows = spark.range(N).select(
        company.alias("company_id"), F.lit("icp").alias("field_name"), F.lit("t").alias("text_content"), F.lit("u").alias("source_url"),
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(1).cast("float")).alias("embedding"),
    ).withColumn("doc_id", document_id(F.col("company_id"), F.col("field_name")))
    for f in VS.FIELD_VECTOR.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    # Small row groups stand for large files.
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 * 1024))
    try:
        VS.recreate(rows, path)
    finally:
        conf.unset("parquet.block.size")
    return VS.read_vectors(spark, path)


def rows_read(df) -> int:
    """Rows that the scan of a query without a shuffle handed on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_one_company(stored):
    found = VS.scan_company(stored, "c000013")
    assert rows_read(found) < N // 4
    assert [(r.company_id, r.field_name) for r in found.collect()] == [("c000013", "icp")]
    assert rows_read(VS.scan_company(stored, "c000013x")) < N // 4


def test_short_and_long_lists(spark, stored):
    wanted = [f"c{i:06d}" for i in (5, 9, 3000)] + ["nobody", None, "c000005"]
    found = VS.scan_companies(stored, spark.createDataFrame([(i,) for i in wanted], "company_id string"))
    assert rows_read(found) < N // 2
    assert sorted(r.company_id for r in found.collect()) == ["c000005", "c000009", "c003000"]
    for n in (0, VS.PUSHED, VS.PUSHED + 1, N):
        ids = spark.range(n).select(F.format_string("c%06d", F.col("id").cast("int")).alias("company_id"))
        got = VS.scan_companies(stored, ids)
        assert got.count() == n and got.columns == stored.columns
