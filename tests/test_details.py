"""Ids of any length, tables of mixed types, and wide flat tables."""

import json

from pyspark.sql import functions as F

from kinmatch.operators import details as D


def test_ids_are_compared_as_digits(spark):
    long, longer = "1" * 20, "7" * 30
    asked = [" 007 ", "+12", "1_000", long, "-0", longer, "404"]
    batched = spark.createDataFrame([(v, i, 0) for i, v in enumerate(asked)], "id string, position long, batch long")
    known = [("7", "a"), ("12", "b"), ("1000", "c"), (long, "d"), ("0", "e"), (longer, "f"), ("8", "g"), (None, "h")]
    details = spark.createDataFrame([(i, f"urn:{n}", n) for i, n in known], "id string, urn string, name string")
    got = {r.position: r.name for r in D.detail_lookup(batched, details).collect()}
    assert got == dict(enumerate("abcdef"))
    assert D.batch_kinds(batched).first().kind == "ids"


def test_union_fills_every_gap(spark):
    a = spark.createDataFrame([(1, 2.5, None)], "i int, d double, s string")
    b = spark.createDataFrame([("x", True)], "s string, b boolean")
    rows = D.union_by_name([a, b])
    assert rows.columns == ["b", "d", "i", "s"]
    assert {tuple(r) for r in rows.collect()} == {("", "2.5", "1", ""), ("true", "", "", "x")}


def test_flat_table_has_a_column_for_every_key(spark):
    records = spark.createDataFrame([(json.dumps({f"k{i}": i}),) for i in range(300)], "json string")
    table = D.flat_table(records)
    assert len(table.columns) == 300
    assert table.filter(F.col("k7") == "7").count() == 1
