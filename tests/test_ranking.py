"""Ranking on skewed groups, numbering, and write-order rules."""

import random

from pyspark.sql import functions as F

from kinmatch.operators import ranking as R
from kinmatch.operators.joins import except_known


def test_top_k_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 20)}", rng.randint(0, 50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    for k in (1, 10, 1500):
        got = R.top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], k).collect()
        wanted = set()
        for g in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
            wanted |= {(*r, n) for n, r in enumerate(best, 1)}
        assert {tuple(r) for r in got} == wanted


def test_numbered(spark):
    values = random.Random(5).sample(range(100_000), 3000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r["rank"] for r in R.numbered(df, [F.desc("v")]).collect()}
    assert got == {v: n for n, v in enumerate(sorted(values, reverse=True), 1)}


def test_first_and_last_write(spark):
    rows = [("k", i) for i in range(500)] + [("x", 7)]
    df = spark.createDataFrame(rows, "key string, seq int").repartition(4)
    assert {tuple(r) for r in R.first_write(df, ["key"], "seq").collect()} == {("k", 0), ("x", 7)}
    assert {tuple(r) for r in R.last_write(df, ["key"], "seq").collect()} == {("k", 499), ("x", 7)}


def test_except_known(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, v int")
    known = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert sorted(r.v for r in except_known(batch, known, "id").collect()) == [3, 4]
