"""Ledgers of ids and answers, and answers that stop at a quota."""

import pytest
from pyspark.sql import functions as F
from test_store import records

from kinmatch.operators.answers import ask_once, failures
from kinmatch.operators.inference import infer
from kinmatch.plans import enrich as E
from kinmatch.sources import ledger
from kinmatch.sources import vectors as VS


def ids(spark, path):
    return sorted(r.doc_id for r in VS.read_vectors(spark, path).collect())


def test_a_small_insert_reads_its_buckets(spark, tmp_path):
    path = str(tmp_path / "vectors")
    VS.insert_if_absent(records(spark, [(f"c{i}_icp", i, [1.0]) for i in range(300)]), path, "seq")
    batch = spark.createDataFrame([("c1_icp",), ("c2_icp",), ("new_icp",)], "id string")
    part = ledger.known(batch, path)
    assert "PartitionFilters: [bucket" in part._jdf.queryExecution().executedPlan().toString()
    read = {r.f.split("bucket=")[1].split("/")[0] for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(read) <= 3
    assert [r.id for r in ledger.absent(batch, path, "id").collect()] == ["new_icp"]
    VS.insert_if_absent(records(spark, [("c1_icp", 0, [2.0]), ("new_icp", 1, [2.0])]), path, "seq")
    assert ids(spark, path) == sorted([*(f"c{i}_icp" for i in range(300)), "new_icp"])


@pytest.mark.parametrize("stop", ["before the rows", "before the ids", "amid the ids"])
def test_an_insert_that_ended_in_between(spark, tmp_path, stop):
    path = str(tmp_path / "vectors")
    VS.insert_if_absent(records(spark, [("a_icp", 1, [1.0])]), path, "seq")
    rows = records(spark, [("b_icp", 2, [2.0]), ("c_icp", 3, [3.0])])
    ledger.begin(rows.select(F.col("doc_id").alias("id")), path)
    if stop != "before the rows":
        VS._write(rows, path, "append")
    if stop == "amid the ids":
        ledger._add(rows.filter("doc_id = 'b_icp'").select(F.col("doc_id").alias("id")), path)
    for _ in range(2):
        VS.insert_if_absent(rows, path, "seq")
    assert ids(spark, path) == ["a_icp", "b_icp", "c_icp"]


def test_tables_without_a_ledger_and_replaced_ones(spark, tmp_path):
    path = str(tmp_path / "vectors")
    VS._write(records(spark, [("a_icp", 1, [1.0])]), path, "append")
    VS.insert_if_absent(records(spark, [("a_icp", 2, [2.0]), ("b_icp", 2, [2.0])]), path, "seq")
    assert ids(spark, path) == ["a_icp", "b_icp"]
    VS.recreate(records(spark, [("z_icp", 1, [1.0])]), path)
    VS.insert_if_absent(records(spark, [("a_icp", 2, [2.0]), ("z_icp", 2, [2.0])]), path, "seq")
    assert ids(spark, path) == ["a_icp", "z_icp"]


def counting(folder):
    """A model that leaves a file for each text it is asked about, and fails on those that begin with an x."""

    def model():
        import uuid
        from pathlib import Path

        def ask(texts):
            if any(t.startswith("x") for t in texts):
                raise ValueError("no")
            for t in texts:
                Path(folder, f"{t}-{uuid.uuid4().hex}").touch()
            return [t.upper() for t in texts]

        return ask

    return lambda text: infer(text, model)


def asked(folder):
    return sorted(p.name.split("-")[0] for p in folder.iterdir())


def test_answers_are_asked_for_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    ask, path = counting(str(tmp_path / "calls")), str(tmp_path / "ledger")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "x"), (6, "")], "n int, p string").repartition(3)
    for _ in range(2):
        got = {r.n: r.answer for r in ask_once(rows, "p", ask, path, "m").collect()}
        assert got == {1: "A", 2: "A", 3: "B", 4: None, 5: None, 6: ""}
    assert asked(tmp_path / "calls") == ["", "a", "b"]
    assert [r.prompt for r in failures(spark, path).collect()] == ["x", "x"]
    more = spark.createDataFrame([(7, "c"), (8, "b")], "n int, p string")
    assert {r.answer for r in ask_once(more, "p", ask, path, "m").collect()} == {"B", "C"}
    assert {r.answer for r in ask_once(more, "p", ask, path, "other").collect()} == {"B", "C"}
    assert asked(tmp_path / "calls") == ["", "a", "b", "b", "c", "c"]
    assert ask_once(rows.limit(0), "p", ask, path, "m").count() == 0


def test_known_prompts_are_not_written_again(spark, tmp_path):
    import os
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))

    def written():
        return sum(p.stat().st_size for p in folder.rglob("*.parquet"))

    prompts = [(n, os.urandom(10_000).hex()) for n in range(100)]
    rows = spark.createDataFrame(prompts, "n int, p string")
    path, sizes = str(tmp_path / "ledger"), [written()]
    for _ in range(2):
        got = ask_once(rows, "p", lambda text: infer(text, lambda: lambda texts: [t[:9] for t in texts]), path, "m")
        sizes.append(written())
        assert {r.n: r.answer for r in got.collect()} == {n: p[:9] for n, p in prompts}
    # 2 MB of prompts, answered the first time and known the second.
    assert sizes[1] - sizes[0] < 200_000 and sizes[2] - sizes[1] < 100_000


def test_few_more_than_the_quota_are_asked(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    ask = counting(str(tmp_path / "calls"))
    rows = spark.range(2000).select(F.col("id").alias("row_no"), F.format_string("c%04d", "id").alias("company_id"))
    # Two of three texts fail.
    rows = rows.withColumn("text", F.when(F.col("row_no") % 3 == 1, F.col("company_id")).otherwise(F.concat(F.lit("x"), "company_id")))

    def answer(batch):
        return batch.withColumn("answer", ask(F.col("text"))).filter("answer IS NOT NULL")

    got = E.first_answered(rows, answer, 10).orderBy("row_no").collect()
    assert [r.row_no for r in got] == [3 * i + 1 for i in range(10)]
    assert len(asked(tmp_path / "calls")) <= 20
    few = E.first_answered(rows.filter("row_no < 5"), answer, 10).collect()
    assert sorted(r.row_no for r in few) == [1, 4]
    assert E.first_answered(rows.limit(0), answer, 10).count() == 0
