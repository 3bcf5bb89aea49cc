"""Files, the vector table, inference, and ingest across restarts."""

import json
import time
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kinmatch.catalog import fixtures as X
from kinmatch.functions.embed import embed_text
from kinmatch.operators.inference import infer
from kinmatch.plans import enrich as E
from kinmatch.plans.prune import recent_valid
from kinmatch.session import durable, shared_folder, stored_tables
from kinmatch.sources import crm as C
from kinmatch.sources import vectors as VS
from kinmatch.streaming.ingest import ingest_pages


def records(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, seq int, embedding array<float>")
    return df.select(
        "doc_id", F.split("doc_id", "_")[0].alias("company_id"), F.split("doc_id", "_")[1].alias("field_name"),
        F.col("seq").cast("string").alias("text_content"), F.lit("u").alias("source_url"), "embedding", "seq",
    )


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert VS.read_vectors(spark, path).count() == 0
    VS.insert_if_absent(records(spark, [("a_icp", 2, [1.0]), ("a_icp", 1, [2.0]), ("b_icp", 3, [])]), path, "seq")
    VS.insert_if_absent(records(spark, [("a_icp", 0, [9.0]), ("c_job", 4, [3.0])]), path, "seq")
    got = {(r.doc_id, r.text_content) for r in VS.read_vectors(spark, path).collect()}
    assert got == {("a_icp", "1"), ("c_job", "4")}
    VS.recreate(records(spark, [("z_icp", 1, [1.0])]), path)
    assert [r.doc_id for r in VS.read_vectors(spark, path).collect()] == ["z_icp"]


def test_field_scan_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "vectors")
    VS.recreate(records(spark, [("a_icp", 1, [1.0]), ("a_job", 2, [2.0])]), path)
    rows = VS.scan_field(VS.read_vectors(spark, path), "icp")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field_name" in plan and rows.count() == 1


def test_query_profile_file(spark, tmp_path):
    path = tmp_path / "profile.json"
    path.write_text(json.dumps({"icp": [0.5, 1.0], "job_to_be_done": [2]}, indent=1))
    rows = {r.field_name: r.embedding for r in VS.read_query_profile(spark, str(path), "q").collect()}
    assert rows == {"icp": [0.5, 1.0], "job_to_be_done": [2.0]}


def test_crm_file(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text('Website,Name,Date Added,Extra\na.com,"X, ""Y"" Z",2024-01-02,1\n,N/A,2024-01-03,2\n" b.com ",Q,2024-01-04,3\n')
    rows = C.read_crm(spark, str(path), na_tokens=C.NA_TOKENS)
    assert [(r.Website, r.Name, r.Sector) for r in rows.orderBy("Date Added").collect()] == [
        ("a.com", 'X, "Y" Z', None), (None, None, None), (" b.com ", "Q", None),
    ]
    assert [r.Name for r in recent_valid(rows, 1).collect()] == ["Q"]
    with pytest.raises(ValueError, match="Domain"):
        C.read_crm(spark, str(path), required=["Domain"])


def test_crm_rows_stay_whole(spark, tmp_path):
    path = tmp_path / "crm.csv"
    path.write_text('Name,Website\n"B\nB2",b.com\n"C ""x"",\n\ny",c.com\n')
    rows = C.read_crm(spark, str(path)).collect()
    assert {(r.Name, r.Website) for r in rows} == {("B\nB2", "b.com"), ('C "x",\n\ny', "c.com")}


def test_crm_files_of_another_column_order_are_an_error(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Name,Website\nA,a.com\n")
    (tmp_path / "2.csv").write_text("Website,Name\nb.com,B\n")
    with pytest.raises(Exception, match="(?i)header"):
        C.read_crm(spark, str(tmp_path)).collect()


def counting(folder):
    """A model that leaves a line in a file of its own for every text it is asked."""

    def model():
        def ask(texts):
            for t in texts:
                (folder / uuid.uuid4().hex).write_text(str(t))
            return [f"v{len(t)}" for t in texts]

        return ask

    return model


def test_models_are_asked_once(spark, tmp_path):
    asked, path = tmp_path / "asked", str(tmp_path / "vectors")
    asked.mkdir()
    texts = records(spark, [(f"c{i}_icp", i, [0.0]) for i in range(20)]).drop("embedding").repartition(3)
    answered = texts.withColumn("text_content", infer(F.col("text_content"), counting(asked)))
    for calls in (20, 40):
        VS.insert_texts_if_absent(answered, E.with_embedding, path, "seq")
        assert len(list(asked.iterdir())) == calls and VS.read_vectors(spark, path).count() == 20
    embedded = tmp_path / "embedded"
    embedded.mkdir()

    def embed(rows):
        return rows.withColumn("embedding", F.array(F.length(infer(F.col("text_content"), counting(embedded))).cast("float")))

    more = texts.unionByName(records(spark, [("new_icp", 30, [0.0])]).drop("embedding"))
    for _ in range(2):
        VS.insert_texts_if_absent(more, embed, path, "seq")
    assert len(list(embedded.iterdir())) == 1 and VS.read_vectors(spark, path).count() == 21


def test_inference_survives_bad_texts(spark):
    def model():
        def ask(texts):
            if "bad" in texts:
                raise RuntimeError
            return [t.upper() for t in texts]

        return ask

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("b",)], "t string").coalesce(1)
    got = {r.t: r.v for r in rows.select("t", infer(F.col("t"), model).alias("v")).collect()}
    assert got == {"a": "A", "bad": None, None: None, "b": "B"}


def test_embedding(spark):
    rows = spark.createDataFrame([("Red red BLUE ",), ("  ",), (None,)], "t string")
    vectors = [r.v for r in rows.select(embed_text(F.col("t")).alias("v")).collect()]
    assert vectors[1:] == [None, None]
    filled = sorted(x for x in vectors[0] if x)
    assert len(vectors[0]) == 64 and [round(x, 4) for x in filled] == [0.4472, 0.8944]


def test_quota_counts_successes_only(spark):
    crm = spark.createDataFrame([(0, ""), (1, "gone.com"), (2, "a.com"), (3, "bad.com"), (4, "a.com"), (5, "b.com"), (6, "c.com")], "row_no int, website string")
    pages = spark.createDataFrame([("https://a.com", "x"), ("https://bad.com", "y"), ("https://b.com", "z"), ("https://c.com", "w"), ("https://gone.com", "")], "url string, content string")
    answer = F.when(F.col("company_id").contains("bad"), "junk").otherwise('{"icp": "i", "customer_list": ["p", "", "q"]}')
    rows = E.enrich(crm, pages, lambda df: df.withColumn("response", answer), quota=2)
    got = sorted((r.doc_id, r.text_content) for r in rows.collect())
    assert got == [
        ("https://a.com_customer_list", "p, q"), ("https://a.com_icp", "i"),
        ("https://b.com_customer_list", "p, q"), ("https://b.com_icp", "i"),
    ]


def test_ingest_across_restarts(spark, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("pages", "vectors", "progress"))
    page = "<html lang='en'><body><h1>{0}</h1><nav><a href='/x'>{0}</a></nav></body></html>"

    def add(numbers, shift=0):
        rows = [(n + shift, f"https://p{n}.com", page.format(f"P{n}")) for n in numbers]
        spark.createDataFrame(rows, "page_id bigint, url string, html string").write.mode("append").parquet(source)

    def run():
        ingest_pages(spark, source, table, progress, X.with_answer)
        return {r.doc_id for r in VS.read_vectors(spark, table).collect()}, VS.read_vectors(spark, table).count()

    add([1, 2])
    first, n = run()
    assert n == len(first) > 0 and all("p1.com" in d or "p2.com" in d for d in first)
    add([2, 3], shift=100)
    second, m = run()
    assert first < second and m == len(second) and any("p3.com" in d for d in second)
    assert run() == (second, m)


@pytest.mark.parametrize("files", [1, 2, 1000])
def test_ingest_does_not_depend_on_the_batch(spark, tmp_path, files):
    source, table, progress = (str(tmp_path / n) for n in ("pages", "vectors", "progress"))
    answers = ['{"icp": "first", "customer_list": []}', '{"icp": "second", "product_form": "p"}', '{"product_form": "late", "industry_vertical": "i"}']
    for n, answer in enumerate(answers):
        rows = spark.createDataFrame([(9 - n, "https://a.com", f"<p>{answer}</p>")], "page_id bigint, url string, html string")
        rows.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)

    def respond(rows):
        return rows.withColumn("response", F.col("content"))

    ingest_pages(spark, source, table, progress, respond, files_per_batch=files)
    got = {(r.field_name, r.text_content) for r in VS.read_vectors(spark, table).collect()}
    assert got == {("icp", "first"), ("product_form", "p"), ("industry_vertical", "i")}


def test_stored_tables_are_deleted(spark):
    import os

    with stored_tables(spark):
        path = f"{shared_folder(spark)}/t"
        assert durable(spark.range(3), path).count() == 3 and os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))
    kept = f"{shared_folder(spark)}/t"
    assert durable(spark.range(3), kept).count() == 3 and os.path.exists(kept)


def test_where_stored_tables_go():
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key.replace(".", "_"), default)))

    both = {"spark_checkpoint_dir": "hdfs:///c/", "spark_sql_warehouse_dir": "hdfs:///w/"}
    assert shared_folder(session(**both)).startswith("hdfs:///c/kinmatch/")
    assert shared_folder(session(spark_sql_warehouse_dir="hdfs:///w/")).startswith("hdfs:///w/checkpoints/kinmatch/")


def test_durable_keeps_rows(spark):
    df = durable(spark.range(10).withColumn("v", F.array(F.lit(1))))
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("v", "array<int>")]


def test_long_texts_are_asked_in_short_lists(spark, tmp_path):
    """A task holds the answers to one list, whatever the size of the Arrow batch."""
    folder = str(tmp_path)

    def model():
        import uuid

        def ask(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(texts)} {sum(map(len, texts))}")
            return [t[:10] for t in texts]

        return ask

    text = F.when(F.col("id") % 7 != 0, F.concat(F.lpad(F.col("id").cast("string"), 10, "0"), F.repeat(F.lit("x"), 20_000)))
    rows = spark.range(400).coalesce(1).withColumn("t", text)
    got = {r.id: r.v for r in rows.select("id", infer(F.col("t"), model).alias("v")).collect()}
    assert got == {i: f"{i:010d}" if i % 7 else None for i in range(400)}
    sizes = [[int(n) for n in f.read_text().split()] for f in tmp_path.iterdir()]
    assert sum(n for n, _ in sizes) == 342 and max(chars for _, chars in sizes) <= 1_000_000
