"""The pipeline's stages against a plain version of each, on a table with planted cases."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_llm_native import draw, measured, poisson
from test_llm_search import closure, slow_fingerprint

import corpus_pipeline
from kinmatch.llm import bpe_dropout, mixing, toxicity


def passes_rules(text):
    m = measured(text)
    lines = [x for x in (text or "").split("\n") if x.split()]
    upper = sum("A" <= c <= "Z" for c in text or "")
    return not (
        m["base_failed"]
        or 10 * m["n_symbols"] > m["n_words"]
        or 2 * m["n_dup_lines"] > len(lines)
        or not 2 * m["n_words"] <= m["word_chars"] <= 15 * m["n_words"]
        or 2 * upper > m["word_chars"]
    )


def planted(spark, sf_dir, folder):
    """The small test documents, and rows without text, id or source, repeated rows and an extra column."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.filter(F.length("text") > 500).orderBy("doc_id").limit(3)
    odd = [
        some,
        some.withColumn("doc_id", F.col("doc_id") + 1_000_000),
        some.withColumn("doc_id", F.lit(None).cast("long")),
        some.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 2_000_000),
        some.withColumn("source", F.lit(None).cast("string")).withColumn("text", F.concat("text", F.lit(" and one"))).withColumn("doc_id", F.col("doc_id") + 3_000_000),
    ]
    for rows in odd:
        docs = docs.unionByName(rows)
    docs.withColumn("ledger", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_do_what_they_say(spark, tmp_path):
    sf_dir = planted(spark, "/root/testdata/sf0.001", tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "near_duplicates", "mixing", "encoding"]

    def after(name, docs):
        path = f"{tmp_path}/{name}"
        stages[name](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    def rows(df):
        return Counter((r.doc_id, r.text, r.source) for r in df.collect())

    chain = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before = rows(docs)
    texts = list(before)
    toxic = chain.probabilities([t for _, t, _ in texts])[:, -1] >= toxicity.THRESHOLD
    wanted = Counter({k: before[k] for k, bad in zip(texts, toxic) if not bad})
    docs = after("toxicity", docs)
    assert rows(docs) == wanted and docs.columns[-1] == "ledger"

    wanted = Counter({k: n for k, n in wanted.items() if passes_rules(k[1])})
    docs = after("quality_rules", docs)
    assert rows(docs) == wanted

    # Rows without an id take part under numbers above all ids, one for each text.
    prints = {}
    for i, text, _ in wanted:
        prints[10**9 + zlib.crc32((text or "").encode()) if i is None else i] = slow_fingerprint(text)
    group = closure(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    wanted = Counter({k: 1 for k in wanted if k[0] is not None and group[k[0]] == k[0]})
    docs = after("near_duplicates", docs)
    assert rows(docs) == wanted and wanted.total() < len(before)

    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    wanted = Counter({k: n * poisson(rates[k[2]], draw(mixing.SEED, k[0], 1)) for k, n in wanted.items()})
    docs = after("mixing", docs)
    assert rows(docs) == +wanted

    pieces = bpe_dropout.Pieces.load()
    got = after("encoding", docs).collect()
    assert sorted((pieces.decode(r.ids), r.source or "") for r in got) == sorted((t, s or "") for _, t, s in wanted.elements())
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_run_gives_the_rows_of_the_stages(spark, tmp_path):
    sf_dir = planted(spark, "/root/testdata/sf0.001", tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert np.isfinite(sum(r.n_tokens for r in got))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
