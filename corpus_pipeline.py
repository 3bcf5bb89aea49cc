"""The corpus pipeline: five stages over ``documents``, each a table that the next one reads.

In order: toxic documents go; documents that break a quality rule go; one document of
each group of near copies stays; sources are mixed to their target weights by Poisson
replication; the texts become token ids, each copy of a document as its own row.

Each stage is defined for nulls in any column, empty and very long texts, ties and
repeated rows, empty tables and extra columns as its operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import bpe_dropout, mixing, quality_rules, simhash, toxicity
from kinmatch.session import durable

#: Column between the last two stages: the number of a document's copy.
COPY = "mixing_copy"


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the chain learns from the documents at hand and ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.keep_good(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at two or fewer bits."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's rate, in a global random order, their copies numbered."""
    return mixing.numbered_mix(docs, COPY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, each copy of a document with dropout of its own."""
    return bpe_dropout.tokens(docs, copy=COPY)


STAGES = [
    ("toxicity", not_toxic),
    ("quality_rules", good),
    ("near_duplicates", different),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The toxicity chain is trained, and SQL has neither that nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result but the last is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else durable(docs)
    return docs
