"""Answers of a model, kept by the digest of model and prompt, so that each is asked for once.

The ledger is a folder: ``answers`` by the first two digits of the digest, and ``failures``, a row for each
prompt and run that got none.  Equal prompts of a batch, a batch that is repeated and later runs read the
stored answer; failed prompts are asked again.  Only new answers are written, before they
are used, so a run that ends in between has lost no answer that was stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinmatch.operators.joins import except_known
from kinmatch.session import durable

ANSWERS = "digest string, answer string, part string"
FAILURES = "digest string, prompt string, model string, asked_at timestamp"


def digest(model: str, prompt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\0"), prompt).cast("binary"), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def failures(spark: SparkSession, path: str) -> DataFrame:
    """Prompts that got no answer, by run."""
    return _read(spark, f"{path}/failures", FAILURES)


def ask_once(
    rows: DataFrame, prompt: str, ask: Callable[[Column], Column], path: str, model: str, name: str = "answer"
) -> DataFrame:
    """``rows`` with the answer to each ``prompt``, null where it is null or the model fails.

    ``ask`` makes the model's column of a text column, such as ``inference.infer``.
    """
    spark = rows.sparkSession
    key = digest(model, F.col(prompt))
    asking = rows.filter(F.col(prompt).isNotNull()).select(key.alias("digest"), F.col(prompt).alias("prompt"))
    wanted = durable(asking.select("digest").distinct())
    parts = [r["part"] for r in wanted.select(F.substring("digest", 1, 2).alias("part")).distinct().collect()]  # at most 256

    def stored() -> DataFrame:
        return _read(spark, f"{path}/answers", ANSWERS).filter(F.col("part").isin(parts)).select("digest", "answer")

    # Digests are compared alone. Only prompts without an answer travel, and a stored list of few sends none.
    new = durable(except_known(wanted, stored(), "digest"))
    once = asking.join(new, "digest", "left_semi").groupBy("digest").agg(F.first("prompt").alias("prompt"))
    answered = once.select("digest", "prompt", ask(F.col("prompt")).alias("answer"))
    asked = durable(answered.select("digest", F.when(F.col("answer").isNull(), F.col("prompt")).alias("prompt"), "answer"))
    got = asked.filter("answer IS NOT NULL").select("digest", "answer", F.substring("digest", 1, 2).alias("part"))
    got.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{path}/answers")
    missed = asked.filter("answer IS NULL").select("digest", "prompt", F.lit(model).alias("model"), F.current_timestamp().alias("asked_at"))
    missed.write.mode("append").parquet(f"{path}/failures")
    found = stored().dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), F.col("answer").alias(name))
    return rows.withColumn("_key", key).join(found, F.col("_key") == F.col("_digest"), "left").drop("_key", "_digest")
