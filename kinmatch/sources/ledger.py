"""Ids that a table holds, in buckets, so that an insert reads only the buckets of its batch.

The ledger of a table lies beside it: ids by ``pmod(xxhash64(id), BUCKETS)`` as a partition column.  An insert names its ids in
an intent first, writes the rows, then adds the ids and drops the intent.  An intent that is still
there belongs to an insert that ended in between: of its ids, those that the table holds are added before the
next insert compares.  A table without a ledger, or one that was replaced, gets it by one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinmatch.operators.joins import except_known

BUCKETS = 64
SCHEMA = "id string, bucket int"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _ids(path: str) -> str:
    return f"{path}_ids/{BUCKETS}"


def _intent(path: str) -> str:
    return f"{path}_ids/intent"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _add(ids: DataFrame, path: str) -> None:
    """Add a column ``id``; the ids of a bucket come from one task, or several if they are many."""
    rows = ids.select("id", bucket(F.col("id")).alias("bucket"))
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(_ids(path))


def forget(spark: SparkSession, path: str) -> None:
    """Drop the ledger of a table that is replaced; the next insert makes a new one."""
    _delete(spark, f"{path}_ids")


def ready(stored: DataFrame, path: str, key: str) -> None:
    """Make the ledger agree with ``stored``, the table at ``path``, whatever ended before it was done."""
    spark = stored.sparkSession
    if _there(spark, _ids(path), SCHEMA) is None:
        held = stored.select(F.col(key).alias("id")).distinct()
        _add(held, path)
        # Also where the table holds nothing yet.
        folder = spark._jvm.org.apache.hadoop.fs.Path(_ids(path))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        _delete(spark, _intent(path))
        return
    left = _there(spark, _intent(path), "id string")
    if left is not None:
        # Few ids go to the scan of the table, or the other way round.
        written = stored.select(F.col(key).alias("id")).join(left, "id", "left_semi").distinct()
        _add(except_known(written, known(written, path), "id"), path)
        _delete(spark, _intent(path))


def known(ids: DataFrame, path: str) -> DataFrame:
    """The part of the ledger that can hold the ids of the column ``id``: whole buckets, by a partition filter."""
    spark = ids.sparkSession
    wanted = [r["bucket"] for r in ids.select(bucket(F.col("id")).alias("bucket")).distinct().collect()]  # at most BUCKETS
    return spark.read.schema(SCHEMA).parquet(_ids(path)).filter(F.col("bucket").isin(wanted)).select("id")


def absent(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key the ledger does not have."""
    held = known(rows.select(F.col(key).alias("id")), path)
    return except_known(rows, held.withColumnRenamed("id", key), key)


def begin(ids: DataFrame, path: str) -> None:
    """Name the ids (column ``id``) that are about to be written."""
    ids.select("id").write.mode("overwrite").parquet(_intent(path))


def commit(spark: SparkSession, path: str) -> None:
    """Add the named ids, which are written now."""
    _add(spark.read.schema("id string").parquet(_intent(path)), path)
    _delete(spark, _intent(path))
