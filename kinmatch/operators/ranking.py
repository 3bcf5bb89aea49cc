"""Top-k, rank numbers, write-order deduplication and batch numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.session import durable

SPREAD = 64


def _spread(df: DataFrame, salts: int) -> Column:
    """A salt that only depends on the row, so that a lost task recomputes it."""
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return F.pmod(F.xxhash64(*plain), F.lit(salts))


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = SPREAD
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Groups may be few and huge (one per query and field).  The cut runs twice: within
    salted slices of a group, then over the survivors, so that one task gets at most
    ``salts * k`` rows of a group however many tasks there are.
    """
    whole = Window.partitionBy(*group).orderBy(*order)
    salted = df.withColumn("_salt", _spread(df, salts))
    slices = Window.partitionBy(*group, "_salt").orderBy(*order)
    kept = salted.withColumn("_slice", F.row_number().over(slices)).filter(F.col("_slice") <= k)
    ranked = kept.drop("_salt", "_slice").withColumn(rank, F.row_number().over(whole))
    return ranked.filter(F.col(rank) <= k)


def top_n(df: DataFrame, order: Sequence[Column], n: int, salts: int = SPREAD) -> DataFrame:
    """The first ``n`` rows overall.

    Every task keeps its own ``n``, groups of tasks then keep theirs, and at most
    ``salts * n`` rows meet at the end, however many tasks there are.
    """
    grouped = df.withColumn("_salt", F.spark_partition_id() % salts)
    part = Window.partitionBy("_salt").orderBy(*order)
    kept = grouped.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n).drop("_salt", "_n")
    return kept.orderBy(*order).limit(n)


def first_write(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keep the row with the lowest ``seq`` of each key.

    The filter on rank 1 makes Spark drop all but one row per key in each map
    task, so a key that holds many of the rows does not gather in one task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(seq))
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def last_write(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Keep the row with the highest ``seq`` of each key."""
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Number all rows in the given total order without gathering them in one task.

    Rows are range-partitioned and sorted, stored with the number of their range,
    and numbered inside it; each range starts where the one before it ends.  Only
    one count per range is gathered.  The ranges are stored because recomputing
    them could move their bounds.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_n", F.row_number().over(inside))
        .join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_start") + F.col("_n") - 1 + start)
        .drop("_range", "_n", "_start")
    )


def batch_number(position: Column, size: int) -> Column:
    """Batch number, from 0, of a row position."""
    return F.floor(position / size).cast("bigint")
