"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target share of the output over its
share of the input.  A document's count is the inverse Poisson distribution at a
uniform number hashed from a seed and its id, so it does not depend on partitioning
or on retries.  Documents are exploded by their count and dealt out by a second
hash, which is a global shuffle: the partition and the place in it are both hashed.

Only counts per source are aggregated, with partial sums before the shuffle, and
stored; the table of rates and cumulative probabilities has one row per source and is
broadcast by the planner only when its stored size is below its threshold.  For more
sources the join shuffles, and adaptive execution splits a hot source.

Defined results: a null source is a source of its own; for a null id the source and a digest of the
text are hashed, so such rows are drawn one by one; repeated rows have the same count; null or empty texts are replicated like
any other; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import fresh
from kinmatch.session import durable

SEED = 17
#: Target shares follow the size of a source to this power: 1 keeps them, 0 makes them equal.
TEMPERATURE = 0.7
#: Rates up to this are tabulated; above it a rate is cut in whole parts plus a rest.
TABULATED = 32.0


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def row_key(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """What stands for a row in its draws: the id, or for a null id the source and a digest of the text."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.coalesce(F.col(doc_id).cast("string"), F.concat_ws(":", F.lit("null"), F.coalesce(F.col(source), F.lit("")), digest))


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, source: str = "source") -> DataFrame:
    """source, n_docs, rate: the mean number of copies of a document of each source.

    ``weights`` (source, weight) gives the target shares, else they are the sizes to the
    power ``TEMPERATURE``; sources without a weight get none.  ``total`` is the wanted
    number of output rows, by default that of the input.
    """
    counts = durable(docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs")))
    if weights is None:
        shares = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(TEMPERATURE)))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        shares = counts.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    sums = shares.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("docs")).first()
    wanted = float(sums["docs"] or 0) if total is None else float(total)
    rate = F.col("weight") / F.lit(sums["weight"]) * F.lit(wanted) / F.col("n_docs")
    return shares.select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def cumulative(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... until they reach 1 as doubles."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.array_append(a["all"], a["c"] + p).alias("all"))

    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["all"])


def with_copies(docs: DataFrame, table: DataFrame, name: str, seed: int = SEED, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with the number of copies of each row.

    A rate above ``TABULATED`` is a sum of independent parts of at most that rate,
    each drawn with its own hash, so that no cumulative table gets long.
    """
    key, n, cdf = fresh(docs, "mix_source"), fresh(docs, "mix_parts"), fresh(docs, "mix_cdf")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / TABULATED)).cast("int")
    tables = durable(table.select(F.col("source").alias(key), parts.alias(n), cumulative(F.col("rate") / parts).alias(cdf)))
    # The keys are matched with nulls equal; an equality on both parts stays a hash join.
    joined = docs.join(tables, docs[source].eqNullSafe(tables[key]), "left")
    drawn = F.transform(F.sequence(F.lit(1), F.col(n)), lambda part: uniform(str(seed), row_key(doc_id, source), part))
    count = F.aggregate(drawn, F.lit(0), lambda total, u: total + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    return joined.withColumn(name, count).drop(key, n, cdf)


def replicate(docs: DataFrame, seed: int = SEED, weights: DataFrame | None = None, copy: str = "copy", place: str = "place") -> DataFrame:
    """Every document as often as its count, in a global random order, with copy number and place in [0, 1)."""
    n = fresh(docs, "copies")
    counted = with_copies(docs, rates(docs, weights), n, seed)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = counted.filter(F.col(n) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy))
    placed = rows.withColumn(place, uniform(f"{seed}:place", row_key(), F.col(copy)))
    # Equal hashes go to the same partition and are sorted by the rest of the hash there.
    return placed.repartition(place).sortWithinPartitions(place, copy)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The replicated and shuffled documents with the columns of ``docs`` alone."""
    copy, place = fresh(docs, "copy"), fresh(docs, "place")
    return replicate(docs, seed, copy=copy, place=place).select(*[F.col(f"`{c}`") for c in docs.columns])


def numbered_mix(docs: DataFrame, name: str, seed: int = SEED) -> DataFrame:
    """``mix`` with the number of each copy in a column ``name``, which takes the place of one that ``docs`` has."""
    docs = docs.drop(name)
    place = fresh(docs, "place")
    return replicate(docs, seed, copy=name, place=place).drop(place)


def mixture(docs: DataFrame) -> DataFrame:
    """One row per output document: id, source, copy number, place, and a digest of the text that was moved."""
    moved = replicate(docs.select("doc_id", "source", "text"))
    return moved.select("doc_id", "source", "copy", "place", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


ORACLE = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
shares AS (SELECT *, pow(n_docs::DOUBLE, {TEMPERATURE}::DOUBLE) AS weight FROM counts),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM shares) * (SELECT sum(n_docs) FROM shares)::DOUBLE / n_docs AS rate FROM shares),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || md5('{SEED}:' || doc_id || ':1')[1:13])::BIGINT / 4503599627370496.0::DOUBLE)) AS n
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, copy::INTEGER AS copy,
       ('0x' || md5('{SEED}:place:' || doc_id || ':' || copy)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS place,
       md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn WHERE n > 0)"""
