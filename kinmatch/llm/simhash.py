"""SimHash near-duplicates, linked through vantage-point trees.

``fingerprints`` gives each text 64 bits: a bit is set when more than half of its word
shingles' hashes set it.  ``near_pairs`` finds all pairs of different fingerprints at
most ``radius`` bits apart; ``components`` joins what is linked, directly or not.

Trees.  A vantage-point tree sends a fingerprint inward or outward at each level, by
whether its Hamming distance to the level's vantage point exceeds the level's
threshold.  By the triangle inequality, what lies within ``rho`` of a query whose distance
is ``d`` has distances from ``d - rho`` to ``d + rho``; so a query skips the inner branch
when ``d - rho`` is above the threshold and the outer one when ``d + rho`` is not, and
visits both where it overlaps the boundary.  A leaf is a shard: a key on which
stored fingerprints and visiting queries are joined, then compared exactly.

In the metric over all 64 bits this prunes little: distances between unrelated
fingerprints crowd around 32, and 47 % of the queries overlap a median boundary at radius 2.
So each tree uses the Hamming distance over the bits of some blocks, which obeys the
same inequality.  The 64 bits are cut in ``blocks``; two fingerprints ``radius`` bits apart
differ by at most ``rho`` bits (``least_apart``) in the best ``agree`` of them, and there is
one tree for each choice of ``agree`` blocks.  With four blocks, two of which must
agree, ``rho`` is 0: six trees of 32 bits, each fingerprint in one leaf of each, nothing
overlapping, and the work grows in proportion to the fingerprints.

Scale.  Only distinct fingerprints enter the trees, whatever the number of copies.  The
vantage points and thresholds come from at most ``SAMPLE`` fingerprints; all are
indexed and searched.  Leaves meet in a sort-merge join, which spills and whose
large partitions adaptive execution splits.  A pair is kept in the first tree that
can find it, so no deduplication of pairs is needed.  Components contract the graph
by random priorities, by hash aggregates and joins, with each round's tables stored.

Defined results: a null text is an empty one, with fingerprint zero; rows with a null id
get a fingerprint but no component; repeated ids with different texts link what either
text links; an empty table gives an empty one; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import byte_words, fresh, slices
from kinmatch.operators.ranking import numbered
from kinmatch.session import durable

WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
AGREE = 2
LEVELS = 28
SAMPLE = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 100_000


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    from xxhash import xxh64_intdigest

    words = byte_words(text)
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else iter([b" ".join(words)])
    total = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for _, s in zip(range(n), shingles)), dtype="<u8", count=n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = np.array([fingerprint(t.as_py(), width) for t in part.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(over, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def tree_masks(blocks: int, agree: int) -> list[int]:
    """The bits of each choice of ``agree`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, agree)]


def least_apart(radius: int, blocks: int, agree: int) -> int:
    """At most how far apart two fingerprints can be in the ``agree`` blocks that differ least.

    The worst case spreads the ``radius`` bits evenly over the blocks.
    """
    each, more = divmod(radius, blocks)
    return agree * each + max(0, agree - (blocks - more))


class Trees:
    """Vantage points and thresholds, one of each per tree and level."""

    def __init__(self, sample: np.ndarray, radius: int, blocks: int, agree: int, levels: int):
        self.masks = np.array(tree_masks(blocks, agree), dtype=np.uint64)
        self.rho = least_apart(radius, blocks, agree)
        self.points = np.resize(sample, levels) if len(sample) else np.zeros(levels, dtype=np.uint64)
        apart = [[np.bitwise_count((sample ^ p) & m) for p in self.points] for m in self.masks]
        self.bounds = [[int(np.median(d)) if len(sample) else 0 for d in tree] for tree in apart]

    def leaves(self, prints: np.ndarray, rho: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``prints`` and the keys of all leaves within ``rho``; with 0 each has one leaf per tree."""
        rows, keys = [], []
        for t, mask in enumerate(self.masks):
            row = np.arange(len(prints))
            key = np.full(len(prints), t, dtype=np.int64)
            for point, bound in zip(self.points, self.bounds[t]):
                apart = np.bitwise_count((prints[row] ^ point) & mask).astype(np.int64)
                inner, outer = apart - rho <= bound, apart + rho > bound
                row = np.concatenate([row[inner], row[outer]])
                key = np.concatenate([key[inner] * 2, key[outer] * 2 + 1])
            rows.append(row)
            keys.append(key)
        return np.concatenate(rows), np.concatenate(keys)


def near_pairs(
    prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, agree: int = AGREE, levels: int = LEVELS
) -> DataFrame:
    """a, b: the ``node`` ids of all pairs of different fingerprints at most ``radius`` bits apart.

    ``prints`` (node long, fp long) has one row per distinct fingerprint.
    """
    spark = prints.sparkSession
    drawn = prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy()
    trees = Trees(drawn.astype(np.int64).view(np.uint64), radius, blocks, agree, levels)
    shared = spark.sparkContext.broadcast(trees)  # at most ``levels`` points and a bound for each tree

    def routed(rho: int) -> DataFrame:
        def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                row, key = shared.value.leaves(fp.astype(np.int64).view(np.uint64), rho)
                node = batch.column("node").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fp[row])], ["leaf", "node", "fp"])

        return prints.select("node", "fp").mapInArrow(over, "leaf long, node long, fp long")

    a, b = routed(0).alias("a"), routed(trees.rho).alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def close(mask: int) -> Column:
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.bit_count(differ.bitwiseAND(F.lit(signed).cast("long"))) <= trees.rho

    tree = F.shiftright("a.leaf", levels)
    found = [close(int(m)) for m in trees.masks]
    first = [reduce(lambda x, y: x & ~y, found[:t], (tree == t) & found[t]) for t in range(len(found))]
    once = reduce(lambda x, y: x | y, first)
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= radius) & once
    # The planner takes the routed rows for as small as what they come from, so the join is named.
    return a.join(b.hint("merge"), (F.col("a.leaf") == F.col("b.leaf")) & near).select(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")
    )


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each linked node reaches.

    Each round every node moves to the neighbour, or itself, with the smallest random
    priority of the round, which leaves a fraction of the nodes even of a long chain; the
    moves are stored and composed at the end.
    """
    links = durable(edges.filter("a <> b").distinct())
    moves = []
    while not links.isEmpty():
        round_no = F.lit(len(moves))
        ends = links.select("a", "b").union(links.select("b", "a"))
        ends = ends.union(links.select("a", F.col("a"))).union(links.select("b", F.col("b"))).toDF("node", "other")
        move = durable(ends.groupBy("node").agg(F.min_by("other", F.xxhash64("other", round_no)).alias("to")))
        moves.append(move)
        left = links.join(move.toDF("a", "to_a"), "a").join(move.toDF("b", "to_b"), "b").filter("to_a <> to_b")
        links = durable(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).filter("false")
    root = moves[-1]
    for move in reversed(moves[:-1]):
        further = root.toDF("to", "root")
        root = move.join(further, "to", "left").select("node", F.coalesce("root", "to").alias("to"))
    root = durable(root)
    smallest = root.groupBy("to").agg(F.min("node").alias("component"))
    return root.join(smallest, "to").select("node", "component")


def linked(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id of every document; the component is null for a null id."""
    prints = durable(fingerprints(docs, width).withColumn("doc_id", F.col("doc_id").cast("long")))
    known = prints.filter("doc_id IS NOT NULL")
    nodes = durable(known.groupBy("fp").agg(F.min("doc_id").alias("node")))
    # An id that stands for two fingerprints is one node with two prints, which links them.
    joined = components(near_pairs(nodes).unionByName(_repeated(known, nodes)))
    labels = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    labelled = prints.join(durable(labels), "fp", "left")
    return labelled.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _repeated(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the fingerprints of ids that occur with several texts."""
    ids = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("doc_id")
    prints = known.join(ids, "doc_id", "left_semi").join(nodes, "fp").select("doc_id", "node")
    return prints.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``: the one with the smallest id.

    Rows that repeat that id are copies too, and one of them stays.  Rows without an id link like
    others: one of their group stays only where no row with an id is in it.
    """
    key, name = fresh(docs, "stays"), fresh(docs, "nth")
    groups = linked(docs, radius, width)
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(stays, docs["doc_id"] == stays[key]).drop(key)
    first = Window.partitionBy("doc_id").orderBy("text")
    single = kept.withColumn(name, F.row_number().over(first)).filter(F.col(name) == 1).drop(name)
    return single.unionByName(_without_id(docs, radius, width))


def _without_id(docs: DataFrame, radius: int, width: int) -> DataFrame:
    """Of the rows without an id, one of each group that holds no row with an id.

    Each distinct text among them takes part once, under a number above all ids.
    """
    loose = docs.filter("doc_id IS NULL")
    if loose.isEmpty():
        return loose
    number, nth = fresh(docs, "loose"), fresh(docs, "nth")
    texts = numbered(loose.groupBy(F.coalesce(F.col("text"), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n")), [F.col("text")], number)
    # Numbers above all ids: a group that holds an id has that as its smallest member.
    above = max(docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0, 0)
    named = durable(texts.select((F.col(number) + above).alias("doc_id"), "text"))
    both = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").unionByName(named)
    alone = linked(both, radius, width).filter(F.col("doc_id") > above).filter("doc_id = component_id").select("doc_id")
    stays = named.join(alone, "doc_id", "left_semi").select(F.col("text").alias(number))
    kept = loose.join(stays, F.coalesce(loose["text"], F.lit("")) == stays[number]).drop(number)
    first = Window.partitionBy(F.coalesce("text", F.lit(""))).orderBy(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    return kept.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint in hex and the smallest id that it is linked to."""
    return linked(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
