"""Text embedding with weights learnt from the corpus: signed hashed counts of words and word pairs.

A term (a word, or two words in a row) counts ``tf * (1 + ln((N + 1) / (df + 1)))`` with ``df`` of the ``N``
texts that hold it, in the bucket and with the sign that its MD5 gives, so that terms which share a bucket
cancel out on average instead of adding up.  Pairs keep some of the word order.

Texts are cut in blocks of a bounded size by a hash of their key.  A block counts its terms and sends them, once each, to
parts by a hash of the term; a part adds up the blocks' counts and sends the weights back to the blocks that hold the term.
A block and a part are a row group of one task; a term that all texts hold is one entry per block in its part.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kinmatch.functions.urls import is_blank
from kinmatch.functions.vectors import normalise

DIM = 256
#: Bytes of text of a block, about.
BLOCK_BYTES = 8 << 20
#: Vectors of an Arrow batch that a task hands on.
VECTORS = 1_000

#: What no word holds.
GAP, END = "[ \t\r\n]+", "\n"


class _Terms:
    """The terms of a block of texts, numbered as they come up, and how often each text holds them.

    Rows of one key follow each other and are one text.
    """

    def __init__(self, keys: list, texts: list[str]):
        self.keys = [k for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        new = np.fromiter((i > 0 and k != keys[i - 1] for i, k in enumerate(keys)), dtype=np.int64, count=len(keys))
        lists = pc.split_pattern_regex(pa.array([t.strip() for t in texts], pa.large_string()), GAP)
        found = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.words, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.flatnonzero(row[1:] == row[:-1])
        pairs = pa.array(code[inside] * len(self.words) + code[inside + 1]).dictionary_encode()
        made = pairs.dictionary.to_numpy(zero_copy_only=False)
        self.first, self.second = made // max(1, len(self.words)), made % max(1, len(self.words))
        self.size = len(self.words) + len(made)
        text = np.cumsum(new)[row]
        held = np.concatenate(
            [text * self.size + code, text[inside] * self.size + pairs.indices.to_numpy(zero_copy_only=False) + len(self.words)]
        )
        held.sort()
        start = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.zeros(0, dtype=np.int64)
        #: Text, term and count, each text and term once.
        self.text, self.term = np.divmod(held[start], max(1, self.size))
        self.tf = np.diff(np.append(start, len(held)))

    def written(self) -> pa.Array:
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(self.first)), self.words.take(pa.array(self.second)), pa.scalar(" ", pa.large_string()))
        return pa.concat_arrays([self.words, pairs])

    def parts(self, parts: int) -> np.ndarray:
        """The part of each term: a hash of the words that it is made of."""
        crc = np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], dtype=np.uint64)
        both = (crc[self.first] * np.uint64(0x9E3779B1) + crc[self.second] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return (np.concatenate([crc, both]) % np.uint64(parts)).astype(np.int64)


def _raw(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values between each two cuts."""
    return pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())


def _values(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def block_terms(rows: DataFrame, parts: int) -> DataFrame:
    """For each block and part: numbers and spellings of the block's terms, and how many of its texts hold each."""

    def run(batches):
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        block = got.column("block")[0].as_py()
        terms = _Terms(got.column("key").to_pylist(), got.column("text").to_pylist())
        part = terms.parts(parts)
        order = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])), len(order))
        texts = np.bincount(terms.term, minlength=terms.size)[order]
        spelt = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), terms.written().take(pa.array(order)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[order][cuts[:-1]], pa.int32()),
                pa.array(np.full(len(cuts) - 1, block), pa.int32()),
                _raw(order.astype("<i4"), cuts),
                _raw(texts.astype("<i4"), cuts),
                pc.binary_join(spelt, pa.scalar(END, pa.large_string())).cast(pa.string()),
            ],
            ["part", "block", "number", "texts", "terms"],
        )

    return rows.mapInArrow(run, "part int, block int, number binary, texts binary, terms string")


def term_values(held: DataFrame, n: int, dim: int) -> DataFrame:
    """For each block and part: the block's numbers of terms, their buckets and what they count, from the texts of all blocks."""

    def run(batches):
        got = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        lists = pc.split_pattern(got.column("terms").chunk(0).cast(pa.large_string()), END)
        found = lists.flatten().dictionary_encode()
        cuts = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        at = found.indices.to_numpy(zero_copy_only=False)
        df = np.bincount(at, weights=_values(got.column("texts"), "<i4"), minlength=len(found.dictionary))
        digest = b"".join(hashlib.md5(t).digest()[:4] for t in found.dictionary.cast(pa.large_binary()).to_pylist())
        # Seven hexadecimal digits for the bucket, one for the sign.
        mark = np.frombuffer(digest, dtype=">u4")
        value = np.where(mark % 16 < 8, 1.0, -1.0) * (1 + np.log((n + 1) / (df + 1)))
        bucket = ((mark >> 4) % dim).astype("<i4")
        columns = [got.column("block").chunk(0), got.column("number").chunk(0), _raw(bucket[at], cuts), _raw(value[at], cuts)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "number", "bucket", "value"])

    return held.mapInArrow(run, "block int, number binary, bucket binary, value binary")


def summed(rows: DataFrame, dim: int) -> DataFrame:
    """key and the vector of each text, from the texts of a block and the values of its terms."""
    key = StructField("key", rows.schema["key"].dataType)

    def run(batches):
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        texts = got.filter(pc.is_valid(got.column("text")))
        sent = got.filter(pc.is_null(got.column("text")))
        terms = _Terms(texts.column("key").to_pylist(), texts.column("text").to_pylist())
        number = _values(sent.column("number"), "<i4")
        if len(number) != terms.size:
            raise ValueError(f"a block has {terms.size} terms, and {len(number)} when they were counted: its texts have changed")
        bucket, value = np.zeros(terms.size, dtype=np.int64), np.zeros(terms.size)
        bucket[number], value[number] = _values(sent.column("bucket"), "<i4"), _values(sent.column("value"), "<f8")
        place = terms.text * dim + bucket[terms.term]
        flat = np.bincount(place, weights=terms.tf * value[terms.term], minlength=len(terms.keys) * dim)
        for at in range(0, len(terms.keys), VECTORS):
            keys = pa.array(terms.keys[at : at + VECTORS], got.schema.field("key").type)
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * dim
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[at * dim : (at + len(keys)) * dim]))
            yield pa.RecordBatch.from_arrays([keys, vectors], ["key", "embedding"])

    return rows.mapInArrow(run, StructType([key, StructField("embedding", ArrayType(DoubleType()))]))


def weighted_embeddings(texts: DataFrame, key: str, text: str = "text", dim: int = DIM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key and the unit vector of each text that is not blank; all zeros if its terms cancel out.

    Rows of one key count as one text, null keys are left out.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & ~is_blank(F.col("text")))
    whole = rows.agg(F.count_distinct("key").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-(whole["bytes"] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block")
    # Both times the rows of a block come in the same order, so its terms have the same numbers.
    cut = rows.select(block, "key", F.lower("text").alias("text"))
    held = block_terms(cut.repartitionById(blocks, F.col("block")).sortWithinPartitions("key", "text"), blocks)
    values = term_values(held.repartitionById(blocks, F.col("part")), whole["n"], dim)
    both = cut.unionByName(values, allowMissingColumns=True).repartitionById(blocks, F.col("block"))
    vectors = summed(both.sortWithinPartitions("key", "text"), dim)
    return vectors.select(F.col("key").alias(key), normalise(F.col("embedding")).alias("embedding"))
