"""Documents in chunks, and questions that chunks ask together.

A chunk is one row with the ids and whole texts, as UTF-8, of some documents: about ``CHUNK`` bytes, or one
longer document.  Chunks are stored once, bucketed by their number.

``answered`` is a round of questions over all chunks.  A chunk's task asks about the keys it holds,
each once, however often it occurs there; keys go to buckets by their hash, packed, one row per
chunk and bucket.  A bucket sees what all chunks know of its keys and answers each of them in the
order in which it asked.  So what is exchanged grows with the distinct keys of chunks, not with occurrences, and no
key or bucket is larger than the number of chunks that hold it.  Answers go back to the stored
chunks by their bucket, which moves the answers alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.buckets import Bucketed
from kinmatch.llm.common import slices

CHUNK = 2_000_000
#: Bytes of keys in a bucket, about.
BUCKET = 4_000_000

CHUNKS = "ids array<long>, sizes array<int>, body binary"


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunked(docs: DataFrame, size: int = CHUNK) -> Bucketed:
    """chunk, ids, sizes, body: all documents; -1 in ``sizes`` stands for a null text."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def row() -> pa.RecordBatch:
            ids, texts = zip(*held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([list(ids)], pa.list_(pa.int64())),
                    pa.array([[-1 if t is None else len(t) for t in texts]], pa.list_(pa.int32())),
                    pa.array([b"".join(t or b"" for t in texts)], pa.binary()),
                ],
                ["ids", "sizes", "body"],
            )

        for part in slices(batches, "text"):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                raw = None if text is None else text_bytes(text)
                if held and total + len(raw or b"") > size:
                    yield row()
                    held, total = [], 0
                held.append((i, raw))
                total += len(raw or b"")
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(over, CHUNKS)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Bucketed(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunk", buckets)


class Chunk:
    """One row of ``chunked`` as arrays."""

    def __init__(self, ids: list, sizes: np.ndarray, body: bytes):
        self.ids = ids
        self.null = sizes < 0
        self.sizes = np.maximum(sizes, 0).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = body
        self.body = np.frombuffer(body, dtype=np.uint8)

    @classmethod
    def rows(cls, batch: pa.RecordBatch) -> Iterator[Chunk]:
        for i in range(batch.num_rows):
            sizes = batch.column("sizes")[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
            yield cls(batch.column("ids")[i].as_py(), sizes, batch.column("body")[i].as_py())


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts rows of a bucket together, the buckets there are, and where each starts (and the last ends)."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, found, np.append(starts, len(bucket))


def answered(asked: DataFrame, answer: Callable[[pa.Table], list[bytes]], chunk: str = "chunk") -> DataFrame:
    """chunk, answers: of each chunk the answers (bucket, answer) to the rows that it sent.

    ``asked`` has a row for each chunk and bucket; ``answer`` gives one answer for each row of a bucket.
    """

    def group(table: pa.Table) -> pa.Table:
        got = answer(table)
        return pa.table({chunk: table.column(chunk), "bucket": table.column("bucket"), "answer": pa.array(got, pa.binary())})

    rows = asked.groupBy("bucket").applyInArrow(group, f"{chunk} long, bucket int, answer binary")
    return rows.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def told(chunks: DataFrame, answers: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Stored chunks with their answers, in the order of buckets; null where a chunk has none."""
    return chunks.join(answers.hint("shuffle_hash"), chunk, "left")
