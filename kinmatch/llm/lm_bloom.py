"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The model interpolates bigrams with smoothed single words.  All counts it uses come out
of one Bloom filter: an n-gram of count ``c`` is quantised to level ``1 + floor(log2 c)``
and inserted once for every level up to its own, so a count is found by probing level
after level until one is absent.  Every n-gram is stored, those seen once too, and the
filter has ``BITS_PER_INSERTION`` bits for each insertion, so its errors do not depend on
the size of the corpus.

The filter is a table of segments of ``SEGMENT_BITS`` bits, each filled by one task from the
keys of its range.  Up to ``BROADCAST_BITS`` in all it is broadcast.  A larger one stays a
table: each chunk of texts sends its distinct keys to their segments and gets the levels
back, by two joins, with the same scores.  Keys that make up more than a ``HOT``-th of all tokens
(there are at most twice ``HOT`` of these) travel with the tasks, so no segment is asked for them.

Counting is distributed: tasks count their own texts' tokens, single words are summed
by hash, and bigrams are packed, sorted, in as many buckets as keep a bucket to about
``BUCKET`` occurrences at any size of corpus, so that a frequent bigram costs a bucket
one entry per task.

Beside the model's score there is an exact base score of single words.  Counts of the
``FREQUENT`` commonest words travel with the tasks; what a text has besides is joined, by
word, with the table of all counts, so no count is left out and no hot word is joined.

Words and bigrams stand for their 64-bit hashes (48 bits in the filter).

Defined results: a null text is an empty one, that is an end token alone; a null id
counts as an empty text in the fold; repeated rows are scored one by one, each also
counting in training; without training rows every count is zero; an empty table gives an
empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import byte_words, fold, mixed, packed, slices, unpacked
from kinmatch.session import durable

#: Bits of a segment of the filter, a power of two.
SEGMENT_BITS = 1 << 23
BITS_PER_INSERTION = 8
PROBES = 4
#: The largest filter that is broadcast.
BROADCAST_BITS = 1 << 30
HOT = 1 << 17
#: Characters of a chunk whose keys are sent to the segments at once.
CHUNK_CHARS = 4_000_000
#: Keys of a level that are stored in one row.
PIECE = 1 << 16
FREQUENT = 1 << 18
BUCKET = 1 << 21
#: Entries that a counting task keeps before it hands them on.
HELD = 4_000_000
WEIGHT = 0.6

START = np.uint64(0x5354415254)
END = 0x454E44
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then the end, and the number of tokens of each text."""
    from xxhash import xxh64_intdigest

    out, sizes = [], []
    for text in texts:
        words = byte_words(text)
        out.extend(map(xxh64_intdigest, words))
        out.append(END)
        sizes.append(len(words) + 1)
    return np.array(out, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def word_keys(h: np.ndarray) -> np.ndarray:
    """48-bit keys of single words in the filter."""
    return mixed(h ^ ODD) >> np.uint64(16)


def pair_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """48-bit keys of each token with the one before it, the first of a text with the start."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mixed(mixed(before + STEP) + h) >> np.uint64(16)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def typical(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for level 0."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts added up per key, keys sorted."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _counted(batches: Iterable[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of a task's texts, handed on whenever many are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for part in slices(batches, "text"):
        held.append(np.unique(keys_of(*hashes(part.column("text").to_pylist())), return_counts=True))
        n += len(held[-1][0])
        if n > HELD:
            held = [summed(*map(np.concatenate, zip(*held)))]
            n = len(held[0][0])
            if n > HELD // 2:
                yield held.pop()
                n = 0
    if held:
        yield summed(*map(np.concatenate, zip(*held)))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: count of every token, by hash."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _counted(batches, lambda h, sizes: h):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(over, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def pair_levels(docs: DataFrame, tokens: int) -> DataFrame:
    """level, n, keys: the keys of all bigrams, packed by level.

    ``tokens`` is the number of tokens in ``docs``, from which the number of buckets follows.
    """
    bits = max(8, int(max(1, tokens) // BUCKET).bit_length())
    rest = np.uint64(48 - bits)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _counted(batches, pair_keys):
            bucket = (keys >> rest).astype(np.int64)
            low = keys & np.uint64((1 << int(rest)) - 1)
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                k, c = low[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]
                more = c > 1
                row = [[int(b)], [packed(k[~more], 5)], [packed(k[more], 5)], [c[more].astype("<u4").tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "once", "more", "counts"],
                )

    def merge(table: pa.Table) -> pa.Table:
        once = [unpacked(x.as_py(), 5) for x in table.column("once")]
        more = [unpacked(x.as_py(), 5) for x in table.column("more")]
        counts = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in table.column("counts")]
        keys, total = summed(np.concatenate([*once, *more]), np.concatenate([*[np.ones(len(x), dtype=np.int64) for x in once], *counts]))
        b = table.column("bucket")[0].as_py()
        return level_rows(keys | (np.uint64(b) << rest), total)

    parts = docs.select("text").mapInArrow(over, "bucket int, once binary, more binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(merge, LEVEL_ROWS)


LEVEL_ROWS = "level int, n long, keys binary"


def level_rows(keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Keys by level, sorted, in pieces of at most ``PIECE``."""
    level = levels(counts)
    order = np.lexsort((keys, level))
    keys, level = keys[order], level[order]
    cuts = np.flatnonzero(np.diff(level)) + 1
    pieces = [run[i : i + PIECE] for run in np.split(np.arange(len(keys)), cuts) for i in range(0, len(run), PIECE)]
    return pa.table(
        {
            "level": pa.array([level[x[0]] for x in pieces], pa.int32()),
            "n": pa.array([len(x) for x in pieces], pa.int64()),
            "keys": pa.array([packed(keys[x], 6) for x in pieces], pa.binary()),
        }
    )


def word_levels(counts: DataFrame) -> DataFrame:
    """The single words of ``word_counts`` in the form of ``pair_levels``."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def rows() -> list[pa.RecordBatch]:
            return level_rows(*map(np.concatenate, zip(*held))).to_batches() if held else []

        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            held.append((word_keys(h), batch.column("c").to_numpy(zero_copy_only=False)))
            n += len(h)
            if n > BUCKET:
                yield from rows()
                held.clear()
                n = 0
        yield from rows()

    return counts.mapInArrow(over, LEVEL_ROWS)


def segment_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The segment, of ``n``, that holds each key; it does not fall as keys rise."""
    return ((keys >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and stride of the probes of keys at a level."""
    mix = mixed(keys * ODD + np.uint64(level * int(STEP) & (1 << 64) - 1))
    return mix, (mix >> np.uint64(32)) | np.uint64(1)


def stored_levels(keys: np.ndarray, bits: np.ndarray, offset: np.ndarray, segment_bits: int) -> np.ndarray:
    """The level at which each key is stored, 0 for none; its segment starts at byte ``offset`` of ``bits``."""
    mask = np.uint64(segment_bits - 1)
    found = np.zeros(len(keys), dtype=np.int64)
    alive = np.arange(len(keys))
    for level in range(1, 64):
        place, stride = probes(keys[alive], level)
        for _ in range(PROBES):
            at = place & mask
            hit = np.flatnonzero(bits[offset[alive] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            alive, stride, place = alive[hit], stride[hit], place[hit] + stride[hit]
        if not len(alive):
            break
        found[alive] = level
    return found


@dataclass
class Filter:
    """A stored log-frequency Bloom filter.

    ``rows`` are segment, bits, hot and hot_levels: the segment's bits, and those of its keys that are
    at ``hot_level`` or above, with the level at which the filter holds them.
    """

    rows: DataFrame
    segments: int
    segment_bits: int

    @property
    def bits(self) -> int:
        return self.segments * self.segment_bits


def build(rows: DataFrame, tokens: int, segment_bits: int = SEGMENT_BITS, hot: int = HOT) -> Filter:
    """The filter of all ``rows`` (as of ``pair_levels``), counts of ``tokens`` tokens."""
    insertions = rows.agg(F.sum(F.col("n") * F.col("level"))).first()[0] or 0
    n = max(1, -(-insertions * BITS_PER_INSERTION // segment_bits))
    hot_level = int(tokens // hot).bit_length() + 1

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, raw in zip(batch.column("level").to_pylist(), batch.column("keys")):
                keys = unpacked(raw.as_py(), 6)
                segment = segment_of(keys, n)
                pieces = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(segment)) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment[x[0]] for x in pieces], pa.int64()),
                        pa.array([level] * len(pieces), pa.int32()),
                        pa.array([packed(keys[x], 6) for x in pieces], pa.binary()),
                    ],
                    ["segment", "level", "keys"],
                )

    def fill(table: pa.Table) -> pa.Table:
        marks = np.zeros(segment_bits, dtype=bool)
        mask = np.uint64(segment_bits - 1)
        often = []
        for level, raw in zip(table.column("level").to_pylist(), table.column("keys")):
            keys = unpacked(raw.as_py(), 6)
            if level >= hot_level:
                often.append(keys)
            for q in range(1, level + 1):
                place, stride = probes(keys, q)
                for _ in range(PROBES):
                    marks[place & mask] = True
                    place = place + stride
        bits = np.packbits(marks, bitorder="little")
        keys = np.concatenate(often) if often else np.array([], dtype=np.uint64)
        found = stored_levels(keys, bits, np.zeros(len(keys), dtype=np.int64), segment_bits)
        return pa.table(
            {
                "segment": pa.array([table.column("segment")[0].as_py()], pa.int64()),
                "bits": pa.array([bits.tobytes()], pa.binary()),
                "hot": pa.array([packed(keys, 6)], pa.binary()),
                "hot_levels": pa.array([found.astype(np.uint8).tobytes()], pa.binary()),
            }
        )

    parts = rows.select("level", "keys").mapInArrow(cut, "segment long, level int, keys binary")
    filled = parts.groupBy("segment").applyInArrow(fill, "segment long, bits binary, hot binary, hot_levels binary")
    return Filter(durable(filled), n, segment_bits)


@dataclass
class Probed:
    """A whole filter in memory."""

    bits: np.ndarray
    segments: int
    segment_bits: int

    def level(self, keys: np.ndarray) -> np.ndarray:
        return stored_levels(keys, self.bits, segment_of(keys, self.segments) * (self.segment_bits // 8), self.segment_bits)


@dataclass
class Known:
    """Levels of sorted keys."""

    keys: np.ndarray
    levels: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def level(self, keys: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.keys, keys)].astype(np.int64)


def gathered(counts: Filter) -> Probed:
    """The filter in the driver's memory; only for one of at most ``BROADCAST_BITS``."""
    flat = np.zeros(counts.bits // 8, dtype=np.uint8)
    each = counts.segment_bits // 8
    for r in counts.rows.select("segment", "bits").toLocalIterator():
        flat[r["segment"] * each : (r["segment"] + 1) * each] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return Probed(flat, counts.segments, counts.segment_bits)


def hot_keys(counts: Filter) -> Known:
    """The filter's hot keys, at most twice ``HOT``."""
    found = counts.rows.filter(F.length("hot") > 0).select("hot", "hot_levels").collect()
    keys = np.concatenate([np.array([], dtype=np.uint64), *[unpacked(bytes(r["hot"]), 6) for r in found]])
    level = np.concatenate([np.array([], dtype=np.uint8), *[np.frombuffer(bytes(r["hot_levels"]), dtype=np.uint8) for r in found]])
    keys, first = np.unique(keys, return_index=True)
    return Known(keys, level[first])


@dataclass
class Model:
    """What the scores need besides the filter."""

    tokens: int
    vocabulary: int
    docs: int
    weight: float = WEIGHT

    def log_probabilities(self, level_of: Callable[[np.ndarray], np.ndarray], h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the token before it; ``level_of`` gives the levels of keys."""
        distinct, inverse = np.unique(h, return_inverse=True)
        single = typical(level_of(word_keys(distinct)))[inverse]
        before = np.empty(len(h))
        before[1:] = single[:-1]
        before[np.cumsum(sizes) - sizes] = self.docs
        pairs, at = np.unique(pair_keys(h, sizes), return_inverse=True)
        # A bigram is not seen more often than its first word.
        pair = np.minimum(typical(level_of(pairs))[at], before)
        alone = (single + 1) / (self.tokens + self.vocabulary + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            both = self.weight * pair / before + (1 - self.weight) * alone
        return np.log10(np.where(before > 0, both, alone))


def train(docs: DataFrame, segment_bits: int = SEGMENT_BITS, hot: int = HOT) -> tuple[Model, Filter, DataFrame]:
    """The model of all ``docs``, its filter, and the stored table of word counts (h, c)."""
    counts = durable(word_counts(docs))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("h") == END, F.col("c"))).alias("d")).first()
    tokens = sums["n"] or 0
    rows = durable(pair_levels(docs, tokens).unionByName(word_levels(counts)))
    return Model(tokens, sums["v"], sums["d"] or 0), build(rows, tokens, segment_bits, hot), counts


def _document_rows(part: pa.RecordBatch, base: int, tokens, sizes, common, common_counts) -> pa.RecordBatch:
    """A row per document: its exact sums over common words, and its other words, once per text, to be joined."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    distinct, inverse = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(common, distinct), max(0, len(common) - 1))
    hit = common[at] == distinct if len(common) else np.zeros(len(distinct), dtype=bool)
    logs = np.where(hit, np.log10((common_counts[at] if len(common) else 0) + 1.0), 0.0)
    n = len(sizes)
    rare = ~hit[inverse]
    pairs, times = np.unique(owner[rare] * len(distinct) + inverse[rare], return_counts=True)
    doc, word = np.divmod(pairs, len(distinct))
    offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(base + np.arange(n), pa.int64()),
            part.column("doc_id"),
            pa.array(sizes),
            pa.array(np.bincount(owner, hit[inverse], n).astype(np.int64)),
            pa.array(np.bincount(owner, logs[inverse], n)),
            pa.ListArray.from_arrays(offsets, pa.array(distinct[word].view(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
        ],
        ["row", "doc_id", "n_tokens", "known", "logs", "rare", "times"],
    )


def _with_score(rows: pa.RecordBatch, logs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.bincount(owner, logs, len(sizes)))], [*rows.schema.names, "score"])


def _by_broadcast(docs: DataFrame, model: Model, counts: Filter, common, schema: str) -> DataFrame:
    """Document rows, scored with the whole filter in every worker."""
    shared = docs.sparkSession.sparkContext.broadcast((gathered(counts), *common))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, *words = shared.value
        base = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            tokens, sizes = hashes(part.column("text").to_pylist())
            rows = _document_rows(part, base, tokens, sizes, *words)
            yield _with_score(rows, model.log_probabilities(whole.level, tokens, sizes), sizes)
            base += len(sizes)

    return docs.select("doc_id", "text").mapInArrow(over, schema)


def _by_segment(docs: DataFrame, model: Model, counts: Filter, common, schema: str) -> DataFrame:
    """The same rows, with the filter left in its table: keys go to their segments, levels come back to their chunk."""
    n, segment_bits = counts.segments, counts.segment_bits
    shared = docs.sparkSession.sparkContext.broadcast((hot_keys(counts), *common))

    def asked(known: Known, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keys = np.unique(np.concatenate([word_keys(np.unique(h)), pair_keys(h, sizes)]))
        return keys[~known.has(keys)]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *words = shared.value
        base = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text", CHUNK_CHARS):
            h, sizes = hashes(part.column("text").to_pylist())
            rows = _document_rows(part, base, h, sizes, *words)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            distinct, code = np.unique(h, return_inverse=True)
            keys = asked(known, h, sizes)
            segment = segment_of(keys, n)
            pieces = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(segment)) + 1) if len(keys) else []
            asks = [{"segment": int(segment[x[0]]), "keys": packed(keys[x], 6)} for x in pieces]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base], pa.int64()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([distinct.tobytes()], pa.binary()),
                    pa.array([code.astype("<u4").tobytes()], pa.binary()),
                    pa.array([asks], pa.list_(pa.struct([("segment", pa.int64()), ("keys", pa.binary())]))),
                ],
                ["chunk", "rows", "words", "codes", "asks"],
            )
            base += len(sizes)

    def answer(asks: pa.Table, segments: pa.Table) -> pa.Table:
        keys = [unpacked(x.as_py(), 6) for x in asks.column("keys")]
        # A segment without a key has no row.
        bits = np.frombuffer(segments.column("bits")[0].as_py(), dtype=np.uint8) if segments.num_rows else np.zeros(segment_bits // 8, np.uint8)
        found = [stored_levels(k, bits, np.zeros(len(k), dtype=np.int64), segment_bits).astype(np.uint8).tobytes() for k in keys]
        return pa.table({"chunk": asks.column("chunk"), "segment": asks.column("segment"), "levels": pa.array(found, pa.binary())})

    def finish(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        known = shared.value[0]
        rows = pa.ipc.open_stream(chunks.column("rows")[0].as_py()).read_next_batch()
        sizes = rows.column("n_tokens").to_numpy()
        h = np.frombuffer(chunks.column("words")[0].as_py(), "<u8")[np.frombuffer(chunks.column("codes")[0].as_py(), "<u4")]
        # Segments follow the order of keys.
        levels_ = [x.as_py() for x in answers.sort_by("segment").column("levels")]
        keys = np.concatenate([known.keys, asked(known, h, sizes)])
        found = np.concatenate([known.levels, np.frombuffer(b"".join(levels_), dtype=np.uint8)])
        order = np.argsort(keys)
        level_of = Known(keys[order], found[order]).level
        return pa.Table.from_batches([_with_score(rows, model.log_probabilities(level_of, h, sizes), sizes)])

    chunks = durable(
        docs.select("doc_id", "text").mapInArrow(
            read, "chunk long, rows binary, words binary, codes binary, asks array<struct<segment:long,keys:binary>>"
        )
    )
    asks = chunks.select("chunk", F.inline("asks"))
    answers = (
        asks.groupBy("segment")
        .cogroup(counts.rows.join(asks.select("segment").distinct(), "segment", "left_semi").select("segment", "bits").groupBy("segment"))
        .applyInArrow(answer, "chunk long, segment long, levels binary")
    )
    return chunks.drop("asks").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def scores(
    docs: DataFrame, model: Model, bloom: Filter, counts: DataFrame, frequent: int = FREQUENT, broadcast_bits: int = BROADCAST_BITS
) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document."""
    top = counts.orderBy(F.desc("c"), "h").limit(frequent)
    known = top.toArrow()  # at most ``frequent`` rows
    h = known.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    common = (h[order], known.column("c").to_numpy().astype(np.int64)[order])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, known long, logs double, rare array<long>, times array<int>, score double"
    # Row numbers only hold for one run of a task, so the rows are stored before they are used twice.
    rows = durable((_by_broadcast if bloom.bits <= broadcast_bits else _by_segment)(docs, model, bloom, common, schema))
    single = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", "w.rare", "w.times")
    met = single.join(counts, single["rare"] == counts["h"])
    rest = met.groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs")
    )
    size = F.lit(float(model.tokens + model.vocabulary + 1))

    def both(a: str, b: str, zero: Column) -> Column:
        return F.col(a) + F.coalesce(F.col(b), zero)

    return rows.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        both("known", "more_known", F.lit(0)).cast("long").alias("n_known"),
        (both("logs", "more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(size)).alias("base_score"),
        "score",
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """All documents scored by a model of those outside the held-out seventh."""
    held_out = fold(F.col("doc_id"), 7) == 2
    model, bloom, counts = train(docs.filter(~held_out))
    return scores(docs, model, bloom, counts).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
