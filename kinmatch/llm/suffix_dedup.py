"""Repeated passages, byte by byte, by a distributed difference-cover suffix sort.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with
a smaller id.  Strings that are equal stand next to each other among the sorted suffixes;
``suffixes.suffix_order`` sorts them: triples of sampled positions, named, the names again by triples,
then the remaining suffixes merged in.  Neighbours are compared over ``LENGTH`` bytes, and each
class of equal strings knows its smallest document.

Only what can repeat is sorted, in shards that hold all that can be equal:

1. Every string of ``LENGTH`` bytes chooses one of its grams of ``GRAM`` bytes, the one with the smallest
   hash (the leftmost of equal ones), so equal strings choose equal grams.  Chunks ask in how
   many places a chosen gram occurs (``chunks.answered``).  Strings whose gram occurs in one document alone cannot repeat.
2. The others go, in pieces of consecutive strings with the same gram, to the shard of that gram; a chunk
   sends equal pieces once, with their smallest document.  All but the first document of a piece
   lose all its strings without further ado; a gram with a single piece needs no sorting.
   The rest of a shard is one text, whose suffixes are sorted.
3. Shards answer with a bit for each string of a piece.  Chunks turn strings into covered bytes.

The suffix sort is exact for any hash, which only decides what meets where.

Scale.  Chunks are stored once and never shuffled; hashes (5 bytes for one in thirteen places), pieces and bits
are.  A shard has about ``SHARD`` bytes.  A gram in more than ``HOT`` chunks would make a shard that grows with the
corpus: its strings are dealt out one by one, by the hash of the whole string, and a chunk sends each of them once.

Defined results: a null text is an empty one; rows with a null id come after all ids, and equal ids do not
make each other's strings repeats; texts shorter than ``LENGTH`` keep all bytes; an empty table gives an empty one;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.chunks import BUCKET, CHUNK, Chunk, answered, by_bucket, chunked, told
from kinmatch.llm.common import mixed, packed, unpacked
from kinmatch.llm.suffixes import equal_neighbours, suffix_order
from kinmatch.session import durable

LENGTH = 50
GRAM = 24
#: Bytes of pieces in a shard, about.
SHARD = 1_000_000
#: Chunks above which the strings of a gram are dealt out one by one.
HOT = 4096
#: Strings whose grams are chosen at a time.
SEGMENT = 1 << 20
#: Bytes of a gram's hash that are compared within a bucket; more equal ones only mean more to sort.
SHORT = 5
NO_ID = np.iinfo(np.int64).max

#: Odd multipliers, one for each word of a gram.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def words_at(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(0, len(body) - 7),), "<u8", body.tobytes(), strides=(1,))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes (three words) from each place on."""
    n = len(words) - GRAM + 8
    h = words[:n] * np.uint64(ODD[0])
    for k in (1, 2):
        h ^= h >> np.uint64(29)
        h += words[8 * k : 8 * k + n]
        h *= np.uint64(ODD[k])
    h ^= h >> np.uint64(32)
    return h


def least_of(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    span = 1
    out = key
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    more = width - span
    return np.minimum(out[:-more], out[more:]) if more else out


class Pieces:
    """Runs of consecutive strings with the same chosen gram: first and last start, the gram's hash, and the document."""

    def __init__(self, chunk: Chunk):
        lows, highs, hashes = [], [], []
        body = chunk.body
        total = len(body) - LENGTH + 1
        left = np.zeros(max(total, 0), dtype=bool)
        for start, end in zip(chunk.starts.tolist(), chunk.ends.tolist()):
            left[start : max(start, end - LENGTH + 1)] = True
        for at in range(0, max(total, 0), SEGMENT):
            count = min(SEGMENT, total - at)
            h = gram_hashes(words_at(body[at : at + count + LENGTH - 1]))
            place = np.arange(len(h), dtype=np.uint64)
            key = (h & ~np.uint64((1 << 21) - 1)) | place
            chosen = (least_of(key, LENGTH - GRAM + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
            valid = np.flatnonzero(left[at : at + count])
            if not len(valid):
                continue
            gram = chosen[valid]
            new = np.flatnonzero((gram[1:] != gram[:-1]) | (valid[1:] != valid[:-1] + 1)) + 1
            first = np.concatenate([[0], new])
            lows.append(valid[first] + at)
            highs.append(valid[np.append(new, len(valid)) - 1] + at)
            hashes.append(h[gram[first]])
        self.low = np.concatenate(lows) if lows else np.zeros(0, dtype=np.int64)
        self.high = np.concatenate(highs) if highs else np.zeros(0, dtype=np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        ids = np.array([NO_ID if i is None else i for i in chunk.ids], dtype=np.int64)
        self.doc = ids[np.searchsorted(chunk.ends, self.low, side="right")]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(33)).astype(np.int64) % buckets).astype(np.int32)


def _grams(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of a chunk, the gram of each piece, and whether a gram is in documents of different ids."""
    distinct, inverse = np.unique(pieces.hash, return_inverse=True)
    low = np.full(len(distinct), NO_ID, dtype=np.int64)
    high = np.full(len(distinct), np.iinfo(np.int64).min, dtype=np.int64)
    np.minimum.at(low, inverse, pieces.doc)
    np.maximum.at(high, inverse, pieces.doc)
    return distinct, inverse, low != high


def _ask_grams(buckets: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk in zip(batch.column("chunk").to_pylist(), Chunk.rows(batch)):
                distinct, _, several = _grams(Pieces(chunk))
                order, found, cuts = by_bucket(bucket_of(distinct, buckets))
                keys, several = distinct[order], several[order]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), number)),
                        pa.array(found.astype(np.int32)),
                        pa.array([packed(keys[a:b], SHORT) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["chunk", "bucket", "keys", "several"],
                )

    return over


def _count_grams(hot: int):
    """0 for a gram of a single document, 1 for a repeated one, 2 for one in more than ``hot`` chunks."""

    def answer(table: pa.Table) -> list[bytes]:
        keys = [unpacked(x, SHORT) for x in table.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)) for x, k in zip(table.column("several").to_pylist(), keys)]
        _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        state = (counts > 1).astype(np.uint8)
        np.maximum.at(state, inverse, np.concatenate(several))
        state[counts > hot] = 2
        state = state[inverse]
        ends = np.cumsum([len(k) for k in keys])
        return [state[e - len(k) : e].tobytes() for e, k in zip(ends.tolist(), keys)]

    return answer


class Sent:
    """The pieces that a chunk sends: where each occurs, and the distinct ones in the order of shards.

    ``low``, ``piece`` and ``least`` belong to occurrences: first start, number among the distinct pieces, and
    whether the document is the smallest of the chunk with that piece.  It only depends on the chunk and the answers
    about its grams, so it is made again where it is needed.
    """

    def __init__(self, chunk: Chunk, answers: list | None, buckets: int, shards: int):
        pieces = Pieces(chunk)
        distinct, inverse, _ = _grams(pieces)
        state = np.zeros(len(distinct), dtype=np.uint8)
        told_ = b"".join(a["answer"] for a in answers or [])
        state[by_bucket(bucket_of(distinct, buckets))[0]] = np.frombuffer(told_, dtype=np.uint8)
        state = state[inverse]
        low, high, gram, doc = (x[state > 0] for x in (pieces.low, pieces.high, pieces.hash, pieces.doc))
        alone = state[state > 0] == 2
        if alone.any():
            # Strings of a hot gram go one by one, by a hash of the whole string.
            times = np.where(alone, high - low + 1, 1)
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            alone, low, high, gram, doc = (np.repeat(x, times) for x in (alone, low, high, gram, doc))
            low = np.where(alone, low + within, low)
            high = np.where(alone, low, high)
            words = words_at(chunk.body)
            own = gram[alone]
            for offset in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                own = mixed(own + words[low[alone] + offset])
            gram[alone] = own
        seen: dict[bytes, int] = {}
        raw = chunk.raw
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(low.tolist(), (high + LENGTH).tolist())], dtype=np.int64)
        n = len(seen)
        first = np.full(n, NO_ID, dtype=np.int64)
        np.minimum.at(first, which, doc)
        grams = np.zeros(n, dtype=np.uint64)
        grams[which] = gram
        order, self.shards, self.cuts = by_bucket(bucket_of(grams, shards))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        texts = list(seen)
        self.texts = [texts[i] for i in order]
        self.grams, self.docs = grams[order], first[order]
        self.low, self.piece, self.least = low, place[which], doc == first[which]
        self.counts = np.array([len(t) - LENGTH + 1 for t in self.texts], dtype=np.int64)


def _send_pieces(buckets: int, shards: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers").to_pylist()
            for number, chunk, answer in zip(batch.column("chunk").to_pylist(), Chunk.rows(batch), answers):
                sent = Sent(chunk, answer, buckets, shards)
                spans = list(zip(sent.cuts, sent.cuts[1:])) if len(sent.shards) else []
                ends = [np.cumsum([len(t) for t in sent.texts[a:b]], dtype=np.int32).tobytes() for a, b in spans]
                columns = [
                    [b"".join(sent.texts[a:b]) for a, b in spans],
                    ends,
                    [sent.grams[a:b].tobytes() for a, b in spans],
                    [sent.docs[a:b].tobytes() for a, b in spans],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(spans), number)), pa.array(sent.shards.astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]],
                    ["chunk", "bucket", "pieces", "ends", "grams", "docs"],
                )

    return over


def repeated_strings(pieces: list[bytes], docs: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    """For each piece, and each string of ``LENGTH`` bytes in it, whether it occurs in a piece with a smaller document."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in pieces], dtype=np.int64)
    texts = list(number)
    first = np.full(len(texts), NO_ID, dtype=np.int64)
    np.minimum.at(first, which, docs)
    gram = np.zeros(len(texts), dtype=np.uint64)
    gram[which] = grams
    _, of, times = np.unique(gram, return_inverse=True, return_counts=True)
    strings = np.array([len(t) - LENGTH + 1 for t in texts])
    least = [np.full(n, d) for n, d in zip(strings.tolist(), first.tolist())]
    sorted_ = np.flatnonzero(times[of] > 1)
    if len(sorted_):
        sizes = np.array([len(texts[i]) for i in sorted_])
        body = np.frombuffer(b"".join(texts[i] for i in sorted_), dtype=np.uint8)
        start = np.cumsum(sizes) - sizes
        owner = np.full(len(body), -1, dtype=np.int64)
        rows = np.repeat(np.arange(len(sorted_)), strings[sorted_])
        within = np.arange(len(rows)) - np.repeat(np.cumsum(strings[sorted_]) - strings[sorted_], strings[sorted_])
        owner[start[rows] + within] = rows
        order = suffix_order(body.astype(np.int64) + 1, LENGTH)
        order = order[owner[order] >= 0]
        heads = np.flatnonzero(np.concatenate([[True], ~equal_neighbours(body, order, LENGTH)]))
        doc = first[sorted_][owner[order]]
        smallest = np.empty(len(body), dtype=np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(order))))
        for i, at in zip(sorted_.tolist(), start.tolist()):
            least[i] = smallest[at : at + strings[i]]
    return [least[i] < d for i, d in zip(which.tolist(), docs.tolist())]


def _sort_shard(table: pa.Table) -> list[bytes]:
    pieces, sizes = [], []
    for raw, ends in zip(table.column("pieces").to_pylist(), table.column("ends").to_pylist()):
        ends = np.frombuffer(ends, dtype=np.int32).tolist()
        pieces += [raw[a:b] for a, b in zip([0, *ends], ends)]
        sizes.append(len(ends))
    docs = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("docs").to_pylist()])
    grams = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()])
    got = repeated_strings(pieces, docs, grams)
    ends = np.cumsum(sizes).tolist()
    # How many pieces an answer is for, then their bits.
    return [n.to_bytes(4, "little") + np.packbits(np.concatenate(got[e - n : e])).tobytes() for e, n in zip(ends, sizes)]


def covered(chunk: Chunk, sent: Sent, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a chunk a repeated string covers; ``bits`` has one for each string of each sent piece."""
    start = np.cumsum(sent.counts) - sent.counts
    times = sent.counts[sent.piece]
    rows = np.repeat(np.arange(len(sent.low)), times)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    # All but the first document of a piece lose all its strings.
    gone = ~sent.least[rows] | bits[start[sent.piece[rows]] + within].astype(bool)
    at = (sent.low[rows] + within)[gone]
    n = len(chunk.body) + 1
    return np.cumsum(np.bincount(at, minlength=n)[:n] - np.bincount(at + LENGTH, minlength=n)[:n])[:-1] > 0


def _remove(buckets: int, shards: int, keep_text: bool):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, found = batch.column("grams").to_pylist(), batch.column("answers").to_pylist()
            for chunk, about, got in zip(Chunk.rows(batch), answers, found):
                sent = Sent(chunk, about, buckets, shards)
                yield _cut(chunk, covered(chunk, sent, _answer_bits(got or [], sent.counts)), keep_text)

    return over


def _answer_bits(answers: list, counts: np.ndarray) -> np.ndarray:
    """One bit for each string of the sent pieces."""
    out, at = [], 0
    for a in answers:
        pieces = int.from_bytes(a["answer"][:4], "little")
        n = int(counts[at : at + pieces].sum())
        out.append(np.unpackbits(np.frombuffer(a["answer"][4:], dtype=np.uint8), count=n))
        at += pieces
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def _cut(chunk: Chunk, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[chunk.ends] - total[chunk.starts]
    heads = gone.copy()
    heads[1:] &= ~gone[:-1]
    begun = chunk.starts[chunk.sizes > 0]
    heads[begun] = gone[begun]
    runs = np.concatenate([[0], np.cumsum(heads)])
    kept = chunk.body[~gone].tobytes()
    ends = np.cumsum(chunk.sizes - removed).tolist()
    parts = [kept[a:b] for a, b in zip([0, *ends], ends)]
    columns = {
        "doc_id": pa.array(chunk.ids, pa.int64()),
        "n_bytes": pa.array(chunk.sizes),
        "n_removed": pa.array(removed),
        "n_spans": pa.array(runs[chunk.ends] - runs[chunk.starts]),
        "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
    }
    if keep_text:
        columns["kept"] = pa.array(parts, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, keep_text: bool = False, size: int = CHUNK, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """One row per document: its bytes, how many went in how many runs, and a digest of the rest (and the rest itself)."""
    chunks = chunked(docs, size)
    partitions = chunks.buckets
    total = chunks.rows.agg(F.sum(F.length("body"))).first()[0] or 0
    # One string in about thirteen is the first with its gram.
    buckets = max(partitions, int(total / 13 * 8 / BUCKET))
    asked = chunks.rows.mapInArrow(_ask_grams(buckets), "chunk long, bucket int, keys binary, several binary")
    counted = durable(answered(asked, _count_grams(hot)))
    shards = max(4 * partitions, int(total / shard))
    schema = "chunk long, bucket int, pieces binary, ends binary, grams binary, docs binary"
    pieces = told(chunks.rows, counted).mapInArrow(_send_pieces(buckets, shards), schema)
    found = answered(pieces, _sort_shard)
    both = told(told(chunks.rows, counted).withColumnRenamed("answers", "grams"), found)
    result = durable(both.mapInArrow(_remove(buckets, shards, keep_text), RESULT + (", kept binary" if keep_text else "")))
    chunks.drop()
    return result


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """The digest of ``without_repeats`` for all documents."""
    return without_repeats(docs)
