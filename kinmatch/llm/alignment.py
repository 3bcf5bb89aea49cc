"""Alignment of two tokenizers' tokens, and which pairs of tokens stand for each other in a corpus.

``A`` is a byte-level BPE, ``B`` a SentencePiece model.  Both cut the bytes of a text; where a token of each
ends at the same byte, there is a cut, and the tokens between two cuts are a group.  All pairs of
an A and a B token of a group are links.

Merging.  One pair of state vectors holds, for each lane, how far A and B have come.  At each step all lanes compare the
ends of their two tokens: the one that ends first goes on, equal ends emit a cut and both go on, and finished
lanes are taken out of the vectors.  A lane is a document, or ``LANE`` consecutive words of a long one, so that a single
long text does not keep the vectors waiting.

Words.  Before a space that follows another character than white space both tokenizers cut, so a chunk encodes each
distinct word once.

Counts.  A chunk of documents asks for the pairs that it holds, each once, with how many of its documents hold it; buckets add
up (``chunks.answered``), so a pair in a third of all documents costs a row per chunk.  The highest count
of each A id is one number per entry of the vocabulary, which bounds the one thing that is broadcast besides the
vocabularies.  Texts are never moved, only encoded where they are read.

Defined results: texts that are null or empty, or that the tokens' bytes do not spell, have no tokens: zeros, an
empty digest, and nothing in the counts.  A null id is a document like others; rows with the same id count as documents each
on their own; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.buckets import Bucketed
from kinmatch.llm.chunks import BUCKET, answered, by_bucket, told
from kinmatch.llm.common import mixed, packed, slices, unpacked
from kinmatch.session import durable

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text in a chunk.
CHARS = 1_500_000
#: Words of a lane.
LANE = 256
#: Links that are spread out at a time.
LINKS = 2_000_000
#: Bytes of a count of documents.
COUNT = 5

#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = re.compile(f"(?s).[^ ]*(?:(?<=[{WHITE}]) [^ ]*)*")


@dataclass
class Tokenizers:
    """Both tokenizers by the contents of their files, so that workers need no path."""

    byte_file: str
    piece_file: bytes

    @classmethod
    def load(cls, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> Tokenizers:
        with open(byte_model, encoding="utf-8") as a, open(piece_model, "rb") as b:
            return cls(a.read(), b.read())

    @cached_property
    def a(self):
        import os

        # Tasks share the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.byte_file)
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.piece_file)

    @cached_property
    def a_bytes(self) -> list[bytes]:
        """The bytes of each A token; byte-level vocabularies write the bytes that are not printable as characters from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
        vocabulary = self.a.get_vocab()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        return out

    @cached_property
    def b_bytes(self) -> list[bytes]:
        def surface(i: int) -> bytes:
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                return bytes([int(piece[3:5], 16)])
            return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

        return [surface(i) for i in range(self.b.get_piece_size())]

    def words(self, words: list[str]) -> tuple[Side, Side, np.ndarray]:
        """A and B tokens of words, which start with a space, and which words both spell."""
        lead = len(self.b.encode("x"))
        a = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)]
        b = [ids[lead:] for ids in self.b.encode(["x" + w for w in words], num_threads=1)]
        sides = Side(a, self.a_bytes), Side(b, self.b_bytes)
        raw = [w.encode() for w in words]
        return *sides, sides[0].spells(raw) & sides[1].spells(raw)


class Side:
    """Tokens of words: all ids, their sizes in bytes, and how many each word has."""

    def __init__(self, ids: list[list[int]], surfaces: list[bytes]):
        self.surfaces = surfaces
        self.ids = np.fromiter(chain.from_iterable(ids), dtype=np.int64)
        self.counts = np.array([len(x) for x in ids], dtype=np.int64)
        self.sizes = np.array([len(x) for x in surfaces], dtype=np.int64)[self.ids]
        self.starts = np.cumsum(self.counts) - self.counts

    def spells(self, words: list[bytes]) -> np.ndarray:
        """Which words the bytes of their tokens are equal to."""
        total = np.concatenate([[0], np.cumsum(self.sizes)])
        size = total[self.starts + self.counts] - total[self.starts]
        same = size == np.array([len(w) for w in words], dtype=np.int64)
        tokens = self.ids[np.repeat(same, self.counts)].tolist()
        made = np.frombuffer(b"".join(map(self.surfaces.__getitem__, tokens)), dtype=np.uint8)
        wanted = np.frombuffer(b"".join(w for w, ok in zip(words, same.tolist()) if ok), dtype=np.uint8)
        of = np.flatnonzero(same)
        same[of[np.searchsorted(np.cumsum(size[of]), np.flatnonzero(made != wanted), side="right")]] = False
        return same

    def stream(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the words ``which``, the byte at which each ends, and each word's first token."""
        times = self.counts[which]
        first = np.cumsum(times) - times
        at = np.repeat(self.starts[which] - first, times) + np.arange(times.sum())
        return self.ids[at], np.cumsum(self.sizes[at]), first


def merged(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of all lanes in order: first and last A token (the last excluded), first and last B token.

    Lanes are given by their A tokens and first B token; the last tokens of a lane end together.
    """
    a, b, stop = a_from.copy(), b_from.copy(), a_to
    group_a, group_b = a.copy(), b.copy()
    cuts = [np.zeros((0, 4), dtype=np.int64)]
    while len(a):
        x, y = a_ends[a], b_ends[b]
        cut = x == y
        a = a + (x <= y)
        b = b + (y <= x)
        cuts.append(np.stack([group_a[cut], a[cut], group_b[cut], b[cut]], axis=1))
        group_a, group_b = np.where(cut, a, group_a), np.where(cut, b, group_b)
        going = a < stop
        if not going.all():
            a, b, stop, group_a, group_b = a[going], b[going], stop[going], group_a[going], group_b[going]
    found = np.concatenate(cuts)
    return tuple(found[np.argsort(found[:, 0])].T)


def links(groups: tuple[np.ndarray, ...], most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A and B tokens of all links, some groups at a time."""
    a0, a1, b0, b1 = groups
    sizes = (a1 - a0) * (b1 - b0)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + most)))
        n = sizes[at:end]
        group = np.repeat(np.arange(at, end), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = np.divmod(within, (b1 - b0)[group])
        yield a0[group] + x, b0[group] + y
        at = end


class Aligned:
    """The tokens, groups and links of some texts."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None]):
        words = [WORD.findall(" " + t) if t else [] for t in texts]
        each = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        which = each.indices.to_numpy().astype(np.int64)
        a, b, spelt = tokenizers.words(each.dictionary.to_pylist())
        n = len(texts)
        counts = np.array([len(ws) for ws in words], dtype=np.int64)
        # A text with a word that is not spelt has no tokens.
        bad = np.zeros(n, dtype=bool)
        bad[np.repeat(np.arange(n), counts)[~spelt[which]]] = True
        which = which[np.repeat(~bad, counts)]
        counts[bad] = 0
        self.a, a_ends, a_first = a.stream(which)
        self.b, b_ends, b_first = b.stream(which)
        # Lanes start with a document and after every so many words of it.
        lane = np.flatnonzero((np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)) % LANE == 0)
        self.groups = merged(a_ends, b_ends, a_first[lane], np.append(a_first[lane[1:]], len(self.a)), b_first[lane])
        bounds = np.cumsum(np.concatenate([[0], counts]))
        a_bounds, b_bounds = np.append(a_first, len(self.a))[bounds], np.append(b_first, len(self.b))[bounds]
        self.n_a, self.n_b = np.diff(a_bounds), np.diff(b_bounds)
        self.group_bounds = np.searchsorted(self.groups[0], a_bounds)
        self.doc_of_a = np.repeat(np.arange(n), self.n_a)

    def pairs(self, b_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links, in this order, of each pair that a document holds."""
        bits = np.uint64(b_bits + max(1, int(self.a.max(initial=0)).bit_length()))
        keys, times = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for x, y in links(self.groups):
            key = (self.doc_of_a[x].astype(np.uint64) << bits) | (self.a[x].astype(np.uint64) << np.uint64(b_bits)) | self.b[y].astype(np.uint64)
            k, t = np.unique(key, return_counts=True)
            keys.append(k)
            times.append(t)
        key, count = np.concatenate(keys), np.concatenate(times)
        if len(keys) > 2:
            key, inverse = np.unique(key, return_inverse=True)
            count = np.bincount(inverse, count, len(key)).astype(np.int64)
        return (key >> bits).astype(np.int64), key & ((np.uint64(1) << bits) - np.uint64(1)), count

    def digests(self, a_shown: np.ndarray, b_shown: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups in text; ``shown`` has each id with a comma, then each with the end of its side."""
        a0, a1, b0, b1 = self.groups
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        for ids, shown, n, before in ((self.a, a_shown, a1 - a0, b0), (self.b, b_shown, b1 - b0, a1)):
            last = np.zeros(len(ids), dtype=np.int64)
            last[np.cumsum(n) - 1] = 1
            out[np.arange(len(ids)) + np.repeat(before, n)] = shown[ids + last * (len(shown) // 2)]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        starts = [0, *ends[:-1]]
        return [hashlib.sha256("".join(out[s:e].tolist())[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(starts, ends)]


STORED = (
    "ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "keys binary, n_pairs array<long>, which binary, times binary"
)


def _key_bytes(bits: int) -> int:
    return -(-bits // 8)


#: Tokenizers by their files, kept as long as a worker lives.
_worker: dict = {}


def _encode(shared, b_bits: int, width: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = shared.value
        name = (hash(tokenizers.byte_file), hash(tokenizers.piece_file))
        if name not in _worker:
            _worker.clear()
            _worker[name] = tokenizers
        tokenizers = _worker[name]
        shown = [np.array([f"{i}{e}" for e in ends for i in range(n)], dtype=object) for n, ends in ((len(tokenizers.a_bytes), ",|"), (len(tokenizers.b_bytes), ",;"))]
        for part in slices(batches, "text", CHARS):
            got = Aligned(tokenizers, part.column("text").to_pylist())
            doc, pair, times = got.pairs(b_bits)
            distinct, which = np.unique(pair, return_inverse=True)
            group_links = np.concatenate([[0], np.cumsum((got.groups[1] - got.groups[0]) * (got.groups[3] - got.groups[2]))])
            lists = [got.n_a, got.n_b, np.diff(got.group_bounds), np.diff(group_links[got.group_bounds])]
            n_pairs = np.bincount(doc, minlength=part.num_rows)
            longs = pa.list_(pa.int64())
            columns = [
                pa.array([part.column("doc_id").to_pylist()], longs),
                *[pa.array([x.tolist()], longs) for x in lists],
                pa.array([got.digests(*shown)], pa.list_(pa.string())),
                pa.array([packed(distinct, width)], pa.binary()),
                pa.array([n_pairs.tolist()], longs),
                pa.array([which.astype("<u4").tobytes()], pa.binary()),
                pa.array([times.astype("<u4").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in STORED.split(", ")])

    return over


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(keys + np.uint64(1)) >> np.uint64(33)).astype(np.int64) % buckets).astype(np.int32)


def _ask(buckets: int, width: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = unpacked(batch.column("keys")[i].as_py(), width)
                docs = np.bincount(np.frombuffer(batch.column("which")[i].as_py(), dtype="<u4"), minlength=len(keys))
                order, found, cuts = by_bucket(_bucket(keys, buckets))
                keys, docs = keys[order], docs[order].astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), batch.column("chunk")[i].as_py())),
                        pa.array(found.astype(np.int32)),
                        pa.array([packed(keys[a:b], width) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([docs[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["chunk", "bucket", "keys", "docs"],
                )

    return over


def _add(width: int):
    def answer(table: pa.Table) -> list[bytes]:
        keys = [unpacked(x, width) for x in table.column("keys").to_pylist()]
        docs = np.concatenate([np.frombuffer(x, dtype="<u4") for x in table.column("docs").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, inverse, docs.astype(np.int64))
        total = total[inverse].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        return [packed(total[e - len(k) : e], COUNT) for e, k in zip(ends, keys)]

    return answer


def _counts(batch: pa.RecordBatch, i: int, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a stored chunk, and in how many documents of the corpus each is."""
    keys = unpacked(batch.column("keys")[i].as_py(), width)
    total = np.zeros(len(keys), dtype=np.int64)
    if len(keys):
        raw = b"".join(a["answer"] for a in batch.column("answers")[i].as_py())
        total[by_bucket(_bucket(keys, buckets))[0]] = unpacked(raw, COUNT).astype(np.int64)
    return keys, total


def _highest(buckets: int, width: int, b_bits: int):
    """a, best: the highest count of each A id among the pairs of a task."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                keys, total = _counts(batch, i, buckets, width)
                ids, which = np.unique(keys >> np.uint64(b_bits), return_inverse=True)
                most = np.zeros(len(ids), dtype=np.int64)
                np.maximum.at(most, which, total)
                for a, n in zip(ids.tolist(), most.tolist()):
                    best[a] = max(best.get(a, 0), n)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["a", "best"])

    return over


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(shared, buckets: int, width: int, b_bits: int):
    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, total = _counts(batch, i, buckets, width)
                which = np.frombuffer(batch.column("which")[i].as_py(), dtype="<u4")
                times = np.frombuffer(batch.column("times")[i].as_py(), dtype="<u4").astype(np.int64)
                top = total == best[(keys >> np.uint64(b_bits)).astype(np.int64)] if len(keys) else np.zeros(0, dtype=bool)
                ends = np.cumsum(np.concatenate([[0], batch.column("n_pairs")[i].values.to_numpy()]))
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times * top[which], times * total[which])]
                columns = [batch.column(c)[i].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, sums), batch.column("groups")[i].values], [c.split(" ")[0] for c in RESULT.split(", ")])

    return over


def aligned(docs: DataFrame, tokenizers: Tokenizers | None = None) -> DataFrame:
    """One row per document: tokens, groups, links, links of the commonest B for their A, and the sum of the links' counts."""
    spark = docs.sparkSession
    tokenizers = tokenizers or Tokenizers.load()
    vocabulary = len(tokenizers.a_bytes), len(tokenizers.b_bytes)
    b_bits = max(1, (vocabulary[1] - 1).bit_length())
    width = _key_bytes(b_bits + max(1, (vocabulary[0] - 1).bit_length()))
    shared = spark.sparkContext.broadcast(Tokenizers(tokenizers.byte_file, tokenizers.piece_file))  # two files of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(shared, b_bits, width), STORED)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = Bucketed(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunk", partitions)
    total = chunks.rows.agg(F.sum(F.length("keys"))).first()[0] or 0
    buckets = max(partitions, int(total / BUCKET))
    asked = chunks.rows.select("chunk", "keys", "which").mapInArrow(_ask(buckets, width), "chunk long, bucket int, keys binary, docs binary")
    found = durable(answered(asked, _add(width)))
    # At most one row for each id of the vocabulary.
    highest = told(chunks.rows.select("chunk", "keys"), found).mapInArrow(_highest(buckets, width, b_bits), "a int, best long")
    best = np.zeros(vocabulary[0], dtype=np.int64)
    for r in highest.groupBy("a").agg(F.max("best").alias("best")).collect():
        best[r["a"]] = r["best"]
    result = durable(told(chunks.rows, found).mapInArrow(_score(spark.sparkContext.broadcast(best), buckets, width, b_bits), RESULT))
    chunks.drop()
    return result
