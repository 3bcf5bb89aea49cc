"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

A byte-pair model of the SentencePiece kind joins adjacent symbols, the best-scored and
then leftmost pair first.  With dropout, a candidate that comes up is skipped when a
keyed hash of its number in the stretch falls below the dropout rate; it stays skipped unless
a neighbour changes.  The key is made of a seed, the document's id and text, the number of
the copy, the place of the stretch in the text and the stretch itself, so that every
occurrence of a word is drawn on its own, while a retried task gives the same pieces and
another seed others.

Pieces never cross the start of a run of spaces nor a line end, so a text is a list of
independent stretches.  The draws of a stretch alone decide its pieces, so a worker keeps (bounded) a tree of draws
for each stretch that it has met: a node for each candidate that came up, with a branch if it was kept and
one if it was dropped.  All places of a slice of texts walk down together, a draw at each node, and those that come to
a branch not taken yet are encoded together: a padded
matrix of symbols in which every text takes its best candidate at each step.  Very long stretches go through an agenda of their own
(``one_stretch``), with the same result.

Any text decodes to itself: characters without a piece, and the character that stands for
a space in pieces, are written as bytes.

Both directions are maps over all rows without a shuffle; only the vocabulary, of fixed
size, is broadcast.  The model file is read on the driver.

Defined results: a null text has null ids and decodes to null; an empty one has no
ids; a null document id counts as an empty text in the key; repeated rows get the same
ids unless a column numbers them; an empty table gives an empty one; extra columns are left alone.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from kinmatch.llm.common import fresh, mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 11
DROPOUT = 0.1
VARIANTS = 1 << 64
#: Stretches longer than this go through the agenda one by one.
WIDEST = 64
#: Stretches, of about the same length, that are encoded together.
BLOCK = 4096
#: So few places at new branches are encoded each by itself, and not kept.
FEW = 300
#: Stretches that a worker keeps, and branches of their trees or ids at their ends.
CACHE = 300_000
BRANCHES = 8_000_000

SPACE_MARK = "▁"
#: A place without a candidate; others have the rank of their piece and, in the lowest bits, the place itself.
NONE = 1 << 30
PLACE_BITS = 7
#: A branch not taken yet; others lead to a node (0 and above) or to the ids that end there (below).
UNKNOWN = -1
WORD64 = (1 << 64) - 1

#: Odd numbers for the fields of a key.
FIELDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def skipped(key: np.ndarray, step: int | np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate that comes up at a step is dropped."""
    if isinstance(step, int):
        draw = np.uint64((step + 1) * FIELDS[0] & WORD64)
    else:
        draw = (step.astype(np.uint64) + np.uint64(1)) * np.uint64(FIELDS[0])
    return (mixed(key + draw) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


@dataclass
class Pieces:
    """A vocabulary: every piece, its score, and the ids of the pieces for single bytes."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    byte_ids: dict[int, int]
    prefix: bool = True

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte_ids) < 256:
            raise ValueError("the model has no pieces for bytes, so not every text could be decoded")
        prefix = sp.encode("a", out_type=str)[0].startswith(SPACE_MARK)
        return cls(names, [sp.get_score(i) for i in range(n)], [not s for s in special], byte_ids, prefix)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.plain[i]}

    @cached_property
    def symbols(self) -> dict[str, int]:
        """Symbol of each character that occurs in a piece; a space stands for its mark."""
        out = {}
        for piece in self.ids:
            for c in piece:
                out.setdefault(c, self.ids.get(c, len(self.pieces) + len(out)))
        space = out.pop(SPACE_MARK, None)
        return out if space is None else {**out, " ": space}

    @cached_property
    def symbol_table(self) -> np.ndarray:
        """The symbol of each code point."""
        out = np.full(0x110000, self.unknown, dtype=np.int32)
        for c, symbol in self.symbols.items():
            out[ord(c)] = symbol
        return out

    @cached_property
    def unknown(self) -> int:
        """The symbol of characters in no piece; it is above all others and never joined."""
        return len(self.pieces) + len(self.symbols) + 1

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs of symbols that form a piece, as one number, and that piece."""
        symbol = {**self.ids, **{(SPACE_MARK if c == " " else c): s for c, s in self.symbols.items()}}
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * (self.unknown + 1) + b] = i
        keys = np.array(sorted(pairs), dtype=np.int64)
        return keys, np.array([pairs[int(k)] for k in keys], dtype=np.int32)

    @cached_property
    def rank(self) -> np.ndarray:
        """Place of each piece in the order of scores, best first, equal scores alike."""
        return np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int32)

    @cached_property
    def order(self) -> np.ndarray:
        """Rank of each piece, above the bits of a place, and at the end, for -1, ``NONE``."""
        if self.rank.max(initial=0) >= NONE >> PLACE_BITS:
            raise ValueError("the model has too many pieces")
        return np.append(self.rank << PLACE_BITS, NONE).astype(np.int32)

    @cached_property
    def byte_table(self) -> np.ndarray:
        """The id of each byte."""
        return np.array([self.byte_ids[b] for b in range(256)], dtype=np.int32)

    @cached_property
    def stretch(self) -> re.Pattern:
        """Runs of spaces with what follows them; characters in no piece end a stretch."""
        ends = "".join(c for c in "\n\t\r" if c not in self.symbols)
        safe = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        if not safe:
            return re.compile("(?s).+")
        one = f"|[{ends}]" if ends else ""
        return re.compile(f" *[^ {ends}]+| +{one}")

    @cached_property
    def surfaces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        single = {i: bytes([b]) for b, i in self.byte_ids.items()}
        return [single.get(i, p.replace(SPACE_MARK, " ").encode() if self.plain[i] else b"") for i, p in enumerate(self.pieces)]

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols forms, -1 for none."""
        keys, made = self.merges
        if not len(keys):
            return np.full(len(left), -1, dtype=np.int32)
        wanted = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, made[at], -1)

    def written(self, text: str, symbols: list[int], starts: list[int]) -> bytes:
        """The ids of final symbols as 32-bit numbers; symbols without a piece become bytes."""
        out = []
        for s, a in zip(symbols, starts):
            if s < len(self.pieces):
                out.append(s)
            else:
                out.extend(self.byte_ids[b] for b in text[a].encode())
        return np.array(out, dtype="<i4").tobytes()

    def one_stretch(self, text: str, key: int, rate: float) -> bytes:
        """Ids of one stretch, by an agenda of candidates."""
        n = len(text)
        symbols = [self.symbols.get(c, self.unknown) for c in text]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            pairs = [(i, after[i]) for i in lefts if i >= 0 and after[i] < n]
            if not pairs:
                return
            made = self.joined(np.array([symbols[i] for i, _ in pairs]), np.array([symbols[j] for _, j in pairs]))
            for (i, j), piece in zip(pairs, made.tolist()):
                if piece >= 0:
                    heapq.heappush(agenda, (int(self.rank[piece]), i, symbols[i], symbols[j], piece))

        offer(list(range(n)))
        alive = [True] * n
        keys = np.array([key], dtype=np.uint64)
        step = -1
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            # Candidates whose symbols have been joined meanwhile are stale.
            if not alive[i] or symbols[i] != left or j >= n or symbols[j] != right:
                continue
            step += 1
            if rate > 0 and skipped(keys, step, rate)[0]:
                continue
            symbols[i], alive[j], after[i] = piece, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        places = [i for i in range(n) if alive[i]]
        return self.written(text, [symbols[i] for i in places], places)

    def many_stretches(self, texts: list[str], keys: np.ndarray, rate: float) -> list[bytes]:
        """Ids of many stretches of at most ``WIDEST`` characters, all at once."""
        ids, counts, _ = self.stepped(texts, keys, rate)
        raw, ends = ids.tobytes(), np.cumsum(counts).tolist()
        return [raw[4 * (e - c) : 4 * e] for e, c in zip(ends, counts.tolist())]

    def stepped(self, texts: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many stretches one after the other, how many each has, and how many candidates came up in each."""
        n, sizes = len(texts), np.array([len(t) for t in texts])
        width = int(sizes.max())
        # A matrix, flat, with a row for each place, and one more at both ends, and a column for each text.
        rows = np.repeat(np.arange(n), sizes)
        line = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        cells = line * n + rows
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = np.full((width + 2) * n, self.unknown, dtype=np.int32)
        symbols[cells] = self.symbol_table[codes]
        lines = np.repeat(np.arange(width + 2, dtype=np.int32), n)
        after, before = np.arange(len(symbols)) + n, np.arange(len(symbols)) - n
        gone = np.zeros(len(symbols), dtype=bool)
        # Candidate at each left place: the piece, and its order.
        made = np.full(len(symbols), -1, dtype=np.int32)
        order = np.full(len(symbols), NONE, dtype=np.int32)
        orders = order.reshape(width + 2, n)

        def offer(left: np.ndarray) -> None:
            piece = self.joined(symbols[left], symbols[after[left]])
            made[left] = piece
            order[left] = self.order[piece] + lines[left]

        offer(cells)
        steps = np.zeros(n, dtype=np.int64)
        step = -1
        while True:
            best = orders.min(0)
            active = np.flatnonzero(best < NONE)
            if not len(active):
                break
            step += 1
            steps[active] += 1
            i = (best[active] & (1 << PLACE_BITS) - 1).astype(np.int64) * n + active
            if rate > 0:
                drop = skipped(keys[active], step, rate)
                order[i[drop]] = NONE
                i = i[~drop]
            j = after[i]
            symbols[i] = made[i]
            gone[j] = True
            order[j] = NONE
            further = after[j]
            after[i] = further
            before[further] = i
            offer(np.concatenate([before[i], i]))
        kept = ~gone[cells]
        ids, rows = symbols[cells[kept]], rows[kept]
        odd = ids >= len(self.pieces)
        if odd.any():
            # Symbols without a piece become bytes.
            codes = codes[kept]
            times = np.where(odd, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
            ids, rows = np.repeat(ids, times), np.repeat(rows, times)
            raw = codes[odd].tobytes().decode("utf-32-le").encode()
            ids[np.repeat(odd, times)] = self.byte_table[np.frombuffer(raw, dtype=np.uint8)]
        return ids, np.bincount(rows, minlength=n), steps

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        return self._text(raw)

    def _text(self, raw: bytes) -> str:
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> list[str | None]:
        """``decode`` of each list of ids, null for null, with the bytes of all looked up at once."""
        flat, sizes = lists.flatten(), lists.value_lengths()
        if flat.null_count:
            raise ValueError("a token id is null")
        ends = np.cumsum(np.concatenate([[0], sizes.fill_null(0).to_numpy(zero_copy_only=False)]))
        taken = pa.array(self.surfaces, pa.binary()).take(flat)
        if not len(flat):
            return [None if n is None else "" for n in sizes.to_pylist()]
        _, offsets, body = taken.buffers()
        at = np.frombuffer(offsets, dtype="<i4")[taken.offset :][ends].tolist()
        view = memoryview(body or b"")
        return [None if n is None else self._text(bytes(view[a:b])) for n, a, b in zip(sizes.to_pylist(), at, at[1:])]


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.all, self.size = np.empty(1 << 12, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.all):
            longer = np.empty(max(end, 2 * len(self.all)), dtype=self.all.dtype)
            longer[: self.size] = self.all[: self.size]
            self.all = longer
        self.all[self.size : end] = values
        self.size = end


class Encoder:
    """A worker's encoder, with the stretches it has met."""

    def __init__(self, pieces: Pieces, seed: int, rate: float):
        self.pieces, self.seed, self.rate = pieces, seed, rate
        #: The number of each stretch; by number its CRC-32 and where its tree begins, -1 for a very long one.
        self.numbers: defaultdict[str, int] = defaultdict(count().__next__)
        self.crcs, self.roots = Grown(np.uint64), Grown(np.int64)
        #: Where each branch leads. A node is two branches: if its candidate is kept, and if it is dropped.
        self.branches = Grown(np.int32)
        #: The ids at the ends of branches, and where each of them ends.
        self.ids, self.ends = Grown(np.int32), Grown(np.int64)
        self.ends.add(np.zeros(1, dtype=np.int64))

    def _keys(self, variant: int, stretches: list[str]) -> np.ndarray:
        """Keys of a text's stretches, by the key of the text and their places."""
        crc = np.array([zlib.crc32(s.encode()) for s in stretches], dtype=np.uint64)
        return self._placed(np.full(len(stretches), variant, dtype=np.uint64), np.arange(len(stretches)), crc)

    def _placed(self, variants: np.ndarray, places: np.ndarray, crc: np.ndarray) -> np.ndarray:
        base = mixed(variants * np.uint64(FIELDS[1]) + np.uint64(self.seed * FIELDS[0] & WORD64))
        return mixed(mixed(base + places.astype(np.uint64) * np.uint64(FIELDS[0])) + crc * np.uint64(FIELDS[2]))

    def _number(self, flat: list[str]) -> np.ndarray:
        """The numbers of stretches; a very long one has its number for this time only."""
        met = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
        new = list(islice(self.numbers, met, None))
        self.crcs.add(np.array([zlib.crc32(s.encode()) for s in new], dtype=np.uint64))
        long = np.array([len(s) > WIDEST for s in new], dtype=bool)
        self.roots.add(np.where(long, -1, self.branches.size + np.arange(len(new))))
        self.branches.add(np.full(len(new), UNKNOWN))
        for k in np.flatnonzero(long).tolist():
            del self.numbers[new[k]]
        return number

    def encode(self, texts: list[str | None], variants: list[int]) -> list[bytes | None]:
        """Ids of each text as 32-bit numbers; ``variants`` has a key of 64 bits for each text."""
        if len(self.numbers) > CACHE or max(self.branches.size, self.ids.size) > BRANCHES:
            self.__init__(self.pieces, self.seed, self.rate)
        lead = " " if self.pieces.prefix else ""
        find = self.pieces.stretch.findall
        cut = [find(lead + t) if t else [] for t in texts]
        flat = [s for stretches in cut for s in stretches]
        number = self._number(flat)
        sizes = np.array([len(s) for s in cut], dtype=np.int64)
        lasts = np.cumsum(sizes)
        of_text = np.repeat(np.array([v & WORD64 for v in variants], dtype=np.uint64), sizes)
        keys = self._placed(of_text, np.arange(len(flat)) - np.repeat(lasts - sizes, sizes), self.crcs.all[number])
        at, kept = self._ends(flat, self.roots.all[number], keys)
        starts, counts = self.ends.all[at], self.ends.all[at + 1] - self.ends.all[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        raw = self.ids.all[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], counts)].astype("<i4").tobytes()
        # What no branch leads to is not kept.
        self.ids.size, self.ends.size = kept
        first, last = 4 * upto[lasts - sizes], 4 * upto[lasts]
        return [None if t is None else raw[a:b] for t, a, b in zip(texts, first.tolist(), last.tolist())]

    def _ends(self, flat: list[str], branches: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        """Where in ``ends`` the ids of each stretch are, and how much of ``ids`` and ``ends`` is to be kept."""
        out = np.zeros(len(flat), dtype=np.int64)
        own = np.flatnonzero(branches < 0)
        steps = np.zeros(len(flat), dtype=np.int64)
        left = self._walk(np.flatnonzero(branches >= 0), branches, steps, keys, out)
        while len(left) > FEW:
            # One of the places at each new branch is encoded; the others get further, and may differ there.
            first = np.unique(branches[left], return_index=True)[1]
            self._grow(left[first], flat, branches, steps, keys, out)
            left = self._walk(np.delete(left, first), branches, steps, keys, out)
        kept = self.ids.size, self.ends.size
        self._encoded(left, flat, keys, out)
        for k in own.tolist():
            ids = np.frombuffer(self.pieces.one_stretch(flat[k], int(keys[k]), self.rate), dtype="<i4")
            out[k] = self._add(ids, np.array([len(ids)]))[0]
        return out, kept

    def _walk(self, left: np.ndarray, branches: np.ndarray, steps: np.ndarray, keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Lead places down to their ids, or to a branch not taken yet; those places are returned."""
        new = []
        at, step, key = branches[left], steps[left], keys[left]
        while len(left):
            to = self.branches.all[at]
            more = to >= 0
            end = np.flatnonzero(~more)
            if len(end):
                out[left[end]] = -2 - to[end]
                end = end[to[end] == UNKNOWN]
                branches[left[end]], steps[left[end]] = at[end], step[end]
                new.append(left[end])
                left, step, key, to = left[more], step[more], key[more], to[more]
            at = to + skipped(key, step, self.rate)
            step = step + 1
        return np.sort(np.concatenate(new)) if new else left

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Append ids to ``ids``; where in ``ends`` each of them is."""
        at = self.ends.size - 1 + np.arange(len(counts))
        self.ends.add(self.ids.size + np.cumsum(counts))
        self.ids.add(ids)
        return at

    def _encoded(self, places: np.ndarray, flat: list[str], keys: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Encode stretches at places, and put in ``out`` where their ids are; how many candidates came up in each."""
        texts = [flat[k] for k in places.tolist()]
        steps = np.zeros(len(texts), dtype=np.int64)
        order = np.argsort(np.array([len(t) for t in texts], dtype=np.int64), kind="stable")
        for start in range(0, len(texts), BLOCK):
            block = order[start : start + BLOCK]
            ids, counts, steps[block] = self.pieces.stepped([texts[k] for k in block.tolist()], keys[places[block]], self.rate)
            out[places[block]] = self._add(ids, counts)
        return steps

    def _grow(self, places: np.ndarray, flat: list[str], branches: np.ndarray, steps: np.ndarray, keys: np.ndarray, out: np.ndarray) -> None:
        """Encode stretches whose draws led to different new branches, and put nodes for their further draws there."""
        depth = steps[places]
        nodes = self._encoded(places, flat, keys, out) - depth
        ends = -2 - out[places]
        first = np.cumsum(nodes) - nodes
        of = np.repeat(np.arange(len(places)), nodes)
        within = np.arange(len(of)) - first[of]
        node = self.branches.size + 2 * np.arange(len(of))
        taken = node + skipped(keys[places[of]], depth[of] + within, self.rate)
        self.branches.all[branches[places]] = np.where(nodes > 0, self.branches.size + 2 * first, ends)
        self.branches.add(np.full(2 * len(of), UNKNOWN))
        self.branches.all[taken] = np.where(within + 1 < nodes[of], node + 2, ends[of])


#: The encoder of each model, seed and rate, kept as long as a worker lives.
_worker: dict = {}


def _encoder(pieces: Pieces, seed: int, rate: float) -> Encoder:
    name = (zlib.crc32("\n".join(pieces.pieces).encode()), len(pieces.pieces), pieces.prefix, hash(tuple(pieces.scores)), seed, rate)
    if name not in _worker:
        _worker.clear()
        _worker[name] = Encoder(pieces, seed, rate)
    return _worker[name]


def _list_array(encoded: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if e is None else len(e) // 4 for e in encoded], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(e for e in encoded if e), dtype="<i4"))
    empty = np.array([e is None for e in encoded])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(empty) if empty.any() else None)


def encode(
    docs: DataFrame,
    pieces: Pieces,
    name: str = "ids",
    seed: int = SEED,
    rate: float = DROPOUT,
    variants: int = VARIANTS,
    doc_id: str = "doc_id",
    text: str = "text",
    copy: str | None = None,
) -> DataFrame:
    """``docs`` with an array column of token ids; ``copy`` names a column that numbers the copies of a row.

    The key of a text is one of ``variants``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    columns = [c for c in docs.columns if c != name]

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        encoder = _encoder(shared.value, seed, rate)
        for part in slices(batches, text):
            own = ["" if i is None else str(i) for i in part.column(doc_id).to_pylist()]
            times = part.column(copy).to_pylist() if copy else [1] * len(own)
            texts = part.column(text).to_pylist()
            keys = [f"{seed}:{i}:{n}:{zlib.crc32((t or '').encode())}" for i, n, t in zip(own, times, texts)]
            got = encoder.encode(texts, [xxh64_intdigest(k) % variants for k in keys])
            yield pa.RecordBatch.from_arrays([*part.columns, _list_array(got)], [*part.schema.names, name])

    base = docs.select(*[F.col(f"`{c}`") for c in columns])
    schema = StructType([*base.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return base.mapInArrow(over, schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text that an array of token ids stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    columns = [c for c in rows.columns if c != name]

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = pa.array(model.decode_lists(batch.column(ids)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    base = rows.select(*[F.col(f"`{c}`") for c in columns])
    return base.mapInArrow(over, StructType([*base.schema.fields, StructField(name, StringType())]))


def tokens(docs: DataFrame, pieces: Pieces | None = None, copy: str | None = None) -> DataFrame:
    """doc_id, source, lang, number of tokens and the ids: the corpus as a trainer reads it."""
    name = fresh(docs, "ids")
    rows = encode(docs, pieces or Pieces.load(), name, copy=copy)
    return rows.select("doc_id", "source", "lang", F.coalesce(F.size(name), F.lit(0)).alias("n_tokens"), F.col(name).alias("ids"))


def segmentations(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """One row per document: token count, a digest of the ids, and whether they decode to the text."""
    pieces = pieces or Pieces.load()
    back = decode(encode(docs.select("doc_id", "text"), pieces), pieces)
    return back.select(
        "doc_id",
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
