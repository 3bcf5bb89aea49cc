"""Suffix order and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from kinmatch.llm import suffix_dedup
from kinmatch.llm.suffixes import suffix_order

DOC = "doc_id long, text string, chunk long, bucket int, answers string"


def test_suffixes_in_order_to_a_depth():
    rng = np.random.default_rng(0)
    for n in [*range(30), 500]:
        for symbols in (1, 2, 6):
            for depth in (1, 3, 4, 10, 50, 10**6):
                s = rng.integers(1, symbols + 1, n)
                order = suffix_order(s, depth)
                starts = [tuple(s[i : i + depth].tolist()) for i in order]
                assert sorted(order.tolist()) == list(range(n)) and starts == sorted(starts)


def plain(rows):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for at in range(len(raw) - 49):
            key = raw[at : at + 50]
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 49):
            if first[raw[at : at + 50]] < (1 << 69 if i is None else i):
                gone[at : at + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choice("abcdé 漢\n") for _ in range(n))

    shared = [prose(n) for n in (49, 50, 51, 80, 300, 700)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 200, "ab" * 120, "ab" * 40]
    for _ in range(60):
        parts = [prose(rng.randint(0, 120)) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    texts += [texts[9], texts[10], texts[11][:-3] + "zz", "q" + texts[12], prose(5000), "x" * 49]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, texts[20]), (None, texts[20]), (30, texts[31]), (5, texts[40])]


@pytest.mark.parametrize(("size", "hot"), [(4_000_000, 4096), (1500, 4096), (1500, 2)])
def test_what_repeats_goes(spark, size, hot):
    rows = planted(size + hot)
    docs = spark.createDataFrame([(i, t, 1, 2, "") for i, t in rows], DOC).repartition(3)
    got = suffix_dedup.without_repeats(docs, size=size, hot=hot, shard=20_000).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == plain(rows)


def test_kept_bytes_and_an_empty_table(spark):
    rows = [(1, "a" * 60 + "b"), (2, "c" + "a" * 60)]
    docs = spark.createDataFrame([(i, t, 1, 2, "") for i, t in rows], DOC)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.without_repeats(docs, True).collect()} == {1: b"a" * 60 + b"b", 2: b"c"}
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    chunk = suffix_dedup.Chunk([1, 2], np.array([2000, 1000]), text.encode())
    cut = suffix_dedup.Pieces(chunk)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    whole = suffix_dedup.Pieces(chunk)

    def strings(pieces):
        return [(at, h, d) for a, b, h, d in zip(pieces.low.tolist(), pieces.high.tolist(), pieces.hash.tolist(), pieces.doc.tolist()) for at in range(a, b + 1)]

    assert strings(cut) == strings(whole) and len(strings(whole)) == 3000 - 2 * 49
