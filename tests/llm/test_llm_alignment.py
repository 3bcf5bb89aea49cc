"""Aligned tokens against plain walks over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinmatch.llm import alignment

DOC = "doc_id long, text string, chunk long, keys string, a int"


def odd_texts():
    rng = random.Random(4)
    words = ["cat", "don't", "naïve", "漢字", "x1y2", "…", "\U0001f469‍\U0001f4bb", "<|endoftext|>", "<s>", "</s>", "it's", "3.14"]
    words += ["#tag", "A", "zzzz", " ", "　b", "​", "é", "é", "ﬁ", "\x00", "\x1c", " ", " q", " "]
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t ", " \n", "", "\r\n", "   "]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    spaces = ["", " ", "  ", "\n", " a", "a ", "a  ", "  a", "a\n", "\na", "a \n b", "▁", "a ▁ b", "<unk>", "▁▁x"]
    return [None, *spaces, *made, made[3], "word " * 3000, "x" * 3000, "漢" * 700]


def plain(rows):
    """Groups of each text as lists of A and B ids."""
    tokenizers = alignment.Tokenizers.load()
    a_model = Tokenizer.from_file(alignment.BYTE_MODEL)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    out = []
    for text in rows:
        groups = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            raw = (" " + text).encode()
            if b"".join(tokenizers.a_bytes[i] for i in a) == raw and b"".join(tokenizers.b_bytes[i] for i in b) == raw:
                ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((tokenizers.a_bytes, a), (tokenizers.b_bytes, b))]
                both = sorted(set(ends[0]) & set(ends[1]))
                last = 0
                for cut in both:
                    groups.append(tuple([i for i, e in zip(ids, end) if last < e <= cut] for ids, end in zip((a, b), ends)))
                    last = cut
        out.append(groups)
    return out


def wanted(ids, texts):
    all_groups = plain(texts)
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in all_groups]
    count = Counter(p for pairs in links for p in set(pairs))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, groups, pairs in zip(ids, all_groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        sums = sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs)
        out.append((-1 if i is None else i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), *sums, digest))
    return sorted(out)


@pytest.mark.parametrize(("chars", "lane"), [(1_500_000, 256), (400, 3)])
def test_rows_are_those_of_a_plain_walk(spark, monkeypatch, chars, lane):
    texts = odd_texts()
    ids = [None if k % 9 == 8 else 7 if k % 10 == 0 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "", 2) for i, t in zip(ids, texts)], DOC).repartition(3)
    if lane != alignment.LANE:
        # Tasks run elsewhere: lanes and chunks of another size are tried here.
        monkeypatch.setattr(alignment, "LANE", lane)
        monkeypatch.setattr(alignment, "LINKS", 50)
        got = alignment.Aligned(alignment.Tokenizers.load(), texts)
        flat = [(got.a[p:q].tolist(), got.b[r:s].tolist()) for p, q, r, s in zip(*got.groups)]
        assert [flat[s:e] for s, e in zip(got.group_bounds, got.group_bounds[1:])] == plain(texts)
        doc, pair, times = got.pairs(15)
        assert sum(times.tolist()) == sum(len(a) * len(b) for a, b in flat)
        return
    got = alignment.aligned(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == wanted(ids, texts)


def test_documents_of_the_corpus_and_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = alignment.aligned(docs).collect()
    assert sorted(tuple(r) for r in got) == wanted([r.doc_id for r in rows], [r.text for r in rows])
    assert alignment.aligned(docs.limit(0)).count() == 0
