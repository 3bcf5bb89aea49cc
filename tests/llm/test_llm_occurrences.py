"""Dropout is drawn for every occurrence of a word and every copy of a document."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from kinmatch.llm import bpe_dropout

WORD = " incomprehensibilities"


def test_a_word_varies_within_a_text():
    pieces = bpe_dropout.Pieces.load()
    encoder = bpe_dropout.Encoder(pieces, 3, 0.2)
    text = (WORD * 400)[1:] + " " + "x1" * 60
    first = encoder.encode([text, text], [7, 8])
    # The kept draws give what encoding each place by its key gives.
    stretches = pieces.stretch.findall(" " + text)
    for variant, raw in zip((7, 8), first):
        keys = encoder._keys(variant, stretches)
        single = [pieces.one_stretch(s, int(k), 0.2) for s, k in zip(stretches, keys)]
        assert raw == b"".join(single) and len(set(single)) > 20
        assert pieces.decode(np.frombuffer(raw, "<i4").tolist()) == text
    assert first[0] != first[1] and encoder.encode([text], [8]) == first[1:]
    assert bpe_dropout.Encoder(pieces, 3, 0.2).encode([text], [8]) == first[1:]

    # " a" is one candidate, which goes at the rate.
    ids = np.frombuffer(encoder.encode([("a " * 4000)[:-1]], [7])[0], "<i4")
    assert abs((ids == pieces.ids["▁a"]).sum() / 4000 - 0.8) < 0.03


def test_copies_of_a_document_vary(spark):
    text = (WORD * 30)[1:]
    rows = [(i, text, "rare", "en") for i in range(5)] + [(100 + i, "a b", "full", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["encoding"](spark, stages["mixing"](spark, docs, ""), "").filter(F.col("doc_id") < 100).collect()
    assert len(out) > len({r.doc_id for r in out})
    assert len({tuple(r.ids) for r in out}) == len(out)


def counted(monkeypatch):
    """The stretches that are encoded from now on."""
    seen, stepped = [], bpe_dropout.Pieces.stepped

    def noted(self, texts, *rest):
        seen.extend(texts)
        return stepped(self, texts, *rest)

    monkeypatch.setattr(bpe_dropout.Pieces, "stepped", noted)
    return seen


def test_a_stretch_is_encoded_once_for_the_same_draws(monkeypatch):
    pieces = bpe_dropout.Pieces.load()
    rng = random.Random(4)
    words = list({"".join(rng.choice(["an", "the", "ti", "sh", "ou", "é"]) for _ in range(rng.randrange(2, 6))) for _ in range(2000)})
    monkeypatch.setattr(bpe_dropout, "FEW", 0)
    encoder = bpe_dropout.Encoder(pieces, 3, 0.2)
    seen = counted(monkeypatch)
    encoder.encode([" ".join(words)], [1])
    # A stretch met once is not encoded without a drop as well.
    assert len(seen) == len(words) == len(encoder.numbers)

    text = (" the" * 5000)[1:]
    seen.clear()
    encoder.encode([text], [2])
    encoder.encode([text], [3])
    assert len(seen) < 40


def test_trees_give_what_each_place_gives_alone(monkeypatch):
    monkeypatch.setattr(bpe_dropout, "CACHE", 30)
    monkeypatch.setattr(bpe_dropout, "FEW", 20)
    monkeypatch.setattr(bpe_dropout, "BLOCK", 7)
    pieces = bpe_dropout.Pieces.load()
    rng = random.Random(5)
    words = ["the", "then", "a", "漢字x", "🤷🏽‍♂️", "▁▁x", "incomprehensibilities", "\n", "", "x" * 64, "ab" * 60, *(f"no{i}" for i in range(40))]
    for rate in (0.0, 0.25, 1.0):
        encoder = bpe_dropout.Encoder(pieces, 3, rate)
        for _ in range(4):
            texts = [None, "", *(" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(5))]
            variants = [rng.getrandbits(64) for _ in texts]
            for variant, text, raw in zip(variants, texts, encoder.encode(texts, variants)):
                stretches = pieces.stretch.findall(" " + text) if text else []
                keys = encoder._keys(variant, stretches)
                alone = [pieces.one_stretch(s, int(k), rate) for s, k in zip(stretches, keys)]
                assert raw == (None if text is None else b"".join(alone))
            assert all(len(s) <= bpe_dropout.WIDEST for s in encoder.numbers)
    assert encoder.encode([], []) == [] and encoder.encode([None, ""], [1, 2]) == [None, b""]


def test_lists_decode_as_each_list_does():
    pieces = bpe_dropout.Pieces.load()
    rng = random.Random(6)
    lists = [None, [], [pieces.byte_ids[0xE6], pieces.byte_ids[0x20]], *([rng.randrange(len(pieces.pieces)) for _ in range(k)] for k in range(40)), None]
    wanted = [None if ids is None else pieces.decode(ids) for ids in lists]
    column = pa.array(lists, pa.list_(pa.int32()))
    assert pieces.decode_lists(column) == wanted
    assert pieces.decode_lists(column.slice(2, 9)) == wanted[2:11]
    assert pieces.decode_lists(pa.array([None, [], None], pa.list_(pa.int32()))) == [None, "", None]
