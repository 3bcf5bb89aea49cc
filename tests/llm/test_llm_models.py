"""The quality model, the toxicity chain, the language model and the tokenizer."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import bpe_dropout, lm_bloom, quality_gam, toxicity

DOC = "doc_id long, text string, source string, lang string, ids int, probabilities string"
LABEL = "doc_id long, quality int, toxic int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "s", "en", 1, "own") for i, t in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join(rng.choice("the of and river stone makes long quiet light".split()) + rng.choice(["", "", "s", ","]) for _ in range(n)) + "."


ODD = [None, "", " \n ", "x", "漢字" * 3, "long " * 40_000]


def test_additive_model_learns_and_scores_odd_texts(spark):
    rng = random.Random(1)
    texts, labels = list(ODD), []
    for i in range(len(ODD), 240):
        good = rng.random() < 0.7
        texts.append(prose(rng, 80) if good else " ".join(rng.choice(["BUY!!", "###", "now"]) for _ in range(60)))
        labels.append((i, int(good), 0))
    labels += [(7, None, 0), (None, 1, 0), (9999, 1, 0), labels[3], labels[3]]
    docs, marked = documents(spark, texts), spark.createDataFrame(labels, LABEL)
    rows = {r.doc_id: r for r in quality_gam.quality_scores(docs, marked).collect()}
    assert len(rows) == len(texts)
    truth = {i: q for i, q, _ in labels if i in rows and q is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out for i in held) and len(held) > 20
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    empty = quality_gam.quality_scores(docs, marked.limit(0)).select("score").distinct().collect()
    assert [r.score for r in empty] == [pytest.approx(0.5)]
    assert quality_gam.quality_scores(docs.limit(0), marked).count() == 0


def test_additive_model_uses_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (2, 5) in model.pairs
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def toxic_corpus(spark, n=500):
    rng = random.Random(3)
    texts, labels = list(ODD), []
    for i in range(len(ODD), n):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        words = ["###", "BUY"] * 20 if junk else prose(rng, 60).split()
        if bad:
            words[rng.randrange(40)] = rng.choice(["Vexing,", "vexed", "grumpf!"])
        texts.append(" ".join(words))
        labels.append((i, int(not junk), int(bad)))
    labels += [(None, 1, 1), (2, None, None)]
    return documents(spark, texts), spark.createDataFrame(labels, LABEL), {i: t for i, _, t in labels}


def test_chain_finds_toxic_texts(spark):
    docs, labels, truth = toxic_corpus(spark)
    chain = toxicity.learn(docs, labels)
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    wrong = [i for i, t in truth.items() if i is not None and t is not None and rows[i].toxic != bool(t)]
    assert len(wrong) < 10
    assert not any(rows[i].toxic for i in range(len(ODD)))
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.toxic}
    assert len(chain.earlier[2]) == 2 and (chain.earlier[2] != 0).any()
    assert toxicity.drop_toxic(docs.limit(0), chain).count() == 0


def test_chain_without_labels(spark):
    docs, labels, _ = toxic_corpus(spark, 30)
    assert toxicity.drop_toxic(docs, toxicity.learn(docs, labels.limit(0))).count() == docs.count()


def test_chain_is_out_of_fold():
    """A category that cannot be learnt is not trusted by the next, though it could be memorised."""
    rng = np.random.default_rng(1)
    n, width = 400, 300
    rows, cols = np.arange(n), rng.integers(0, width, n)
    y = (rng.random(n) < 0.5).astype(float)
    labels = np.stack([y, y], axis=1)
    models = toxicity.fit_chain(rows, cols, labels, rng.integers(0, toxicity.FOLDS, n), width)
    # From probabilities of models that saw the document the weight would be large.
    assert models[1][1][0] < 1


def slow_scores(texts, held_out):
    c, pairs, tokens = Counter(), Counter(), []
    for text, held in zip(texts, held_out):
        words = (text or "").encode().lower().split() + [None]
        tokens.append(words)
        if not held:
            c.update(words)
            pairs.update(zip([0] + words, words))
    n, v = sum(c.values()), len(c)

    def typical(k):
        return 0 if k < 1 else 1.5 * 2 ** (k.bit_length() - 1) - 0.5

    for words in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        score = 0
        for a, w in zip([0] + words, words):
            alone, before = (typical(c[w]) + 1) / (n + v + 1), c[None] if a == 0 else typical(c[a])
            both = lm_bloom.WEIGHT * min(typical(pairs[a, w]), before) / before + (1 - lm_bloom.WEIGHT) * alone if before else alone
            score += math.log10(both)
        yield len(words), sum(c[w] > 0 for w in words), n, base, score


@pytest.mark.parametrize(
    "frequent, segment_bits, hot, broadcast_bits",
    [(0, 1 << 23, 1 << 17, 1 << 30), (5, 1 << 16, 1 << 17, 1 << 30), (1 << 18, 1 << 23, 1 << 17, 0), (5, 1 << 16, 64, 0), (5, 1 << 16, 1, 0)],
)
def test_language_model_against_exact_counts(spark, frequent, segment_bits, hot, broadcast_bits):
    rng = random.Random(6)
    texts = [None, "", "  \n", "A a A", *[prose(rng, rng.randint(1, 60)) for _ in range(120)], "unseen words 漢字", "seen once"]
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    model, bloom, counts = lm_bloom.train(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), segment_bits, hot)
    got = {r.doc_id: r for r in lm_bloom.scores(docs, model, bloom, counts, frequent, broadcast_bits).collect()}
    assert len(got) == len(texts)
    off = 0
    for i, (n, known, total, base, score) in enumerate(slow_scores(texts, held)):
        assert (got[i].n_tokens, got[i].n_known, model.tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        # A filter this full takes a key in forty for one that it does not hold.
        off += got[i].score != pytest.approx(score, rel=1e-9)
    assert off == 0 if segment_bits > 1 << 16 else off < len(texts) // 3


def test_language_model_scores_do_not_depend_on_where_the_filter_is(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(12_000)]
    docs = documents(spark, [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + [None, "unseen"]).repartition(3, "doc_id")
    model, bloom, counts = lm_bloom.train(docs.filter("doc_id % 3 > 0"), 1 << 11, 32)
    assert bloom.segments > 10 and 0 < len(lm_bloom.hot_keys(bloom).keys) <= 64
    both = [{r.doc_id: r for r in lm_bloom.scores(docs, model, bloom, counts, 50, bits).collect()} for bits in (1 << 30, 0)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 302
    for i, r in both[0].items():
        assert (r.n_tokens, r.n_known) == (both[1][i].n_tokens, both[1][i].n_known)
        assert (r.score, r.base_score) == pytest.approx((both[1][i].score, both[1][i].base_score), rel=1e-12)
    assert lm_bloom.scores(docs.limit(0), model, bloom, counts, 50, 0).count() == 0


def test_language_model_query_on_odd_tables(spark):
    docs = documents(spark, ["a b", "a b", None])
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = lm_bloom.lm_scores(twice).collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows} == {1, 3}
    assert lm_bloom.lm_scores(docs.limit(0)).count() == 0
    held = lm_bloom.lm_scores(documents(spark, ["x y"] * 60).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
    assert {(r.n_known, r.train_tokens, r.base_score) for r in held.collect()} == {(0, 0, 0.0)}


def test_filter_never_forgets_and_rarely_invents_at_any_size(spark):
    for size in (2_000, 60_000):
        rng = np.random.default_rng(4)
        keys = np.unique(rng.integers(0, 2**48, size, dtype=np.int64)).astype(np.uint64)
        counts = rng.integers(1, 9, len(keys)) ** 3
        rows = spark.createDataFrame(lm_bloom.level_rows(keys, counts).to_pandas(), lm_bloom.LEVEL_ROWS)
        bloom = lm_bloom.build(rows, int(counts.sum()), 1 << 14)
        whole = lm_bloom.gathered(bloom)
        found = whole.level(keys)
        assert (found >= lm_bloom.levels(counts)).all() and (found == lm_bloom.levels(counts)).mean() > 0.95
        assert (whole.level(rng.integers(0, 2**48, 20_000, dtype=np.int64).astype(np.uint64)) > 0).mean() < 0.04
        assert 0.3 < np.unpackbits(whole.bits).mean() < 0.45


TEXTS = ODD + [
    "hello  world\n\n x\té ▁a", "▁▁x ", "\n", "   a", "a   ", "🤷🏽‍♂️ ﷽", "\x00\x01\r\n", "x" * 700, "if x == 1:\n        return  [1, 2]", "ÀÈ " * 9,
    "The quick brown fox, unbelievably, jumps over incomprehensibilities.",
]


def test_without_dropout_it_is_the_model_itself():
    import sentencepiece

    pieces = bpe_dropout.Pieces.load()
    reference = sentencepiece.SentencePieceProcessor(model_file=bpe_dropout.MODEL)
    texts = [t for t in TEXTS if t is not None and bpe_dropout.SPACE_MARK not in t]
    for text, raw in zip(texts, bpe_dropout.Encoder(pieces, 1, 0.0).encode(texts, [0] * len(texts))):
        assert np.frombuffer(raw, "<i4").tolist() == reference.encode(text)


def test_matrix_and_agenda_agree():
    pieces = bpe_dropout.Pieces.load()
    encoder = bpe_dropout.Encoder(pieces, 5, 0.3)
    stretches = sorted({s for t in TEXTS if t for s in pieces.stretch.findall(" " + t[:3000]) if len(s) <= bpe_dropout.WIDEST})
    keys = encoder._keys(2, stretches)
    for rate in (0.0, 0.3, 1.0):
        assert pieces.many_stretches(stretches, keys, rate) == [pieces.one_stretch(s, int(k), rate) for s, k in zip(stretches, keys)]


def test_round_trip_and_variation(spark):
    pieces = bpe_dropout.Pieces.load()
    docs = documents(spark, TEXTS)
    rows = bpe_dropout.segmentations(docs, pieces).collect()
    assert len(rows) == len(TEXTS) and all(r.lossless for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[0] == 0
    again = bpe_dropout.segmentations(docs.repartition(5), pieces).collect()
    assert sorted(rows) == sorted(again)
    kinds = {seed: bpe_dropout.encode(docs, pieces, seed=seed).select("doc_id", "ids").collect() for seed in (1, 2)}
    assert sorted(kinds[1], key=lambda r: r.doc_id) != sorted(kinds[2], key=lambda r: r.doc_id)
    same = documents(spark, [TEXTS[-1]] * 40)
    assert len({tuple(r.ids) for r in bpe_dropout.encode(same, pieces).collect()}) > 1
    assert bpe_dropout.encode(docs, pieces).columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    assert bpe_dropout.tokens(docs.limit(0), pieces).count() == 0
    assert bpe_dropout.tokens(docs, pieces).count() == len(TEXTS)
