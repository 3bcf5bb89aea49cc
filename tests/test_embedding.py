"""Embeddings with learnt weights tell near copies from texts that only share common words."""

import hashlib
import math
import random
import re
from collections import Counter

from kinmatch.operators.embedding import block_terms, weighted_embeddings


def test_near_copies_are_nearest(spark):
    rng = random.Random(5)
    common, rare = "the of and to in a is that it for".split(), [f"word{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(60)) for _ in range(40)]
    copies = []
    for text in texts:
        words = text.split()
        words[rng.randrange(60)] = "changed"
        copies.append(" ".join(words))
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(copies)]
    odd = [(900, None), (901, " \n "), (902, "x"), (None, "the of"), (903, "word1 " * 5000)]
    got = weighted_embeddings(spark.createDataFrame(rows + odd, "id int, text string"), "id").collect()
    vectors = {r.id: r.embedding for r in got}
    assert vectors.keys() == {i for i, _ in rows} | {902, 903} and {len(v) for v in vectors.values()} == {256}
    for i in range(40):
        by = {j: sum(a * b for a, b in zip(vectors[i], vectors[j])) for j in vectors if j != i}
        assert max(by, key=by.get) == 100 + i and by[100 + i] > 0.9
    assert weighted_embeddings(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def _plain(texts, dim=256):
    """The definition, written out."""
    tf = {}
    for key, text in texts:
        words = re.split("[ \t\r\n]+", text.strip().lower())
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            tf.setdefault(key, Counter())[term] += 1
    df = Counter(t for held in tf.values() for t in held)
    out = {}
    for key, held in tf.items():
        v = [0.0] * dim
        for term, n in held.items():
            digest = hashlib.md5(term.encode()).hexdigest()
            v[int(digest[:7], 16) % dim] += (1 if digest[7] < "8" else -1) * n * (1 + math.log((len(tf) + 1) / (df[term] + 1)))
        size = math.sqrt(sum(x * x for x in v))
        out[key] = [x / size for x in v]
    return out


def test_blocks_of_any_size_give_the_same_vectors(spark):
    rng = random.Random(7)
    words = ["The", "ÄRGER", "of", "x y", "ﬁn", "a", "日本", "b\x0bc"] + [f"w{i}" for i in range(60)]
    rows = [(f"k{i % 70}", "  " + rng.choice([" ", "\n", "\t \r"]).join(rng.choices(words, k=1 + i % 40)) + " ") for i in range(150)]
    wanted = _plain(rows)
    for block_bytes in (200, 1 << 20):
        got = weighted_embeddings(spark.createDataFrame(rows, "id string, text string").repartition(3), "id", block_bytes=block_bytes).collect()
        assert len(got) == len(wanted)
        assert all(abs(a - b) < 1e-9 for r in got for a, b in zip(r.embedding, wanted[r.id]))


def test_terms_travel_once_per_block(spark):
    rows = spark.createDataFrame([(n % 2, n, "the same words in all texts") for n in range(60)], "block int, key int, text string")
    sent = block_terms(rows.repartitionById(2, "block").sortWithinPartitions("key"), 3).collect()
    assert len(sent) <= 2 * 3
    assert sorted(t for r in sent if r.block == 1 for t in r.terms.split("\n")) == sorted(
        ["the", "same", "words", "in", "all", "texts", "the same", "same words", "words in", "in all", "all texts"]
    )
    assert {n for r in sent for n in memoryview(r.texts).cast("i")} == {30}
