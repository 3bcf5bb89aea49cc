"""Near copies, exact top-k and licence notices against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.llm import exact_topk, license_scan, simhash

DOC = "doc_id long, text string, source string, fp string, nth int"


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(ids, edges):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_texts():
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randint(0, 30)) for _ in range(400)) for _ in range(12)]
    out = [None, "", "  ", "One", "one", "two words", "Two Words", "x " * 5000]
    for text in base:
        words = text.split()
        out.append(text)
        for n in range(rng.randint(0, 5)):
            words[rng.randrange(400)] = f"new{n}"
            out.append(" ".join(words))
    return out


def test_components_of_near_copies(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "s", "own", 1) for i, t in enumerate(texts)], DOC)
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    wanted = closure(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == wanted
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))


def test_rows_without_id_and_repeated_ids(spark):
    rows = [(None, "a b c d", "s", "", 0), (7, "a b c d", "s", "", 0), (7, "a b c d", "s", "", 0), (7, "quite another text", "s", "", 0), (9, "quite another text", "t", "", 0), (None, None, "s", "", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 6 and all(r.component_id == (None if r.doc_id is None else 7) for r in got)
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(docs).collect()) == [0, 7]
    loose = spark.createDataFrame([(None, t, s, "", 0) for t in ("e f g h", "E f g h", "a b c d", None, "") for s in "uv"], DOC)
    kept = simhash.one_of_each(docs.unionByName(loose)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, ""), (0, "e f g h"), (7, "a b c d")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("blocks", "agree", "rho"), [(4, 2, 0), (2, 1, 1), (1, 1, 2), (3, 1, 0)])
def test_trees_find_every_pair(spark, blocks, agree, rho):
    rng = np.random.default_rng(blocks)
    prints = list(map(int, rng.integers(0, 2**63, 120, dtype=np.int64)))
    for p in prints[:60]:
        for n in (1, 2, 3):
            prints.append(p ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False)))
    prints = sorted(set(prints))
    df = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    assert simhash.least_apart(2, blocks, agree) == rho
    got = [tuple(r) for r in simhash.near_pairs(df, 2, blocks, agree, levels=6).collect()]
    wanted = {(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == wanted


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    wanted = closure({x for e in edges for x in e}, edges)
    assert got == {i: wanted[i] for i in linked}


VEC = "vec_id long, embedding array<float>, label int"


def test_top_products_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(exact_topk, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=24) * (1 + i % 5))], 0) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1], 0) for i in range(40)]
    rows += [(450, None, 0), (500, [float("nan")] * 24, 0), (550, [1.0, None], 0), (600, [float("inf")], 0), (None, rows[0][1], 0), (650, [], 0), (700, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VEC).repartition(5)
    whole = {i: np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}

    def product(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])

    wanted = []
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-product(whole[q], v), i) for i, v in whole.items() if i != q))[:5]
            wanted += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = [tuple(r) for r in exact_topk.nearest(df).collect()]
    assert sorted(got) == sorted(wanted)
    assert exact_topk.nearest(df.limit(0)).count() == 0
    assert exact_topk.nearest(df.filter("vec_id = 0")).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-300, 300, (20, 37)), rng.integers(-300, 300, (50, 37))
    for parts in (1, 4, 16, 64):
        bound = exact_topk.segment_statistics(q, parts) @ exact_topk.segment_statistics(x, parts).T
        assert (bound >= q @ x.T - 1e-6).all()


def test_licence_phrases_and_edits(spark):
    texts = [
        None,
        "",
        "Under the GNU  General-Public License, or the Apache License. cc BY! CC by",
        "éMIT License; MIT license",
        "the gnu genral public licence applies",
        "Permission is hereby granted, free of charg, to any person obtainin a copy of this",
        "mit mit license license mit license",
        "limit licenses",
        "word " * 50_000 + "Apache Licens and more",
    ]
    docs = spark.createDataFrame([(i, t, "s", "", 0) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].score, got[0].labels) == (0, 0, None, 0.0, "")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (14, 4, 2, 12)
    assert got[2].base_labels == "apache,cc-by,gpl" and got[2].score == 1.0
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (1, 2, 2)
    assert (got[4].base_labels, got[4].labels, got[4].spans) == ("", "gpl", "gpl:1-5:2") and 0.9 < got[4].score < 1
    assert got[5].labels == "mit-grant" and got[5].n_base == 0
    assert (got[6].n_base, got[6].first_word, got[6].last_word) == (2, 1, 4)
    assert got[7].labels == ""
    assert (got[8].n_words, got[8].labels) == (50_004, "apache") and "50000-50002:1" in got[8].spans
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_licence_seeds_miss_nothing():
    import regex

    rng = random.Random(8)
    notice, label, k = "gnu general public license", "gpl", 3
    whole = regex.compile(rf"(?<= )(?:{notice}){{e<={k}}}(?= )")
    for _ in range(300):
        letters = list(notice)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(letters))
            letters[at : at + 1] = rng.choice([[], [rng.choice("abé")], [letters[at], "x"]])
        text = " ".join(f"see the {''.join(letters)} here".split())
        found = license_scan.scan_text(text, {}, [(notice, label, k)])[5]
        assert bool(found) == bool(whole.search(f" {text} ")), text
        assert all(f["edits"] <= k for f in found)
