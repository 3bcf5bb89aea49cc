"""Preference formatting, mixing and quality rules against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import mixing, preference, quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    names = ["ledger", "measured", "n_words", "failed", "copies", "copy", "place", "rate", "_parts", "nth", "ids", "probabilities"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]) if extra else df


def odd_texts():
    rng = random.Random(5)
    words = ["ab", "cd", "é", "漢字", "#x", "A|B", "end."]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    lines = ["\n".join(rng.choice(["one two three", "x", "", " \t"]) for _ in range(12)) for _ in range(5)]
    loop = " ".join(f"w{i % 11}" for i in range(100))
    return [None, "", " \n\t\x0b\x0c\r ", " ", "word", *made, *lines, loop, loop, "a " * 7, "b " * 8, " ".join(map(str, range(30000)))]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def test_rules_on_odd_texts(spark):
    texts = odd_texts()
    rows = quality_rules.quality_rules(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = measured(texts[r.doc_id])
        assert {k: r[k] for k in wanted} == wanted
        assert not (r.base_failed and r.kept)
        assert r.kept == (r.failure_bits == 0)


def test_rules_keep_columns_and_rows(spark):
    docs = documents(spark, odd_texts(), extra=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    entry = quality_rules.ledger(docs, name="own")
    assert entry.count() == docs.count()
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_rule_ablations(spark):
    rng = random.Random(1)
    bits = [rng.randrange(64) for _ in range(500)]
    got = quality_rules.ablations(spark.createDataFrame([(b,) for b in bits], "failed long")).collect()
    assert len(got) == sum(map(len, quality_rules.POLICIES.values()))
    for r in got:
        whole, one = quality_rules.mask(quality_rules.POLICIES[r.policy]), quality_rules.mask([r.rule])
        assert r.n_failed == sum(b & one > 0 for b in bits)
        assert r.n_only == sum(b & whole == one for b in bits)


def test_rules_have_no_shuffle(spark):
    plan = quality_rules.quality_rules(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def draw(seed, *keys):
    text = ":".join([str(seed), *["" if k is None else str(k) for k in keys]])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, u):
    p = c = math.exp(-rate)
    k = 0
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_follow_the_inverse_distribution(spark):
    docs = documents(spark, ["x"] * 200, extra=True)
    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    assert sum(rates[s] * n for s, n in Counter(r.source for r in docs.collect()).items()) == pytest.approx(200)
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixing.mix(docs).columns == docs.columns
    for r in docs.collect():
        assert got[r.doc_id] == poisson(rates[r.source], draw(mixing.SEED, r.doc_id, 1))


def test_high_rates_and_target_weights(spark):
    rows = [(i, "x", "en", "tiny" if i < 3 else "big", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    weights = spark.createDataFrame([("tiny", 1.0), ("big", 1.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.replicate(docs, weights=weights).collect())
    # 150 of each are wanted; four standard deviations of the sum are 49.
    assert abs(got["tiny"] - 150) < 50 and abs(got["big"] - 150) < 50
    none = mixing.replicate(docs, weights=weights.filter("source = 'big'"))
    assert {r.source for r in none.select("source").distinct().collect()} == {"big"}


def test_mixing_is_shuffled_and_repeatable(spark):
    docs = documents(spark, [None, "", *["x"] * 98]).unionByName(documents(spark, ["again"]))
    a = mixing.replicate(docs).select("doc_id", "copy", "place").collect()
    b = mixing.replicate(docs.repartition(7)).select("doc_id", "copy", "place").collect()
    assert sorted(a) == sorted(b)
    assert [r.doc_id for r in a] != sorted(r.doc_id for r in a)
    assert mixing.mix(docs.limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string, n int"


def rendered(turns):
    return "".join(f"<|{r}|>\n" + t.replace("<|", "<\\|") + "<|end|>\n" for r, t in turns)


def test_pairs_share_the_longest_prefix(spark):
    rng = random.Random(9)
    kind = "array<struct<role:string,text:string>>"
    rows = []
    for i in range(60):
        a = [(rng.choice(["user", "assistant"]), rng.choice(["x", "é<|end|>", ""])) for _ in range(rng.randint(0, 5))]
        b = a[: rng.randint(0, len(a))] + [(rng.choice(["user", "assistant"]), "y")] * rng.randint(0, 2)
        rows.append((i, a, b))
    rows += [(98, None, [("user", None)]), (99, [(None, "t")], None)]
    df = spark.createDataFrame(rows, f"pair_id int, chosen {kind}, rejected {kind}")
    sides = {r[0]: [[(x or "", y or "") for x, y in s or []] for s in r[1:]] for r in rows}
    got = preference.format_pairs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b = sides[r.pair_id]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert r.n_common == n and r.prompt == rendered(a[:n])
        for side, turns in ((r.chosen, a), (r.rejected, b)):
            assert side.text == rendered(turns[n:])
            learnt = [side.text[s.start : s.end] for s in side.spans]
            assert learnt == [t.replace("<|", "<\\|") + "<|end|>\n" for role, t in turns[n:] if role == "assistant"]


def test_sibling_pairs_of_odd_conversations(spark):
    rows = [
        (1, 0, "user", "q", 0), (1, 1, "assistant", "a1", 0), (1, 1, "assistant", "a1", 0),
        (2, 0, "user", "only a question", 0),
        (5, 2, "assistant", "a5", 0), (5, 1, None, None, 0), (5, None, "system", "s", 0),
        (None, 0, "assistant", "nobody", 0),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    got = {r.pair_id: r for r in preference.preference_pairs(turns).collect()}
    assert set(got) == {1, 5}
    assert got[1].prompt == rendered([("user", "q")]) and got[1].n_common == 1
    assert got[1].chosen == rendered([("assistant", "a1")]) and got[1].rejected == rendered([("assistant", "a5")])
    assert got[5].prompt == rendered([("system", "s"), ("", "")])
    assert preference.preference_pairs(turns.filter("conv_id = 1")).count() == 0
    assert preference.preference_pairs(turns.limit(0)).count() == 0


def test_equal_conversations_have_empty_completions(spark):
    turns = spark.createDataFrame([(c, t, "assistant" if t else "user", "z", 0) for c in (1, 2) for t in (0, 1)], TURNS)
    for r in preference.preference_pairs(turns).collect():
        assert (r.n_common, r.chosen, r.rejected, r.chosen_mask) == (2, "", "", "")


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"t{i}", "en", "s" if i % 2 else None, None) for i in range(400)]
    out = mixing.mixture(spark.createDataFrame([*rows, (None, None, "en", None, None)], DOC)).collect()
    copies = Counter(r.text_md5 for r in out)
    assert 300 < len(out) < 500 and 200 < len(copies) < 320
