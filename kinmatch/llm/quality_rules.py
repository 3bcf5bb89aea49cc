"""Quality rules: a bitmask ledger that is filled once and judged by any policy.

``ledger`` measures every text once and keeps, beside the measurements, one bit per
failed rule.  A policy is a versioned set of rules, that is a mask: a document is
kept when its bits and the mask have none in common.  A new policy, and the effect of
leaving a rule out, are read off the stored bits without another look at the texts.

All of it is column expressions.  Repeated eight-word windows are found inside the
row: window hashes that all differ prove that there is no repeat, and only the rest
is compared word for word, by sorting the windows of that one text.  There is no
shuffle at all.

Defined results: a null text has no words and fails ``few_words``; ids may be null or
repeated, as every row is judged alone; ties do not occur; an empty table gives an
empty one; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.bind import let, with_once
from kinmatch.llm.common import SPACE_RUN, fresh, words_of

WINDOW = 8

#: Each rule's failure condition over the measurements ``m``; its place is its bit.
RULES = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "shouting": lambda m: 2 * m["n_upper"] > m["word_chars"],
}

#: Versions of the policy: the rules that count.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines"],
    "v2": list(RULES),
}


def mask(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _windows(words: Column) -> Column:
    """Hashes of all windows of ``WINDOW`` words."""

    def over(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def _covered(words: Column) -> Column:
    """Words that lie in a window whose words are found twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    keyed = F.sort_array(
        F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("k"), i.alias("i")))
    )

    def repeats(rows: Column) -> Column:
        def twice(j: Column) -> Column:
            here = F.get(rows, j)["k"]
            return F.coalesce(here == F.get(rows, j - 1)["k"], F.lit(False)) | F.coalesce(
                here == F.get(rows, j + 1)["k"], F.lit(False)
            )

        places = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), twice)
        return F.sort_array(F.transform(places, lambda j: F.get(rows, j)["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(
            at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(let(keyed, repeats), total)


def repeat_words(words: Column) -> Column:
    distinct = let(_windows(words), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < WINDOW, 0).when(distinct, 0).otherwise(_covered(words)).cast("long")


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct, each computed once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")

    def kept_chars(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(whole, pattern, "")).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        )

    return F.struct(
        let(words_of(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        kept_chars("[^#*$%&|<>]+").alias("n_symbols"),
        kept_chars("[^A-Z]+").alias("n_upper"),
    )


def ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> DataFrame:
    """``docs`` with a struct column: every measurement, and ``failed``, one bit per failed rule."""
    raw = fresh(docs, "measured")
    df = with_once(docs, raw, measurements(F.col(text)))
    m = F.col(raw)
    flat = {
        **{c: m["w"][c] for c in ("n_words", "word_chars", "n_repeat_words")},
        **{c: m["l"][c] for c in ("n_lines", "n_dup_lines")},
        **{c: m[c] for c in ("n_symbols", "n_upper")},
    }
    bits = [F.when(rule(flat), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    entry = F.struct(*[c.alias(n) for n, c in flat.items()], failed.cast("long").alias("failed"))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], entry.alias(name))


def passes(failed: Column, policy: str = "v2") -> Column:
    """Whether a document with these failure bits is kept by a policy."""
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(entries: DataFrame, failed: str = "failed") -> DataFrame:
    """For each policy and rule: documents it rejects, and those that only this rule rejects.

    Documents are first counted per bit pattern (at most 2 to the number of rules), so
    what is combined per policy and rule does not grow with the documents.
    """
    patterns = entries.groupBy(F.col(failed).alias("_bits")).agg(F.count(F.lit(1)).alias("_docs"))
    cases = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).alias("m"), F.lit(mask([r])).alias("b"))
                for p, rules in POLICIES.items()
                for r in rules
            ]
        )
    )
    rows = patterns.select("_bits", "_docs", cases.alias("c"))
    hit = F.col("_bits").bitwiseAND(F.col("c.b")) != 0
    alone = F.col("_bits").bitwiseAND(F.col("c.m")) == F.col("c.b")
    return rows.groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("_docs")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("_docs")).otherwise(0)).alias("n_only"),
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    name = fresh(docs, "ledger")
    return ledger(docs, name=name).filter(passes(F.col(f"{name}.failed"), policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per document: measurements, failure bits and the verdict."""
    rows = ledger(docs.select("doc_id", "text")).select("doc_id", "ledger.*")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(F.col("failed"), "base")).alias("base_failed"),
        passes(F.col("failed"), policy).alias("kept"),
        F.col("failed").alias("failure_bits"),
        passes(F.col("failed"), "v1").alias("kept_v1"),
    )


ORACLE = """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i+7], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
repeated AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
         + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
         + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
         + 32 * (2 * n_upper > word_chars)::BIGINT AS failure_bits
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
       failure_bits = 0 AS kept, failure_bits, failure_bits & 15 = 0 AS kept_v1
FROM bits"""
