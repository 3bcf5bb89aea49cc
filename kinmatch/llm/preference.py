"""Preference formatting: shared prompt once, then two masked completions.

A pair holds a chosen and a rejected conversation, each an array of turns (role,
text).  The longest common prefix of turns is rendered once as the prompt; what
follows is rendered as the chosen and the rejected completion, each with the character
spans a trainer may learn from: the texts and end marks of assistant turns, not the
turn headers nor the turns of others.

Formatting is column expressions on one row, without a shuffle.  ``sibling_pairs``
builds pairs from a table of turns: turns meet per conversation (one row of the result
anyway), and each conversation is paired with the next one in the order of ids, which
are numbered over ranges rather than in one window.

Defined results: rows without conversation id have no conversation and are left out;
repeated rows of a turn count once; turns with the same number are ordered by role,
then text; a null role or text is an empty one; conversations without an assistant
turn are not paired; a pair whose conversations are equal has empty completions; a
marker inside a text is escaped so that a text cannot forge a turn; extra columns of the
input are not read; an empty table, or a single conversation, gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.bind import let
from kinmatch.operators.ranking import numbered

LEARNT_ROLE = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, shorter), lambda t, i: t == F.get(b, i))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(shorter).cast("int")


def learnt_spans(turns: Column) -> Column:
    """Start and end of what is learnt from, in characters of the rendered turns."""

    def step(done: Column, t: Column) -> Column:
        start = done["at"] + F.char_length(header(t))
        end = start + F.char_length(body(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(t["role"] == LEARNT_ROLE, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda done: done["spans"])


def completion(turns: Column) -> Column:
    return F.struct(render(turns).alias("text"), learnt_spans(turns).alias("spans"))


def format_pairs(pairs: DataFrame, pair_id: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pair_id, n_common, prompt, and for either side a struct of text and learnt spans."""

    def clean(turns: Column) -> Column:
        empty = F.array().cast("array<struct<role:string,text:string>>")
        return F.coalesce(
            F.transform(
                turns,
                lambda t: F.struct(
                    F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
                ),
            ),
            empty,
        )

    def sides(x: Column) -> Column:
        def cut(n: Column) -> Column:
            rest = F.lit(2**30)
            return F.struct(
                n.alias("n_common"),
                render(F.slice(x["a"], 1, n)).alias("prompt"),
                completion(F.slice(x["a"], n + 1, rest)).alias("chosen"),
                completion(F.slice(x["b"], n + 1, rest)).alias("rejected"),
            )

        return let(common_turns(x["a"], x["b"]), cut)

    both = F.struct(clean(F.col(chosen)).alias("a"), clean(F.col(rejected)).alias("b"))
    return pairs.select(F.col(pair_id).alias("pair_id"), F.explode(F.array(let(both, sides))).alias("_p")).select("pair_id", "_p.*")


def dialogues(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, of each conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.filter(F.col("conv_id").isNotNull())
    grouped = known.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list(row))).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])))


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: a conversation, and the same up to its last reply, which comes from the next one."""

    def last_reply(t: Column) -> Column:
        return F.array_max(F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1)["role"] == LEARNT_ROLE))

    talks = dialogues(turns).withColumn("reply", last_reply(F.col("turns"))).filter("reply IS NOT NULL")
    order = numbered(talks, [F.col("conv_id")], "n")
    last = order.agg(F.max("n")).first()[0] or 0
    tails = order.select(
        F.when(F.col("n") == 1, F.lit(last)).otherwise(F.col("n") - 1).alias("n"),
        F.slice("turns", F.col("reply"), 2**30).alias("tail"),
    )
    pairs = order.join(tails, "n") if last > 1 else order.filter("false").withColumn("tail", F.col("turns"))
    return pairs.select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("reply") - 1), F.col("tail")).alias("rejected"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per conversation with an assistant turn: prompt, completions, and masks as ``start-end`` lists."""

    def mask(side: str) -> Column:
        return F.array_join(F.transform(f"{side}.spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    rows = format_pairs(sibling_pairs(turns))
    return rows.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        "prompt",
        F.col("chosen.text").alias("chosen"),
        mask("chosen").alias("chosen_mask"),
        F.col("rejected.text").alias("rejected"),
        mask("rejected").alias("rejected_mask"),
    )


def _side(name: str) -> str:
    """SQL for one completion: its turns after the common ones, rendered and masked."""
    return f"""
{name}_turns AS (
  SELECT conv_id, i, r, '<|' || r.role || '|>' || chr(10) AS h, replace(r.text, '<|', '<\\|') || '<|end|>' || chr(10) AS b
  FROM (SELECT conv_id, i, {name}[i] AS r FROM (SELECT conv_id, {name}, unnest(range(n_common + 1, len({name}) + 1)) AS i FROM cut))),
{name}_side AS (
  SELECT conv_id, string_agg(h || b, '' ORDER BY i) AS t,
         string_agg((o + length(h)) || '-' || (o + length(h) + length(b)), ',' ORDER BY i) FILTER (r.role = 'assistant') AS m
  FROM (SELECT *, coalesce(sum(length(h) + length(b)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM {name}_turns)
  GROUP BY conv_id)"""


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
talks AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns,
         list(role ORDER BY turn, role, text) AS roles FROM t GROUP BY conv_id),
replies AS (
  SELECT *, list_max(list_filter(range(1, len(roles) + 1), lambda i: roles[i] = 'assistant')) AS reply FROM talks
  WHERE list_contains(roles, 'assistant')),
numbers AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS n, count(*) OVER () AS c FROM replies),
pairs AS (
  SELECT a.conv_id, a.turns AS chosen, list_concat(a.turns[1:a.reply - 1], b.turns[b.reply:]) AS rejected
  FROM numbers a JOIN numbers b ON b.n = CASE WHEN a.n = a.c THEN 1 ELSE a.n + 1 END WHERE a.c > 1),
cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                     least(len(chosen), len(rejected)))::BIGINT AS n_common FROM pairs),
{_side("chosen")}, {_side("rejected")}
SELECT conv_id AS pair_id, n_common,
       array_to_string(list_transform(chosen[1:n_common], lambda r: '<|' || r.role || '|>' || chr(10) || replace(r.text, '<|', '<\\|') || '<|end|>' || chr(10)), '') AS prompt,
       coalesce(c.t, '') AS chosen, coalesce(c.m, '') AS chosen_mask, coalesce(r.t, '') AS rejected, coalesce(r.m, '') AS rejected_mask
FROM cut LEFT JOIN chosen_side c USING (conv_id) LEFT JOIN rejected_side r USING (conv_id)"""
