"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once
as prompt, and what follows in each as completions, with the character spans that count for the loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stash, table

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
LEARN = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order of turn. A repeated row counts once; ties of turn go by role
    and text; a null turn comes first, a null text is empty and a null role "unknown"; rows without conv_id
    belong to no conversation. A conversation is one record here as in every output format."""
    t = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = F.array_sort(F.collect_set(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "text")))
    return t.groupBy("conv_id").agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    same = F.when(least > 0, F.transform(F.sequence(F.lit(1), least), lambda i: F.get(a, i - 1) == F.get(b, i - 1))).otherwise(F.array().cast("array<boolean>"))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(least).cast("int")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """start:end of what is learnt in render(turns): text and end mark of the assistant's turns, comma-joined."""
    head, tail = len(OPEN) + len(MIDDLE), len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + head + F.length(t["role"])
        b = a + F.length(t["text"]) + tail
        span = F.concat(a.cast("string"), F.lit(":"), b.cast("string"))
        return F.struct(b.alias("at"), F.when(t["role"] == LEARN, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (any ids, chosen and rejected arrays of (role, text)) with n_prompt_turns, prompt, and of either side
    completion and loss spans. Null conversations count as empty; equal ones leave empty completions."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    ids = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    p = pairs.withColumns({c: F.coalesce(c, empty) for c in ("chosen", "rejected")}).withColumn("n_prompt_turns", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return p.select(
        *ids, "n_prompt_turns", render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        *(render(v).alias(f"{c}_completion") for c, v in rest.items()), *(loss_spans(v).alias(f"{c}_loss") for c, v in rest.items()),
    )


#: Conversations of one opening in one task, and of one group in which replies are exchanged.
HOT, SWAP = 256, 64


def last_reply(turns: Column) -> Column:
    """Number, from 1, of the last of the assistant's turns; null without one."""
    return F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == LEARN, i + 1)))


def preferences(turns: DataFrame) -> DataFrame:
    """Pairs of a chosen and a rejected conversation: conv_id, chosen_id, rejected_id and what format_pairs gives.

    Conversations that open with the same turn answer one question: the one with the smallest id is chosen, each
    other that goes on differently is rejected against it (conv_id = rejected_id). Every other conversation with
    a reply is chosen against itself with its last reply exchanged for that of another conversation (rejected_id):
    the next id, after the largest the smallest, of those whose ids are equal modulo a 64th of their number.
    No row: conversations without a reply of the assistant that are alone with their opening, and those whose
    partner's reply is the same or that have no partner. An empty table gives no rows; extra columns are ignored.
    A hot opening is one aggregate, and its join is dealt out in parts of HOT conversations."""
    conv = stash(conversations(turns).withColumn("first", F.get("turns", F.lit(0))).withColumn("opening", F.xxhash64("first")))
    lead = conv.groupBy("opening", "first").agg(F.min_by("turns", "conv_id").alias("best"), F.min("conv_id").alias("best_id"), F.count("*").alias("c"))
    lead = stash(lead.filter("c > 1").withColumn("parts", F.ceil(F.col("c") / HOT).cast("int")))
    hot = lead.filter("parts > 1").groupBy("opening").agg(F.max("parts").alias("parts"))
    n_hot, n = hot.count(), conv.count()
    dealt = conv.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "opening", "left").withColumn("part", F.pmod(F.xxhash64("conv_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("opening", "first", "part", "best", "best_id")
    both = dealt.join(lead, ["opening", "first", "part"], "left")
    against = (F.col("conv_id") != F.col("best_id")) & (F.size("turns") > shared_turns(F.col("turns"), F.col("best")))
    both = stash(both.select("conv_id", "turns", F.when(against, F.col("best_id")).alias("chosen_id"), F.when(against, F.col("best")).alias("chosen")))
    ranked = both.filter("chosen_id IS NOT NULL").select("conv_id", "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
    at = last_reply(F.col("turns"))
    replies = conv.select("conv_id", F.get("turns", last_reply(F.col("turns")) - 1)["text"].alias("reply")).filter("reply IS NOT NULL")
    ring = Window.partitionBy(F.pmod("conv_id", F.lit(max(1, n // SWAP)))).orderBy("conv_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct("conv_id", "reply")
    swap = replies.select("conv_id", "reply", F.coalesce(F.lead(other).over(ring), F.first(other).over(whole)).alias("o"))
    swap = swap.filter("o.conv_id <> conv_id AND o.reply <> reply").select("conv_id", F.col("o.conv_id").alias("rejected_id"), F.col("o.reply").alias("other"))
    alone = both.filter("chosen_id IS NULL").select("conv_id", "turns").join(swap, "conv_id").withColumn("at", at)
    turn = F.struct(F.lit(LEARN).alias("role"), F.col("other").alias("text"))
    changed = F.transform("turns", lambda t, i: F.when(i + 1 == F.col("at"), turn).otherwise(t))
    alone = alone.select("conv_id", F.col("conv_id").alias("chosen_id"), "rejected_id", F.col("turns").alias("chosen"), changed.alias("rejected"))
    return format_pairs(ranked.unionByName(alone))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(table(spark, sf_dir, "conversations"))


_RENDER = "coalesce(array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"
_LOSS = """coalesce(array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN
  (coalesce(list_sum(list_transform({0}[1:i-1], lambda t: 13 + length(t.role) + length(t.text))), 0)::BIGINT + 5 + length({0}[i].role))::VARCHAR || ':' ||
  (coalesce(list_sum(list_transform({0}[1:i], lambda t: 13 + length(t.role) + length(t.text))), 0)::BIGINT)::VARCHAR END), lambda s: s IS NOT NULL), ','), '')"""
OP9_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
c AS (SELECT *, list_max(list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN turns[i].role = 'assistant' THEN i END)) AS last FROM c0),
g AS (SELECT *, min(conv_id) OVER (PARTITION BY turns[1]) AS best_id FROM c),
m AS (SELECT g.*, o.turns AS best, coalesce(list_position(list_transform(range(1, least(len(g.turns), len(o.turns)) + 1), lambda i: g.turns[i] = o.turns[i]), false), 0) AS differ
  FROM g JOIN c o ON o.conv_id = g.best_id),
x AS (SELECT *, conv_id <> best_id AND (differ > 0 OR len(turns) > len(best)) AS against FROM m),
k AS (SELECT greatest(1, count(*) // 64) AS parts FROM c),
r AS (SELECT conv_id, turns[last].text AS reply, ((conv_id % parts) + parts) % parts AS part FROM c, k WHERE last IS NOT NULL),
w AS (SELECT conv_id, reply, coalesce(lead({{'id': conv_id, 'reply': reply}}) OVER v, first({{'id': conv_id, 'reply': reply}}) OVER (PARTITION BY part ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS o
  FROM r WINDOW v AS (PARTITION BY part ORDER BY conv_id)),
j AS (SELECT conv_id, best_id AS chosen_id, conv_id AS rejected_id, best AS chosen, turns AS rejected FROM x WHERE against
  UNION ALL SELECT x.conv_id, x.conv_id, w.o.id, turns, list_concat(list_concat(turns[1:last - 1], [{{'role': 'assistant', 'text': w.o.reply}}]), turns[last + 1:])
  FROM x JOIN w ON w.conv_id = x.conv_id WHERE NOT against AND w.o.id <> x.conv_id AND w.o.reply <> w.reply),
p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] = rejected[i]), false), 0)::INTEGER - 1 AS n0 FROM j),
q AS (SELECT conv_id, chosen_id, rejected_id, CASE WHEN n0 < 0 THEN least(len(chosen), len(rejected))::INTEGER ELSE n0 END AS n_prompt_turns, chosen, rejected FROM p),
s AS (SELECT *, chosen[1:n_prompt_turns] AS pre, chosen[n_prompt_turns + 1:] AS cc, rejected[n_prompt_turns + 1:] AS rr FROM q)
SELECT conv_id, chosen_id, rejected_id, n_prompt_turns, {_RENDER.format('pre')} AS prompt, {_RENDER.format('cc')} AS chosen_completion,
  {_RENDER.format('rr')} AS rejected_completion, {_LOSS.format('cc')} AS chosen_loss, {_LOSS.format('rr')} AS rejected_loss FROM s
"""
