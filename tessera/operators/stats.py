"""Usage, quality and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the element at min(floor(n p), n - 1), zero if empty. The array is of one group's
    recent logs, whose number the caller bounds."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(F.floor(n * p), n - 1).cast("int"))).otherwise(F.lit(0))


def percentiles(df: DataFrame, by: list[str], value: str, ps: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """count, pXX, max by exact rank: no group is gathered; ranks come from a count of each distinct value."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    run = values.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value))).alias(f"p{round(p * 100)}")
    return run.groupBy(*by).agg(F.max("n").alias("count"), *(pick(p) for p in ps), F.max(value).alias("max"))


def recent(df: DataFrame, time: str, n: int = 300) -> DataFrame:
    return df.orderBy(F.desc(time)).limit(n)


def eval_report(results: DataFrame) -> DataFrame:
    """By dimension and in all: n, and per cent of hits in the first 1, 3 and 5, and of any rank. results:
    dimension, rank (null: not recalled)."""
    pct = lambda c: F.round(F.when(F.count("*") > 0, 100 * F.count_if(c) / F.count("*")).otherwise(0), 1)
    rows = results.rollup("dimension").agg(F.grouping("dimension").alias("g"), F.count("*").alias("n"), *(pct(F.coalesce(F.col("rank") <= k, F.lit(False))).alias(f"top{k}") for k in (1, 3, 5)), pct(F.col("rank").isNotNull()).alias("recall"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("dimension")).alias("dimension"), "n", "top1", "top3", "top5", "recall")


def threshold_curve(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: how many to be refused it blocks and how many good it loses. scores: good, score."""
    t = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return scores.select("good", "score", t).groupBy("threshold").agg(F.count_if(~F.col("good") & (F.col("score") < F.col("threshold"))).alias("blocked"), F.count_if(F.col("good") & (F.col("score") < F.col("threshold"))).alias("lost"), F.min(F.when(F.col("good"), F.col("score"))).alias("lowest_good"))


def usage_daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("usage_date")).agg(F.count_if(F.col("event_type") == "purchase").alias("qa_count"), F.count_if(F.col("event_type") == "view").alias("retrieval_count"), F.count_if(F.col("event_type") == "error").alias("blocked_count"), F.round(F.sum("value"), 4).alias("total_value"))


def history(turns: DataFrame, k: int = 6) -> DataFrame:
    """The last k turns of each session, then without failed ones, oldest first."""
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", rn).filter((F.col("back") <= k) & ~F.col("failed"))


def log_summary(logs: DataFrame, n: int = 300) -> DataFrame:
    """Of the n latest answers (created_at, refused, retrieval_failed, rerank_enabled, degraded, n_citations,
    n_unknown): counts of each condition."""
    r = recent(logs, "created_at", n)
    on = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return r.agg(F.count("*").alias("n"), on(F.col("rerank_enabled")).alias("rerank_on"), on(F.col("degraded")).alias("degraded"), on(F.col("refused")).alias("refused"), on(F.col("retrieval_failed")).alias("failed"), on(F.col("n_citations") > 0).alias("with_citation"), on(F.col("n_unknown") > 0).alias("with_unknown"))


def source_hits(logs: DataFrame, items: str = "items") -> DataFrame:
    """source, n over all items' arrays of sources."""
    return logs.select(F.explode(items).alias("i")).select(F.explode("i.sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def stage_medians(logs: DataFrame, stages: list[str], timings: str = "timings_ms") -> DataFrame:
    """One row of each stage's median time in whole ms; a missing stage counts 0, logs without timings nothing."""
    some = logs.filter(F.coalesce(F.size(timings), F.lit(0)) > 0)
    return some.agg(*(F.percentile(F.coalesce(F.try_element_at(timings, F.lit(s)), F.lit(0)), 0.5).cast("int").alias(s) for s in stages))


def refusal_report(results: DataFrame) -> DataFrame:
    """Questions to be refused (failed, refused, says_none): all, without failures, right ones and their rate."""
    ok = ~F.coalesce("failed", F.lit(False))
    right = ok & (F.coalesce("refused", F.lit(False)) | F.coalesce("says_none", F.lit(False)))
    r = results.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(right).alias("correct"))
    return r.select("*", (F.col("total") - F.col("valid")).alias("excluded"), F.round(F.when(F.col("valid") > 0, 100 * F.col("correct") / F.col("valid")).otherwise(0), 1).alias("rate"))


def fabricated(results: DataFrame, unknown: str = "n_unknown") -> DataFrame:
    return results.agg(F.count("*").alias("sampled"), F.count_if(F.coalesce(unknown, F.lit(0)) > 0).alias("with_unknown"))


def run_index(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """stamp and one column per kind with the file of that run, newest first. kinds: prefix of names -> column."""
    name = F.element_at(F.split("name", "/"), -1)
    stamp = F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    rows = files.select(name.alias("name"), stamp.alias("stamp")).filter("stamp <> ''")
    return rows.groupBy("stamp").agg(*(F.max(F.when(F.startswith("name", F.lit(p)), F.col("name"))).alias(k) for p, k in kinds.items())).orderBy(F.desc("stamp"))


def usage_left(usage: DataFrame, limit: int) -> DataFrame:
    return usage.withColumn("remaining", F.greatest(F.lit(limit) - F.coalesce("qa_count", F.lit(0)), F.lit(0)))


def gate_score(hits: DataFrame) -> DataFrame:
    """query_id, best: the largest rerank score; null where no hit has one."""
    return hits.groupBy("query_id").agg(F.max("rerank_score").alias("best"))
