"""Request limits over event streams, and streaming ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMIT = "key string, event_id long, t double, allowed boolean"


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Sliding window: events older than the window go; a denied one isn't recorded."""
    out = []
    for t in times:
        held = [x for x in held if x >= t - window]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def replay(events: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Batch form over (key, event_id, t): admission depends on earlier admissions of the key, so a key's events
    are read in order. Batches of a sorted partition keep the state of one key only, so memory doesn't grow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for b in batches:
            ok = []
            for k, t in zip(b.key, b.t, strict=True):
                if k != last:
                    last, held = k, []
                now, held = admit([t], held, limit, window)
                ok += now
            yield b.assign(allowed=ok)

    rows = events.select(F.col("key").cast("string").alias("key"), "event_id", "t").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return rows.mapInPandas(run, ADMIT)


def stream_limit(events: DataFrame, limit: int = 20, window: float = 60.0) -> DataFrame:
    """Streaming form: the same state by key in Spark's state store."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for b in pdfs:
            b = b.sort_values(["t", "event_id"])
            ok, held = admit(b.t.tolist(), held, limit, window)
            yield pd.DataFrame({"key": key[0], "event_id": b.event_id, "t": b.t, "allowed": ok})
        state.update((held,))

    return events.select(F.col("key").cast("string").alias("key"), "event_id", "t").groupBy("key").applyInPandasWithState(step, ADMIT, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """Every event with its number of the key's day and whether that is within the limit (0: none)."""
    nth = F.row_number().over(Window.partitionBy("key", F.to_date("ts")).orderBy("ts", "event_id"))
    return events.withColumn("nth", nth).withColumn("allowed", F.lit(limit <= 0) | (F.col("nth") <= limit))


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; the watermark counts in streams only."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def ingest(docs: DataFrame, into: str, checkpoint: str, process):
    """A stream of documents through process(batch) into a Parquet table; a replayed batch overwrites its own
    folder, so restarts neither lose nor repeat rows."""

    def each(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cascade(events: DataFrame, per_minute: int = 20, per_day: int = 30, all_day: int = 300) -> DataFrame:
    """Requests (key, event_id, t in seconds, kind) with the gate that stops them: minute, key_day, day, or null.

    The minute gate takes all kinds; only questions that pass it ("qa") count for the day's gates, of the key and,
    passed by that too, of all keys together. 0 switches a day's gate off. The day of all keys is numbered by
    running counts of its seconds, so no task orders a whole day's requests."""
    r = replay(events, per_minute, 60.0).filter("allowed").select("event_id", F.lit(True).alias("in_minute"))
    e = events.join(r, "event_id", "left").withColumn("day", F.floor(F.col("t") / 86400))
    qa = (F.col("kind") == "qa") & F.col("in_minute")
    nth = F.row_number().over(Window.partitionBy("key", "day", qa).orderBy("t", "event_id"))
    e = e.withColumn("over_key", F.coalesce(qa, F.lit(False)) & F.lit(per_day > 0) & (nth > per_day)).withColumn("asks", F.coalesce(qa, F.lit(False)) & ~F.col("over_key"))
    second = F.floor("t")
    per = e.filter("asks").groupBy("day", second.alias("second")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("day", "second", before.alias("before"))
    e = e.withColumn("second", second).join(per, ["day", "second"], "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("day", "second", "asks").orderBy("t", "event_id"))
    over = F.col("asks") & F.lit(all_day > 0) & (place > all_day)
    gate = F.when(F.col("in_minute").isNull(), "minute").when(F.col("over_key"), "key_day").when(over, "day")
    return e.select("key", "event_id", "t", "kind", gate.alias("gate"))


def progress(done: int, total: int) -> int:
    """Per cent of an indexing job: 75 to 95 as its batches end."""
    return min(95, 75 + 25 * done // max(1, total))
