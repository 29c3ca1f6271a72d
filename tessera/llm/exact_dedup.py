"""Exact dedup through a minimal perfect hash over the distinct digests seen so far.

The historical digests are dealt into shards by a digest prefix. Each shard is a minimal perfect hash in
levels: a key that is alone in its cell of a level gets that cell, the others go to the next level, and a
key's slot is the rank of its cell. Slots hold the full digest and the winner's locator, so a lookup
compares all 32 bytes. Rows that the index doesn't know are grouped on their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import stash, table

#: A winner is the row with the most code points, then the smallest doc_id (null last), then the first of equal rows.
GAMMA, LEVELS = 2.0, 40
SHARD_SCHEMA = "shard int, sizes binary, cells binary, slots binary, keep binary, has binary, n binary, place binary"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest binary(32) of the text without ASCII white space, n_cp code points of the original, row number."""
    text = F.coalesce("text", F.lit(""))
    bare = F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")
    return docs.select("doc_id", F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), F.length(text).cast("long").alias("n_cp"), F.monotonically_increasing_id().alias("row"))


def group_digests(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, group_size: one partial aggregate, so a hot digest is one row per map task."""
    # ~x turns the order of longs round, for the smallest one too.
    best = F.max(F.struct("n_cp", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("minus"), F.bitwise_not("row").alias("minus_row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select("digest", F.bitwise_not("best.minus").alias("keep_id"), F.bitwise_not("best.minus_row").alias("keep_row"), "group_size")


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Cell of each key (n x 4 words) in a level, by a multiply and shift mix."""
    x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((0xD1B54A32D192ED03 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


class PerfectHash:
    """n distinct 32-byte keys <-> slots 0..n-1."""

    def __init__(self, sizes: np.ndarray, cells: np.ndarray, slots: np.ndarray) -> None:
        self.sizes, self.cells, self.slots = sizes, cells, slots
        self.rank = np.cumsum(cells, dtype=np.int64) - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash and the slot of each key."""
        left, sizes, parts, slot, done = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64), 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(1, int(GAMMA * len(left)))
            at = _cells(keys[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            ok = alone[at]
            slot[left[ok]] = done + (np.cumsum(alone) - 1)[at[ok]]
            done += int(alone.sum())
            sizes.append(size)
            parts.append(alone)
            left = left[~ok]
        if len(left):
            raise ValueError("digests aren't distinct")
        slots = np.zeros((len(keys), 4), "<u8")
        slots[slot] = keys
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, bool), slots), slot

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the stored digest differs."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + _cells(keys[left], level, int(size))
            hit = self.cells[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        same = found >= 0
        same[same] = (self.slots[found[same]] == keys[same]).all(1)
        found[~same] = -1
        return found


def shard_of(n: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n)).cast("int")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard of history (digest, keep_id, keep_row, group_size; digests distinct)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index, slot = PerfectHash.build(_words(b"".join(pdf.digest)))
        keep, has, n, place = (np.zeros(len(pdf), t) for t in ("<i8", bool, "<i8", "<i8"))
        place[slot] = pdf.keep_row.fillna(-1).astype("int64")
        known = pdf.keep_id.notna().to_numpy()
        keep[slot[known]], has[slot], n[slot] = pdf.keep_id[known].astype("int64"), known, pdf.group_size
        return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "sizes": [index.sizes.tobytes()], "cells": [np.packbits(index.cells).tobytes()], "slots": [index.slots.tobytes()], "keep": [keep.tobytes()], "has": [has.tobytes()], "n": [n.tobytes()], "place": [place.tobytes()]})

    return history.withColumn("shard", shard_of(n_shards)).groupBy("shard").applyInPandas(build, SHARD_SCHEMA)


def lookup(rows: DataFrame, index: DataFrame, n_shards: int, most_rows: int) -> DataFrame:
    """rows (doc_id, digest, n_cp, row) with keep_id, keep_row and group_size, null where the index lacks the digest, and
    member. Every (shard, split) group holds about most_rows rows: a shard with a hot digest is dealt into as
    many splits as it needs and its index row is repeated for each."""
    rows = rows.withColumn("shard", shard_of(n_shards))
    # One row of 12 bytes per shard of up to 50 000 digests; Spark itself decides on broadcasting it.
    splits = rows.groupBy("shard").agg(F.ceil(F.count("*") / most_rows).cast("int").alias("splits"))
    if n_shards <= 1 << 20:
        splits = F.broadcast(splits)
    blobs = [c for c in index.columns if c != "shard"]
    left = rows.join(splits, "shard").withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int"))
    left = left.select("shard", "split", F.lit(1).alias("kind"), "doc_id", "digest", "n_cp", "row", *(F.lit(None).cast("binary").alias(c) for c in blobs))
    right = index.join(splits, "shard").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    right = right.select("shard", "split", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("n_cp"), F.lit(None).cast("long").alias("row"), *blobs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In each (shard, split) the index row comes first, then the rows to look up; one index is held at a time."""
        place, held = None, None
        for batch in batches:
            spots, kind = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(spots) != 0) | (np.diff(kind) != 0)) + 1), len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if spots[a] != place:
                    place, held = spots[a], None
                if kind[a] == 0:
                    sizes, cells, slots, keep, has, n, spot = (batch.column(7 + j)[a].as_py() for j in range(7))
                    sizes = np.frombuffer(sizes, np.int64)
                    bits = np.unpackbits(np.frombuffer(cells, np.uint8))[: sizes.sum()].astype(bool)
                    held = PerfectHash(sizes, bits, _words(slots)), np.frombuffer(keep, "<i8"), np.frombuffer(has, bool), np.frombuffer(n, "<i8"), np.frombuffer(spot, "<i8")
                    continue
                part = batch.slice(a, b - a)
                digest = part.column(4)
                if held is None:
                    ok, keep_id, known, size, row = (np.zeros(b - a, t) for t in (bool, np.int64, bool, np.int64, np.int64))
                else:
                    at = held[0].lookup(_words(b"".join(digest.to_pylist())))
                    ok, safe = at >= 0, np.maximum(at, 0)
                    keep_id, known, size, row = held[1][safe], ok & held[2][safe], held[3][safe], held[4][safe]
                yield pa.RecordBatch.from_arrays([part.column(3), digest, part.column(5), part.column(6), pa.array(keep_id, mask=~known), pa.array(row, mask=~ok | (row < 0)), pa.array(size, mask=~ok), pa.array(ok)], names=["doc_id", "digest", "n_cp", "row", "keep_id", "keep_row", "group_size", "member"])

    both = left.unionByName(right).repartition("shard", "split").sortWithinPartitions("shard", "split", "kind")
    return both.mapInArrow(find, "doc_id long, digest binary, n_cp long, row long, keep_id long, keep_row long, group_size long, member boolean")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, most_rows: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; of equal texts the longest original, then the
    smallest doc_id, then the first of equal rows stays: one row of each group. Null text counts as empty; a null
    doc_id wins only in a group of nulls. history (digest, keep_id, group_size) is what the index is built on:
    earlier winners, which stay winners, so no row of docs that it knows is kept. Without it, the index holds every digest that
    repeats in docs, and digests seen once are the nonmembers."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stash(digests(docs))
    groups = group_digests(rows)
    if history is None:
        history = groups.filter("group_size > 1")
    else:
        history = history.select("digest", "keep_id", F.lit(None).cast("long").alias("keep_row"), "group_size")
    history = stash(history)
    n_rows, n_keys = rows.count(), history.count()
    most = max(64, min(most_rows, n_rows // (2 * n_parts)))
    n_shards = max(1, -(-n_keys // max(64, min(most_rows, n_keys // n_parts))), -(-n_rows // (most * 4)))
    found = stash(lookup(rows, build_index(history, n_shards), n_shards, most))
    members = found.filter("member").drop("member")
    new = found.filter("not member").select("doc_id", "digest", "n_cp", "row")
    fresh = new.join(group_digests(new), "digest").select(*members.columns)
    both = members.unionByName(fresh)
    return both.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def exact_dedup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all other sources against an index over those of src0 to src9, crawled before."""
    docs = table(spark, sf_dir, "documents")
    before = F.coalesce(F.col("source"), F.lit("")).rlike("^src[0-9]$")
    return exact_dedup(docs.filter(~before), group_digests(stash(digests(docs.filter(before)))))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d),
k AS (SELECT text_sha256, doc_id AS keep_id FROM w WHERE rn = 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w JOIN k USING (text_sha256)
"""

HISTORY_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_matches(coalesce(source, ''), '^src[0-9]$') AS before,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY before, text_sha256 ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY before, text_sha256) AS group_size FROM d),
k AS (SELECT before, text_sha256, doc_id AS keep_id, group_size FROM w WHERE rn = 1)
SELECT w.doc_id, coalesce(h.keep_id, k.keep_id) AS keep_id, coalesce(h.group_size, k.group_size) AS group_size, h.keep_id IS NULL AND w.doc_id = k.keep_id AS kept, w.text_sha256
FROM w JOIN k ON k.text_sha256 = w.text_sha256 AND NOT k.before LEFT JOIN k h ON h.text_sha256 = w.text_sha256 AND h.before WHERE NOT w.before
"""
