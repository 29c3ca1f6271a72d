"""Best-fit packing of token sequences by bin completion with branch and bound.

Lengths are integers from 1 to the capacity, so however many documents there are, the packing problem is a
histogram of at most `capacity` counts. The driver solves that histogram: it takes the largest remaining
length, enumerates the undominated fillings of the rest of its sequence, and branches on them, pruning by
the waste that the incumbent still allows. A filling is used as often as the counts permit in one step. The
solution is a list of patterns with multiplicities; pieces find their place by their rank within their
length, which is counted in parallel."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import slices, stash, table
from .token_counts import safe_pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# ---------------------------------------------------------------- the packing problem on a histogram


def fillings(counts: dict[int, int], sizes: list[int], room: int, most: int = 24, depth: int = 3) -> list[tuple[int, ...]]:
    """Undominated fillings of `room` from the ascending sizes that have counts, least waste first.

    Sets of up to `depth` lengths in descending order are tried by best fit, then extended greedily; one
    that another can replace item by item is dropped. An exact single fit dominates all others."""
    at = bisect.bisect_right(sizes, room)
    if not at:
        return [()]
    if sizes[at - 1] == room:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {}

    def fits(left: int, top: int, used: tuple[int, ...]) -> int:
        """Index below which sizes fit and are still available."""
        i = bisect.bisect_right(sizes, min(left, top))
        while i and used.count(sizes[i - 1]) >= counts[sizes[i - 1]]:
            i -= 1
        return i

    def extend(used: tuple[int, ...], left: int) -> None:
        """Best fit until nothing fits."""
        while i := fits(left, left, used):
            used, left = (*used, sizes[i - 1]), left - sizes[i - 1]
        found[tuple(sorted(used, reverse=True))] = left

    def walk(used: tuple[int, ...], left: int, top: int, deep: int) -> None:
        i, tried = fits(left, top, used), 0
        while i and tried < most and len(found) < 4 * most:
            s = sizes[i - 1]
            extend((*used, s), left - s)
            if deep > 1:
                walk((*used, s), left - s, s, deep - 1)
            tried += 1
            if 0 in found.values() and tried > 1:
                return
            i = fits(left, s - 1, used)

    walk((), room, room, depth)
    best: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f), [-x for x in f])):
        if not any(len(g) == len(f) and all(a >= b for a, b in zip(g, f, strict=True)) for g in best):
            best.append(f)
        if len(best) == most:
            break
    return best


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences any packing needs: total tokens, and for each cut the items that can't share a sequence."""
    total, most = sum(k * v for k, v in counts.items()), 0
    for cut in [0, *sorted({min(k, capacity - k) for k in counts if k < capacity})]:
        big = [(k, v) for k, v in counts.items() if k > capacity - cut]
        half = [(k, v) for k, v in counts.items() if capacity // 2 < k <= capacity - cut]
        mid = sum(k * v for k, v in counts.items() if cut <= k <= capacity // 2)
        room = sum((capacity - k) * v for k, v in half)
        most = max(most, sum(v for _, v in big) + sum(v for _, v in half) + max(0, -(-(mid - room) // capacity)))
    return max(most, -(-total // capacity))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on the histogram: the first incumbent."""
    counts, out = dict(counts), []
    sizes = sorted(k for k, v in counts.items() if v)
    while sizes:
        top = sizes[-1]
        counts[top] -= 1
        used, left = [top], capacity - top
        while True:
            i = bisect.bisect_right(sizes, left)
            while i and not counts[sizes[i - 1]]:
                i -= 1
            if not i:
                break
            counts[s := sizes[i - 1]] -= 1
            used.append(s)
            left -= s
        times = 1 + min(counts[s] // used.count(s) for s in set(used))
        for s in set(used):
            counts[s] -= (times - 1) * used.count(s)
            if not counts[s]:
                del sizes[bisect.bisect_left(sizes, s)]
        out.append((times, tuple(used)))
    return out


def complete(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) that use every count, in as few sequences as were found within `nodes` search
    nodes (the bound on the search, not on the data: the incumbent is always a whole packing). The search
    ends at once when a packing meets the lower bound."""
    counts = {k: v for k, v in counts.items() if v}
    incumbent = best_fit(counts, capacity)
    if not counts:
        return incumbent
    fewest, need, total = sum(t for t, _ in incumbent), lower_bound(counts, capacity), sum(k * v for k, v in counts.items())
    # Each frame: the counts before the choice, the choices left, and what was chosen on the way here.
    left, path, bins, waste, stack = dict(counts), [], 0, 0, []

    def choices() -> Iterator[tuple[int, tuple[int, ...], int]]:
        sizes = sorted(k for k, v in left.items() if v)
        top = sizes[-1]
        left[top] -= 1
        usable = [s for s in sizes if left[s]]
        fills = fillings(left, usable, capacity - top)
        left[top] += 1
        for fill in fills:
            used = (top, *fill)
            times = min(left[s] // used.count(s) for s in set(used))
            for t in dict.fromkeys((times, 1)):
                yield t, used, capacity - sum(used)

    stack.append(choices())
    while stack and fewest > need and nodes:
        nodes -= 1
        step = next(stack[-1], None)
        if step is None or bins + 1 >= fewest + (not path):
            stack.pop()
            if path:
                t, used = path.pop()
                bins, waste = bins - t, waste - t * (capacity - sum(used))
                for s in used:
                    left[s] += t
            continue
        t, used, lost = step
        if waste + t * lost > (fewest - 1) * capacity - total:  # the incumbent allows no more waste
            continue
        for s in used:
            left[s] -= t
        path.append((t, used))
        bins, waste = bins + t, waste + t * lost
        if not any(left.values()):
            if bins < fewest:
                fewest, incumbent = bins, list(path)
            t, used = path.pop()
            bins, waste = bins - t, waste - t * lost
            for s in used:
                left[s] += t
            continue
        stack.append(choices())
    return incumbent


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go by their rank."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, used in patterns:
        offset = 0
        for s in used:
            r = taken.get(s, 0)
            out.append((s, r, r + times, sequence, offset))
            taken[s], offset = r + times, offset + s
        sequence += times
    return out


# ---------------------------------------------------------------- Spark


@lru_cache(maxsize=1)
def encoder(path_json: str, path_ranks: str):
    """Text -> ids as the tokenizers library gives for path_json, special strings included. The ids come from
    the same merges in rank form, which is several times faster; the tests hold both against each other. One
    encoder stays in each worker."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path_ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path_json, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: enc.encode(text, allowed_special="all")


def pieces(docs: DataFrame, capacity: int, end_id: int, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, nth): the row's number among its task's pieces of its length."""
    kind = _parse_datatype_string(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encode = encoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"))
        part, seen, arrow = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), to_arrow_schema(kind)
        for rows, texts in slices(batches, 1):
            out: list[tuple] = []
            for key, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                ids = np.fromiter((i for p in safe_pieces(text, 1 << 16) for i in encode(p)), "<u4") if len(text) > 1 << 16 else np.array(encode(text), "<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for n, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    out.append((key, n, x, y - x, zlib.crc32(ids[x:y].tobytes()), part, int(seen[y - x])))
                    seen[y - x] += 1
            cols = list(zip(*out)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(cols, arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, nodes: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; a longer one than `capacity` is cut into pieces of that length, of which
    only the first may be shorter. Null text: empty, so one piece of one token. Null doc_id and repeated rows
    are packed like others; ties go by task and order in it; an empty table gives no rows."""
    spark = docs.sparkSession
    all_pieces = stash(pieces(docs, capacity, end_id))
    per_part = all_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = slots(complete(histogram, capacity, nodes))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = spark.createDataFrame(plan, "length long, r0 long, r1 long, s0 long, offset long")
    if len(plan) <= 200_000:  # 40 bytes each; bounded by capacity and search, not by the rows
        places = F.broadcast(places)
    ranked = all_pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(places, (ranked["length"] == places["length"]) & (ranked["rank"] >= places["r0"]) & (ranked["rank"] < places["r1"]))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("s0") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
