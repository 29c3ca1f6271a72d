"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, greedy graph search.

The graph is over the directions of distinct vectors, whatever their norms. It starts from blocks of vectors that
random projections put next to each other; then each round joins every vector's neighbours, in both directions,
with each other and keeps what improves a list. A query starts at its own vector's neighbours and at the best of
the longest vectors, and goes on to the neighbours of the best by inner product found so far, until none of the
best is left unvisited. Every group a task holds has a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import stash, table

EDGE = "u long, v long, s float"


def top(df: DataFrame, key: str, by: str, tie: str, n: int) -> DataFrame:
    """The n rows of each key with the largest `by`; the limit is taken in map tasks first, so hubs don't matter."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part: no null id, no null, zero or non-finite vector, of the most
    common dimension; a repeated vec_id counts once."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    v = vectors.select("vec_id", e.alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)
    dim = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.filter(F.size("embedding") == (dim["d"] if dim else 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def blocks(points: DataFrame, dim: int, n: int, trees: int, size: int, k: int) -> DataFrame:
    """u, v, s: for each of several random projections, the k nearest of every vector within its block. Points
    are sorted by sign bits and one projection and cut into blocks of `size`, whatever their distribution."""
    bits = max(0, int(np.log2(max(1, n / size))))
    planes = np.random.default_rng(11).normal(size=(trees, bits + 1, dim)).astype("f4")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            x = np.frombuffer(b"".join(raw), "<f2").reshape(-1, dim).astype("f4")
            for t in range(trees):
                p = x @ planes[t].T
                code = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype("i8") if bits else np.zeros(len(x), "i8")
                # Neighbouring codes in the sort differ in few signs: the code is read as a Gray code.
                shift = 1
                while shift < max(1, bits):
                    code ^= code >> shift
                    shift *= 2
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, "i4")), pa.array(code), pa.array(p[:, bits].astype("f8")), b.column(0), b.column(1)], names=["tree", "code", "at", "u", "vec"])

    placed = points.mapInArrow(place, "tree int, code long, at double, u long, vec binary")
    parts = max(1, min(4096, -(-n * trees // (size * 16))))
    placed = placed.repartitionByRange(parts, "tree", "code", "at", "u").sortWithinPartitions("tree", "code", "at", "u")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows])
            x = np.frombuffer(b"".join(r[1] for r in rows), "<f2").reshape(-1, dim).astype("f4")
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            kk = min(k, len(ids) - 1)
            at = np.argpartition(-s, kk - 1, axis=1)[:, :kk] if kk else np.zeros((len(ids), 0), int)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kk)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(s, at, 1).ravel().astype("f4"))], names=["u", "v", "s"])

        last = None
        for b in batches:
            for t, u, vec in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if held and (t != last or len(held) == size):
                    yield block(held)
                    held = []
                held.append((u, vec))
                last = t
        if held:
            yield block(held)

    return placed.mapInArrow(near, EDGE)


def refine(points: DataFrame, graph: DataFrame, dim: int, n: int, k: int, emit: int) -> DataFrame:
    """One round of NN-descent: u, v, s with what joining neighbours of neighbours improves."""
    groups = max(1, n // 64)
    worst = graph.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("have")).select("u", F.when(F.col("have") >= k, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    near = top(graph.unionByName(back).dropDuplicates(["u", "v"]), "u", "s", "v", k)
    full = points.join(worst, "u").select(F.col("u").alias("v"), "vec", "worst")
    hoods = near.select("u", "v").join(full, "v").withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        ids, worst = pdf.v.to_numpy(), pdf.worst.to_numpy()
        x = np.frombuffer(b"".join(pdf.vec), "<f2").reshape(-1, dim).astype("f4")
        cuts = np.flatnonzero(np.diff(pdf.u.to_numpy())) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, -np.inf)
            kk = min(emit, b - a - 1)
            if kk < 1:
                continue
            at = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            v = np.take_along_axis(s, at, 1)
            i, j = np.nonzero(v > worst[a:b, None])
            out.append((ids[a:b][i], ids[a:b][at[i, j]], v[i, j]))
        if not out:
            return pd.DataFrame({"u": [], "v": [], "s": []}).astype({"u": "int64", "v": "int64", "s": "float32"})
        return pd.DataFrame({"u": np.concatenate([o[0] for o in out]), "v": np.concatenate([o[1] for o in out]), "s": np.concatenate([o[2] for o in out]).astype("f4")}).drop_duplicates(["u", "v"])

    better = hoods.groupBy("g").applyInPandas(local, EDGE)
    return top(graph.unionByName(better).groupBy("u", "v").agg(F.max("s").alias("s")), "u", "s", "v", k)


def build_graph(points: DataFrame, dim: int, n: int, k: int = 32, trees: int = 48, size: int = 512, keep: int = 6, rounds: int = 2, emit: int = 8) -> DataFrame:
    """u, v, s: the k near neighbours of every point (u, vec: unit vectors as half floats). Each of `trees` block
    orders gives the `keep` nearest in the block; two rounds of NN-descent, one more at each doubling from 2^16."""
    rounds += max(0, int(np.ceil(np.log2(max(1, n) / (1 << 16)))))
    few = n <= size  # one block compares all
    graph = stash(top(blocks(points, dim, n, 1 if few else trees, size, k if few else keep).dropDuplicates(["u", "v"]), "u", "s", "v", k))
    if not few:
        for _ in range(rounds):
            graph = stash(refine(points, graph, dim, n, k, emit))
    return graph


#: Vectors of largest norm that every query is held against: they lead by inner product in any direction.
HEAD = 512

STATE = "q long, g long, vec binary, ids binary, scores binary, seen binary, open int"


def search(queries: DataFrame, items: DataFrame, graph: DataFrame, head: list, k: int = 20, width: int = 160, step: int = 16) -> DataFrame:
    """q, v: the `width` best items found for each query (q, vec), q being itself an item; head (u, vec) are the
    items that every query is held against at its start. Vectors are single floats, so scores are near.

    Greedy search over the graph's edges in both directions, `step` unvisited best items a round, until none of
    the `width` best is unvisited."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    edges = stash(top(graph.unionByName(back).dropDuplicates(["u", "v"]), "u", "s", "v", k + k // 4).select("u", "v"))
    vectors = items.select(F.col("u").alias("x"), F.col("vec").alias("xvec"))
    n = queries.count()
    if not n:
        return queries.select("q", F.col("q").alias("v"))
    head_ids, head_vecs = np.array([h["u"] for h in head], "i8"), np.stack([np.frombuffer(h["vec"], "<f4") for h in head])
    groups = max(1, n // 32)

    def advance(state: pd.DataFrame, found: pd.DataFrame, visited: bool) -> pd.DataFrame:
        by = {q: (f.x.to_numpy(), np.frombuffer(b"".join(f.xvec), "<f4").reshape(len(f), -1)) for q, f in found.groupby("q")}
        rows = []
        for r in state.itertuples():
            ids, scores, seen = (np.frombuffer(x, t) for x, t in ((r.ids, "<i8"), (r.scores, "<f8"), (r.seen, bool)))
            seen = seen.copy()
            if visited:
                seen[np.flatnonzero(~seen)[:step]] = True
            if r.q in by:
                x, vec = by[r.q]
                new = ~np.isin(x, ids)
                ids, scores, seen = np.concatenate([ids, x[new]]), np.concatenate([scores, vec[new] @ np.frombuffer(r.vec, "<f4")]), np.concatenate([seen, np.zeros(new.sum(), bool)])
                best = np.lexsort((ids, -scores))[:width]
                ids, scores, seen = ids[best], scores[best], seen[best]
            rows.append((r.q, r.g, r.vec, ids.tobytes(), scores.tobytes(), seen.tobytes(), int((~seen).sum())))
        return pd.DataFrame(rows, columns=["q", "g", "vec", "ids", "scores", "seen", "open"])

    def start(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return advance(state, found, False)  # the head is still to be visited

    def go_on(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return advance(state, found, True)

    def frontier(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [(q, np.frombuffer(i, "<i8")[np.flatnonzero(~np.frombuffer(s, bool))[:step]]) for q, i, s in zip(b.q, b.ids, b.seen, strict=True)]
            yield pd.DataFrame({"q": np.concatenate([np.full(len(u), q, "i8") for q, u in at] or [np.zeros(0, "i8")]), "u": np.concatenate([u for _, u in at] or [np.zeros(0, "i8")])})

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, g, vec in zip(b.q, b.g, b.vec, strict=True):
                s = (head_vecs @ np.frombuffer(vec, "<f4")).astype("f8")
                best = np.lexsort((head_ids, -s))[:width]
                rows.append((q, g, vec, head_ids[best].tobytes(), s[best].tobytes(), np.zeros(len(best), bool).tobytes(), len(best)))
            yield pd.DataFrame(rows, columns=["q", "g", "vec", "ids", "scores", "seen", "open"])

    state = queries.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"), "vec").mapInPandas(begin, STATE)
    first = True
    while True:
        if first:  # a query starts at its own item and that item's neighbours
            own = queries.select(F.col("q").alias("u"))
            reached = own.select(F.col("u").alias("q"), "u").unionByName(own.join(edges, "u").select(F.col("u").alias("q"), F.col("v").alias("u")))
        else:
            reached = state.filter("open > 0").mapInPandas(frontier, "q long, u long").join(edges, "u").select("q", F.col("v").alias("u"))
        reached = reached.distinct().join(vectors, F.col("u") == F.col("x")).select("q", "x", "xvec", F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"))
        state = stash(state.groupBy("g").cogroup(reached.groupBy("g")).applyInPandas(start if first else go_on, STATE))
        first = False
        if state.filter("open > 0").isEmpty():
            break

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(i, "<i8") for i in b.ids]
            yield pd.DataFrame({"q": np.repeat(b.q.to_numpy(), [len(i) for i in ids]), "v": np.concatenate(ids or [np.zeros(0, "i8")])})

    return state.mapInPandas(unpack, "q long, v long")


def nearest(vectors: DataFrame, k: int = 20, query_if: str = "vec_id % 20 = 0", degree: int = 32, width: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets query_if, the k others of largest inner product.

    Ties go to the smaller vec_id. Equal vectors are one point of the graph and are all answered. Rows without a
    usable vector take no part (see usable); with fewer than k candidates all that the graph reaches are given;
    an empty table gives no rows. Extra columns are ignored."""
    rows = stash(usable(vectors))
    point = rows.groupBy("embedding").agg(F.min("vec_id").alias("u"))
    member = stash(rows.join(point, "embedding").select("vec_id", "u", "embedding"))
    peak = F.array_max(F.transform("embedding", F.abs))
    norm = peak * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / peak) * (x / peak)))
    stats = member.agg(F.max(norm).alias("m"), F.max(F.size("embedding")).alias("d"), F.countDistinct("u").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return rows.sparkSession.createDataFrame([], schema)
    dim, longest = int(stats["d"]), float(stats["m"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, dim)
            x /= np.abs(x).max(1, keepdims=True, initial=0)  # so that squares neither vanish nor overflow
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            norm = b.column(2).to_numpy()
            item, turned = (unit * (norm / longest)[:, None]).astype("<f4"), unit.astype("<f2")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (turned, item, unit.astype("<f4")))], names=["u", "norm", "way", "vec", "ask"])

    exact = member.filter("vec_id = u").select("u", "embedding")
    points = stash(exact.withColumn("norm", norm).mapInArrow(pack, "u long, norm double, way binary, vec binary, ask binary"))
    graph = build_graph(points.select("u", F.col("way").alias("vec")), dim, int(stats["n"]), degree)
    head = points.orderBy(F.desc("norm"), "u").limit(HEAD).select("u", "vec").collect()
    asked = member.filter(query_if).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))
    queries = stash(asked.select("q").distinct().join(points.select(F.col("u").alias("q"), F.col("ask").alias("vec")), "q"))
    found = search(queries, points.select("u", "vec"), graph, head, degree, max(width, k + 1))
    left, right = exact.select(F.col("u").alias("q"), F.col("embedding").alias("eq")), exact.select(F.col("u").alias("v"), F.col("embedding").alias("ev"))
    product = F.aggregate(F.zip_with("eq", "ev", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    found = found.join(left, "q").join(right, "v").select("q", "v", product.alias("score"))
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    close = top(member.select("vec_id", "u", F.lit(0).alias("z")), "u", "z", "vec_id", k + 1).select("vec_id", F.col("u").alias("v"))
    pairs = asked.join(found, "q").join(close, "v").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
