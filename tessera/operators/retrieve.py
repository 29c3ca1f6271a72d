"""Lexical and vector retrieval of many questions at once, fusion, reranking, exact lookup and diversification.

Ranking works on narrow rows (query, chunk, score); texts are joined to final hits only. Questions are the
small side of each join: they are broadcast after a check of their number, else the join shuffles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TOKEN = r"[a-z0-9][a-z0-9._:/\-()]*"
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
#: Question rows (terms or vectors) that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Tokens of a block of the lexical index, about; a longer chunk is a block of its own.
BLOCK_TOKENS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, counted first, are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tokens(text: Column) -> Column:
    """Latin tokens in order, then of each CJK run its bigrams and its single characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    singles = lambda r: F.filter(F.split(r, ""), lambda c: c != "")
    return F.concat(latin, F.flatten(F.transform(runs, lambda r: F.concat(pairs(r), singles(r)))))


def lexical_text(filename: Column, title: Column, section: Column, article: Column, content: Column) -> Column:
    """What the index reads of a chunk: names twice, section once, a leading article number three times."""
    lead = F.when(F.startswith(content, article), F.array_repeat(article, 3)).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.array_repeat(filename, 2), F.array_repeat(title, 2), section, lead, content)


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """block, term, keys, dls, tfs, docs, length: of each block of chunks, which is named by its first key, a row for
    each term, sorted, with the chunks that hold it, their lengths and counts. A block's first row counts its chunks
    and their tokens in docs and length, the others 0. Chunks without a token have no place. Nothing is shuffled."""
    of = chunks.schema[key].dataType.simpleString()

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        terms = b.column(1)
        dl = np.diff(terms.offsets.to_numpy())
        words = terms.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair, tf = np.unique(place[words.indices.to_numpy()] * len(b) + np.repeat(np.arange(len(b)), dl), return_counts=True)
        term, row = np.divmod(pair, len(b))
        at = pa.array(np.searchsorted(term, np.arange(len(order) + 1)), pa.int32())
        first = np.zeros((2, len(order)), np.int64)
        first[:, 0] = len(b), dl.sum()
        lists = (b.column(0).take(pa.array(row)), pa.array(dl[row], pa.int32()), pa.array(tf, pa.int32()))
        block = pa.repeat(b.column(0)[0], len(order))
        return pa.RecordBatch.from_arrays([block, words.dictionary.take(pa.array(order)), *(pa.ListArray.from_arrays(at, x) for x in lists), *map(pa.array, first)], names=["block", "term", "keys", "dls", "tfs", "docs", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, at = b.column(1).offsets.to_numpy(), 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_TOKENS, "right")) - 1)
                yield counted(b.slice(at, to - at))
                at = to

    t = chunks.select(F.col(key), tokens(F.col(text)).alias("terms")).filter(F.size("terms") > 0)
    return t.mapInArrow(run, f"block {of}, term string, keys array<{of}>, dls array<int>, tfs array<int>, docs long, length long")


def term_weights(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) with the floor for terms of more than half of the chunks, and one row of n and avgdl."""
    corpus = post.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), (F.sum("length") / F.sum("docs")).alias("avgdl"))
    df = post.groupBy("term").agg(F.sum(F.size("keys")).alias("df")).crossJoin(F.broadcast(corpus))  # one row
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), corpus


def ranked(df: DataFrame, by: str, n: int, tie: str = "chunk_id", to: str = "rank") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), tie))
    return df.withColumn(to, rn).filter(F.col(to) <= n)


@dataclass(frozen=True)
class Index:
    """A lexical index: postings by blocks of chunks, term weights, one row of n and avgdl."""

    post: DataFrame
    terms: DataFrame
    corpus: DataFrame


def version_of(files: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that a scan reads: an index of other files is stale."""
    m = files.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    h = m.agg(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{int(h['h'] or 0) & (2**64 - 1):016x}-{h['n']}"


def build_index(chunks: DataFrame, path: str, key: str = "chunk_id", text: str = "text") -> Index:
    """Write the index of chunks to path: postings by blocks of chunks, where they are counted; weights and corpus
    figures beside them."""
    spark = chunks.sparkSession
    postings(chunks, key, text).write.mode("overwrite").parquet(f"{path}/post")
    terms, corpus = term_weights(spark.read.parquet(f"{path}/post"))
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("post", "terms", "corpus")))


def fresh_index(chunks: DataFrame, files: DataFrame, folder: str, key: str = "chunk_id", text: str = "text") -> Index:
    """The index of chunks in folder, built again only if the files behind them (a file scan) have changed."""
    spark, path = chunks.sparkSession, f"{folder}/index-blocks-{version_of(files)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/terms/_SUCCESS")
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return open_index(spark, path)
    return build_index(chunks, path, key, text)


def bm25(chunks: DataFrame | Index, queries: DataFrame, k: int = 10, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """query_id, chunk_id, score, rank: Okapi weights; a term that a question repeats counts each time; scores of
    zero or less are no hits; ties go to the smaller chunk_id. chunks: their index, or rows to index for this call."""
    if isinstance(chunks, Index):
        post, idf, corpus = chunks.post, chunks.terms, chunks.corpus
    else:
        post = postings(chunks, key, text)
        idf, corpus = term_weights(post)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(idf, "term").groupBy("term").agg(F.collect_list(F.struct("query_id", (F.col("times") * F.col("idf")).alias("weight"))).alias("asked"))
    hits = post.select("block", "term", "keys", "dls", "tfs").join(small(asked), "term").crossJoin(F.broadcast(corpus))  # one row
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *post.schema)}

    def best(table: pa.Table) -> pa.Table:
        """The k best of a block's chunks for each question; the sums are over one block, so in one place."""
        avgdl = table.column("avgdl")[0].as_py()
        keys, dls, tfs = (table.column(c).combine_chunks() for c in ("keys", "dls", "tfs"))
        ends, asks = np.r_[0, np.cumsum(pc.list_value_length(keys).to_numpy())], table.column("asked").combine_chunks()
        words = keys.flatten().dictionary_encode()
        names, place = words.dictionary, words.indices.to_numpy()
        rank = np.argsort(pc.sort_indices(names).to_numpy())
        tf, dl = tfs.flatten().to_numpy(), dls.flatten().to_numpy()
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        who = asks.flatten().field("query_id").dictionary_encode()
        q, row = who.indices.to_numpy(), np.repeat(np.arange(len(asks)), pc.list_value_length(asks).to_numpy())
        weight = asks.flatten().field("weight").to_numpy()
        out_q, out_c, out_s = [], [], []
        turns = np.argsort(q, kind="stable")
        for i, mine in enumerate(np.split(turns, np.searchsorted(q[turns], np.arange(1, len(who.dictionary))))):
            at = np.concatenate([np.arange(ends[row[j]], ends[row[j] + 1]) for j in mine])
            w = np.repeat(weight[mine], ends[row[mine] + 1] - ends[row[mine]])
            s = np.round(np.bincount(place[at], w * part[at], len(names)), 6)
            good = np.flatnonzero(s > 0)
            if len(good) > k:  # what can be among the k best, ties with the last of them too
                good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
            good = good[np.lexsort((rank[good], -s[good]))[:k]]
            out_q.append(np.full(len(good), i))
            out_c.append(good)
            out_s.append(s[good])
        return pa.table({"query_id": who.dictionary.take(pa.array(np.concatenate(out_q))), "chunk_id": names.take(pa.array(np.concatenate(out_c))), "score": np.concatenate(out_s)})

    scored = hits.groupBy("block").applyInArrow(best, f"query_id {kinds['query_id']}, chunk_id {kinds['block']}, score double")
    return ranked(scored, "score", k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_search(items: DataFrame, queries: DataFrame, k: int = 10, where: str | None = None, block: int = 2048) -> DataFrame:
    """query_id, chunk_id, score, rank of exact cosine (0 for a zero vector). where filters items before ranking.

    Questions are a stated set, held against all items: both are cut into blocks of vectors, every item block meets
    every question block as two matrices, and keeps the best k of each question, so little is shuffled."""

    def packed(df: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), block):
                    b = batch.slice(at, block)
                    x = np.array(b.column(1).to_pylist(), "<f8")
                    norm = np.sqrt((x * x).sum(1, keepdims=True))
                    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([b.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), "vecs": pa.array([unit.tobytes()], pa.binary())})

        return df.filter("embedding IS NOT NULL").select(key, "embedding").mapInArrow(run, "ids binary, vecs binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vecs, q_ids, q_vecs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                i, q = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                s = np.round(np.frombuffer(q_vecs, "<f8").reshape(len(q), -1) @ np.frombuffer(vecs, "<f8").reshape(len(i), -1).T, 6) + 0.0  # no negative zero
                if len(i) > k:  # the k best and what ties with the last of them
                    last = np.partition(s, len(i) - k, axis=1)[:, len(i) - k]
                    row, col = np.nonzero(s >= last[:, None])
                else:
                    row, col = np.divmod(np.arange(s.size), len(i))
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(i[col]), pa.array(s[row, col])], names=["query_id", "chunk_id", "score"])

    asked = packed(queries, "query_id").select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    pairs = packed(items.filter(where) if where else items, "chunk_id").join(F.broadcast(asked) if queries.count() <= BROADCAST_ROWS else asked, F.lit(True))
    return ranked(pairs.mapInArrow(score, "query_id long, chunk_id long, score double"), "score", k)


def fuse(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, score, rank): fused, per-list ranks and scores,
    source (hybrid, or the only list's name) and score (fused when hybrid, else the list's own); equal sums keep
    the order of lists and of ranks in them."""
    rows = None
    for i, (name, df) in enumerate(lists):
        part = df.select("query_id", "chunk_id", F.lit(i).alias("list"), F.lit(name).alias("name"), F.col("score").cast("double").alias("score"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    per = [e for name, _ in lists for e in (F.min(F.when(F.col("name") == name, F.col("rank"))).alias(f"{name}_rank"), F.max(F.when(F.col("name") == name, F.col("score"))).alias(f"{name}_score"))]
    g = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("fused"), F.count_distinct("name").alias("n"), F.min_by("name", "list").alias("only"), F.min_by("score", "list").alias("own"), F.min(F.struct("list", "rank")).alias("first"), *per)
    g = g.withColumn("source", F.when(F.col("n") > 1, F.lit("hybrid")).otherwise(F.col("only"))).withColumn("score", F.when(F.col("n") > 1, F.col("fused")).otherwise(F.col("own")))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "first", "chunk_id"))
    return g.withColumn("rank", rn).select("query_id", "chunk_id", "source", "score", "fused", "rank", *(c for name, _ in lists for c in (f"{name}_rank", f"{name}_score")))


def overlap(question: Column, text: Column) -> Column:
    """The local reranker: the share of the question's distinct tokens that the text holds."""
    q, t = F.array_distinct(tokens(question)), F.array_distinct(tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, k: int = 5, score: Column | None = None) -> DataFrame:
    """hits (query_id, chunk_id, rank, question, text) in order of the reranker's score, with ranks before and
    after and whether the hit moved. score: any provider's column."""
    s = score if score is not None else overlap(F.col("question"), F.col("text"))
    rows = hits.withColumn("rerank_score", F.round(s, 6)).withColumnRenamed("rank", "rank_before")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank_before"))
    return rows.withColumn("rank_after", rn).filter(F.col("rank_after") <= k).withColumn("moved", F.col("rank_after") != F.col("rank_before"))


def exact_first(exact: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """All exact hits (query_id, chunk_id, piece), then other hits by rank, to k in all; exact hits aren't cut."""
    rest = hits.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rows = exact.select("query_id", "chunk_id", F.lit(0).alias("tier"), F.col("piece").alias("at")).unionByName(rest.select("query_id", "chunk_id", F.lit(1).alias("tier"), F.col("rank").alias("at")))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "at", "chunk_id"))
    return rows.withColumn("rank", rn).filter(F.expr(f"tier = 0 OR rank <= {k}")).select("query_id", "chunk_id", F.when(F.col("tier") == 0, "exact").otherwise("ranked").alias("source"), "rank")


def diversify(hits: DataFrame, k: int, penalty: float = 0.08, protect: int = 2) -> DataFrame:
    """The first `protect` hits stay; others lose `penalty` for each hit of their document before them. In one
    document the lowered scores fall strictly, so greedy choice is a sort."""
    if penalty <= 0:
        return hits
    fixed = hits.filter(F.col("rank") <= protect)
    seen = fixed.groupBy("query_id", "document_id").agg(F.count("*").alias("seen"))
    nth = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.desc("s"), "rank"))
    rest = hits.filter(F.col("rank") > protect).withColumn("s", F.coalesce("score", F.lit(0.0))).withColumn("nth", nth)
    rest = rest.join(seen, ["query_id", "document_id"], "left").withColumn("lowered", F.col("s") - penalty * (F.coalesce("seen", F.lit(0)) + F.col("nth") - 1))
    cols = [c for c in hits.columns if c != "rank"]
    rows = fixed.select(*cols, F.lit(0).alias("tier"), F.lit(0.0).alias("lowered"), "rank").unionByName(rest.select(*cols, F.lit(1).alias("tier"), "lowered", "rank"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc(F.round("lowered", 9)), "rank"))
    return rows.withColumn("final_rank", rn).filter(F.col("final_rank") <= k).select(*cols, "final_rank")


def article_lookup(asked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """asked (query_id, title, number) -> every enabled piece of that article: equal title, equal number."""
    found = asked.join(documents.select("document_id", "title"), "title").join(chunks.filter("enabled AND article_int IS NOT NULL"), "document_id")
    return found.filter(F.col("article_int") == F.col("number")).select("query_id", "document_id", "chunk_id", "chunk_index", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", "chunk_index")).alias("piece"))


def silent_empty(vector_hits: Column, lexical_hits: Column, probe_ok: Column, vectors: Column, chunks: Column) -> Column:
    """Why nothing was found: null if something was."""
    return F.when((vector_hits > 0) | (lexical_hits > 0), F.lit(None)).when(~probe_ok, F.lit("probe_failed")).when(vectors > 0, F.lit("chain_fault")).when(chunks > 0, F.lit("out_of_sync")).otherwise(F.lit("empty"))
