"""Search and answer, end to end, for many questions at once.

search: vector and lexical lists, fusion, exact articles, reranking, diversification, labels. ask: search, entry
routing, the decision to answer, prompt, generation, checks of what is cited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import providers
from ..functions import metadata
from ..functions.questions import comparison, sub_questions
from . import citations, decide as dc, entries as en, retrieve as rt


@dataclass(frozen=True)
class Settings:
    k: int = 5
    candidates: int = 100
    rerank: bool = True
    penalty: float = 0.08
    protect: int = 2
    split: bool = False
    line_least: float = 0.05
    threshold: float = dc.THRESHOLD

    def __post_init__(self) -> None:
        if not 1 <= self.k <= 50:
            raise ValueError("k must be from 1 to 50")

    @property
    def candidate_k(self) -> int:
        return max(self.candidates, self.k) if self.rerank else max(4 * self.k, 10)

    @property
    def dense_k(self) -> int:
        return max(4 * self.k, self.k + 10) if self.penalty > 0 else self.k


@dataclass(frozen=True)
class Corpus:
    """documents (document_id, title, filename, status, legal_level, validity, doc_number), chunks (chunk_id,
    document_id, chunk_index, article_number, article_int, content, enabled, embedding) and the chunks' lexical index
    (of enabled ones); entries, if any, as entries.route reads them, with citations."""

    documents: DataFrame
    chunks: DataFrame
    index: rt.Index
    entries: DataFrame | None = None


def asked_of(questions: DataFrame) -> DataFrame:
    """Questions that ask something."""
    return questions.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def candidates(corpus: Corpus, questions: DataFrame, n: int) -> DataFrame:
    """The fused list of both ways: query_id, chunk_id, source, score, fused, rank and each way's rank and score."""
    enabled = corpus.chunks.filter("enabled")
    vector = rt.vector_search(enabled, questions, n)
    lexical = rt.bm25(corpus.index, questions, n)
    return rt.fuse([("vector", vector), ("bm25", lexical)]).filter(F.col("rank") <= n)


def decorated(hits: DataFrame, corpus: Corpus) -> DataFrame:
    """hits with their chunk's and document's fields and labels, and what their score means."""
    meta = corpus.documents.select("document_id", F.col("title").alias("document_title"), "legal_level", "validity", "doc_number")
    rows = hits.join(meta, "document_id", "left")
    kind = F.when(F.col("source") == "exact", "exact").when(F.col("rerank_score").isNotNull(), "rerank").otherwise("fused")
    validity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in metadata.VALIDITY.items() for x in kv]), F.when(F.coalesce("validity", F.lit("")) == "", "effective").otherwise(F.col("validity"))), F.lit("效力未知"))
    return rows.withColumns({"legal_level_label": metadata.level_label(F.col("legal_level")), "validity_label": validity, "score_kind": kind})


def search(corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), score: Column | None = None) -> DataFrame:
    """questions (query_id, text, embedding) -> hits: query_id, final_rank, chunk_id, document_id, article_number,
    content, source, score, rerank_score, score_kind and labels. Exact articles come first and are never cut; blank
    questions have no hits. score: a reranker's column over question and text."""
    s, q = settings, asked_of(questions)
    fused = candidates(corpus, q, s.candidate_k)
    body = corpus.chunks.select("chunk_id", "document_id", "article_number", F.col("content").alias("text"))
    hits = fused.select("query_id", "chunk_id", "source", "score", "rank").join(body, "chunk_id").join(q.select("query_id", F.col("text").alias("question")), "query_id")
    if s.rerank:
        ranked = rt.rerank(hits, s.dense_k, score).withColumn("score", F.col("rerank_score")).withColumn("rank", F.col("rank_after"))
    else:
        ranked = hits.withColumn("rerank_score", F.lit(None).cast("double")).filter(F.col("rank") <= s.dense_k)
    ranked = ranked.select("query_id", "chunk_id", "document_id", "article_number", F.col("text").alias("content"), "source", "score", "rerank_score", F.col("rank").cast("int").alias("rank"))
    cited = citations.parse_citations(q, citations.document_refs(corpus.documents)).filter("usable")
    exact = citations.cited_pieces(cited, corpus.chunks)
    fixed = exact.join(corpus.chunks.select("chunk_id", "article_number", "content"), "chunk_id").select("query_id", "chunk_id", "document_id", "article_number", "content", F.lit("exact").alias("source"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("rerank_score"), F.col("piece").alias("rank"))
    rest = ranked.join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    if s.split:
        forced = coverage(hits, q, s.line_least)
        rest = rest.join(forced.select("query_id", "chunk_id", F.col("line")), ["query_id", "chunk_id"], "left").withColumn("rank", F.when(F.col("line").isNotNull(), F.lit(0)).otherwise(F.col("rank"))).drop("line")
    n = exact.groupBy("query_id").agg(F.count("*").alias("n_exact"))
    spread = rt.diversify(rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))), s.k, s.penalty, s.protect)
    spread = spread if "final_rank" in spread.columns else spread.withColumnRenamed("rank", "final_rank")
    spread = spread.withColumnRenamed("final_rank", "rank").join(n, "query_id", "left").filter(F.col("rank") <= s.k - F.coalesce("n_exact", F.lit(0))).drop("n_exact")
    both = fixed.withColumn("tier", F.lit(0)).unionByName(spread.withColumn("tier", F.lit(1)))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank", "chunk_id"))
    return decorated(both.withColumn("final_rank", rn).drop("tier", "rank"), corpus)


def coverage(hits: DataFrame, questions: DataFrame, least: float) -> DataFrame:
    """query_id, line, chunk_id: of each sub-question's line the candidate that answers it best, if it reaches least."""
    subs = questions.select("query_id", F.posexplode(sub_questions(F.col("text"))).alias("line", "sub"))
    rows = hits.join(subs, "query_id").withColumn("fit", F.round(rt.overlap(F.col("sub"), F.col("text")), 6)).filter(F.col("fit") >= least)
    rn = F.row_number().over(Window.partitionBy("query_id", "line").orderBy(F.desc("fit"), "rank"))
    return rows.withColumn("rn", rn).filter("rn = 1").select("query_id", "line", "chunk_id").dropDuplicates(["query_id", "chunk_id"])


def ask(corpus: Corpus, questions: DataFrame, settings: Settings = Settings(), generator: providers.Batch | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per question: query_id, refused, kind, evidence, message, conclusion, reason, cited (chunk ids),
    unknown (labels that mean none) and uncited. history (query_id, past) goes into the prompt. Refused questions and
    failed generations are rows too."""
    q = questions.withColumn("text", F.coalesce("text", F.lit("")))
    hits = search(corpus, q, settings)
    cites = citations.parse_citations(q, citations.document_refs(corpus.documents)).select("query_id", F.col("usable").alias("cites"))
    source = F.concat_ws(" ", "document_title", "legal_level_label", "validity_label", "article_number")
    g = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.count_if(F.col("source") == "exact").alias("cited_hits"), F.max("rerank_score").alias("best"),
        F.array_sort(F.collect_list(F.struct("final_rank", source.alias("source"), "content", "chunk_id"))).alias("found"),
    )
    rows = q.select("query_id", "text").join(g, "query_id", "left").join(cites, "query_id", "left")
    if corpus.entries is not None:
        routed = en.route(q, corpus.entries).select("query_id", "slug")
        rows = rows.join(routed, "query_id", "left")
    else:
        rows = rows.withColumn("slug", F.lit(None).cast("string"))
    rows = rows.join(history.select("query_id", "past"), "query_id", "left") if history is not None else rows.withColumn("past", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<final_rank:int,source:string,content:string,chunk_id:bigint>>")
    rows = rows.withColumns({"hits": F.coalesce("hits", F.lit(0)), "cited_hits": F.coalesce("cited_hits", F.lit(0)), "found": F.coalesce("found", none)})
    d = dc.decide(F.col("hits"), F.lit(False), F.coalesce("cites", F.lit(False)), F.col("cited_hits"), F.col("slug").isNotNull(), F.col("best"), settings.threshold)
    rows = rows.withColumn("d", d).withColumn("prompt", F.when(~F.col("d.refuse"), dc.prompt(F.col("text"), F.col("found"), F.coalesce("past", F.array().cast("array<string>")))))
    plain = rows.select("query_id", "text", "prompt", F.to_json("d").alias("d"), F.transform("found", lambda x: x["chunk_id"]).alias("ids"))
    said = providers.generate(plain.filter("prompt IS NOT NULL").select("query_id", "prompt"), generator).select("query_id", "raw")
    out = plain.join(said, "query_id", "left").withColumn("d", F.from_json("d", "refuse boolean, kind string, evidence string")).withColumn("a", dc.parse_answer(F.col("raw")))
    r = dc.restore(F.col("a.citations"), F.size("ids"))
    out = out.withColumn("r", r).withColumn("abstains", dc.abstains(F.col("a.conclusion")))
    kind = F.when(~F.col("d.refuse") & F.col("abstains"), "model_abstain").otherwise(F.col("d.kind"))
    return out.select(
        "query_id", (F.col("d.refuse") | F.col("abstains")).alias("refused"), kind.alias("kind"), "d.evidence", dc.message(kind).alias("message"), "a.conclusion", "a.reason",
        F.transform("r.positions", lambda i: F.get("ids", i - 1)).alias("cited"), "r.unknown", F.coalesce(dc.no_citation(F.col("a.conclusion"), F.col("a.citations")), F.lit(False)).alias("uncited"),
        F.coalesce(comparison(F.col("text")), F.lit(False)).alias("compares"),
    )


def rewritten(question: Column, proposed: Column, has_history: Column) -> Column:
    """A model's rewording of a question in a conversation, where it is one: 2 to 200 characters, with history."""
    p = F.trim(F.coalesce(proposed, F.lit("")))
    return F.when(F.coalesce(has_history, F.lit(False)) & F.length(p).between(2, 200), p).otherwise(question)
