"""Queries of the core engine by name, each over whole driver tables or small inline tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import metadata, numerals, questions, text as tx
from .. import providers
from ..operators import citations, decide as dc, retrieve as rt, search as se, split as sp, stats as st
from ..sources import loaders, store
from ..streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of documents as chunks."""
    p = T(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return p.filter(F.trim("line") != "")


LINES = "l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER - 1 AS pos FROM documents), l AS (SELECT * FROM l0 WHERE trim(line, ' ') <> '')"
TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9._:/\-()]*')"

# ---------------------------------------------------------------- filters and text


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500 AND source IN ('src1','src2','src3') AND text IS NOT NULL")
def scan_filter_project(spark, d):
    t = T(spark, d, "documents")
    return t.filter((F.col("lang") == "en") & (F.col("n_chars") > 500) & F.col("source").isin("src1", "src2", "src3") & F.col("text").isNotNull()).select("doc_id", "source", "n_chars")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '([a-zA-Z])-\n([a-zA-Z])', '\1\2', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), ' '||chr(10)||chr(9))) AS h FROM documents")
def text_clean_basic(spark, d):
    x = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"([a-zA-Z])-\n([a-zA-Z])", "$1$2")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+(\n|$)", "$1"), r"\n{3,}", "\n\n")
    x = F.regexp_replace(F.regexp_replace(x, r"^[ \n\t]+", ""), r"[ \n\t]+$", "")
    return T(spark, d, "documents").select("doc_id", F.sha2(x, 256).alias("h"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 300))::INTEGER AS n_long FROM documents")
def text_long_lines(spark, d):
    return T(spark, d, "documents").select("doc_id", tx.long_lines(F.col("text")).alias("n_long"))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END::INTEGER AS est FROM documents")
def token_estimate(spark, d):
    return T(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("est"))


@query()
def text_clean_full(spark, d):
    return T(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query()
def pdf_unwrap(spark, d):
    return T(spark, d, "documents").select("doc_id", tx.unwrap_lines(F.col("text")).alias("text"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS file_hash, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def content_dedup(spark, d):
    return T(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "file_hash", "copies")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'xx' ELSE lang END AS lang, source FROM documents")
def override_apply(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang", "source", F.concat_ws("_", "source", "doc_id").alias("filename"))
    v = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("lang"), F.lit(None).cast("string"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("lang"), F.lit("xx"))).otherwise(F.create_map().cast("map<string,string>"))
    changes = docs.select(F.concat_ws("_", "source", "doc_id").alias("filename"), v.alias("values"))
    return loaders.apply_overrides(docs, changes, ["lang"]).select("doc_id", "lang", "source")


# ---------------------------------------------------------------- metadata on inline tables

TITLES = ["证券期货样例管理办法（试行）", "基金样例指引征求意见稿", "衍生工具样例规则", "样例标准 T/SAC 00X", "期货样例条例"]
_TITLES = "t(i, text) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(TITLES)) + ")"


def titles(spark):
    return spark.createDataFrame(list(enumerate(TITLES)), "i int, text string")


@query(f"WITH {_TITLES} SELECT i, CASE WHEN regexp_matches(text, '征求意见稿|征求意见|草案|T/[A-Z]+ *0*X') THEN 'draft' ELSE 'effective' END AS validity FROM t")
def metadata_validity(spark, d):
    return titles(spark).select("i", metadata.validity(F.col("text"), F.lit("")).alias("validity"))


@query(f"WITH {_TITLES} SELECT i, array_to_string(list_filter([CASE WHEN text LIKE '%证券%' THEN '证券' END, CASE WHEN text LIKE '%期货%' THEN '期货' END, CASE WHEN text LIKE '%基金%' THEN '基金' END, CASE WHEN text LIKE '%衍生品%' OR text LIKE '%衍生工具%' THEN '衍生品' END], lambda x: x IS NOT NULL), ',') AS scope FROM t")
def metadata_scope(spark, d):
    return titles(spark).select("i", F.array_join(metadata.scope(F.col("text")), ",").alias("scope"))


@query()
def metadata_extract(spark, d):
    t = titles(spark).select("i", F.concat("text", F.lit("\n中国证监会令 第12号 2020年1月2日公布，自2020年3月1日起施行")).alias("text"))
    return t.select("i", metadata.extract(F.col("text"), F.concat(F.lit("样例文件名称_"), F.col("i"), F.lit(".txt"))).alias("m")).select("i", "m.*")


@query("SELECT doc_id, CASE doc_id % 5 + 1 WHEN 1 THEN '法律' WHEN 2 THEN '行政法规' WHEN 3 THEN '部门规章' WHEN 4 THEN '规范性文件' ELSE '自律规则' END AS label, (doc_id % 5 + 1)::INTEGER AS level_rank FROM documents")
def level_lookup(spark, d):
    names = list(metadata.LEVELS)
    level = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 5 + 1).cast("int"))
    return T(spark, d, "documents").select("doc_id", metadata.level_label(level).alias("label"), metadata.level_rank(level).alias("level_rank"))


_SPELL = "s AS (SELECT n, '第' || CASE WHEN n >= 100 THEN substr('一二三四五六七八九', n // 100, 1) || '百' ELSE '' END || CASE WHEN n // 10 % 10 > 0 THEN CASE WHEN n // 10 % 10 = 1 AND n < 100 THEN '十' ELSE substr('一二三四五六七八九', n // 10 % 10, 1) || '十' END WHEN n >= 100 AND n % 10 > 0 THEN '零' ELSE '' END || CASE WHEN n % 10 > 0 THEN substr('一二三四五六七八九', n % 10, 1) ELSE '' END || '条' AS token FROM (SELECT unnest(range(1, 1000))::INTEGER AS n))"


def spelled(spark):
    return spark.createDataFrame([(n, f"第{numerals.spell(n)}条") for n in range(1, 1000)], "n int, token string")


@query(f"WITH {_SPELL} SELECT token, n AS number FROM s")
def numeral_to_int(spark, d):
    return spelled(spark).select("token", numerals.article_number(F.col("token")).alias("number"))


_ARTICLES = f"{LINES}, {_SPELL}, a AS (SELECT l.doc_id, l.pos, CASE WHEN l.pos % 3 = 2 THEN NULL ELSE s.token END AS token, l.line FROM l LEFT JOIN s ON s.n = l.pos % 999 + 1)"


def articles(spark, d):
    """Lines rendered as articles: two of three open with an ordinal."""
    a = lines(spark, d).join(F.broadcast(spelled(spark)), F.col("n") == F.col("pos") % 999 + 1)
    return a.select("doc_id", "pos", F.when(F.col("pos") % 3 != 2, F.col("token")).alias("token"), "line")


@query(f"WITH {_ARTICLES} SELECT doc_id, pos, coalesce(token, '') AS found FROM a")
def article_tokens(spark, d):
    x = articles(spark, d).withColumn("t", F.concat(F.coalesce("token", F.lit("")), F.lit("　"), F.col("line")))
    return x.select("doc_id", "pos", F.array_join(numerals.article_tokens(F.col("t")), ",").alias("found"))


@query(f"WITH {_ARTICLES} SELECT doc_id, pos, last_value(token IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS article_number FROM a")
def article_carry_forward(spark, d):
    x = articles(spark, d).select("doc_id", F.lit(0).alias("section_index"), F.col("pos").alias("start"), F.lit("legal").alias("splitter"), F.col("token").alias("article_number"))
    return sp.number_chunks(x).select("doc_id", F.col("start").alias("pos"), "article_number")


@query(f"WITH {_ARTICLES} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER - 1 AS chunk_index FROM a")
def chunk_index(spark, d):
    order = Window.partitionBy("doc_id").orderBy("pos")
    return articles(spark, d).select("doc_id", "pos", (F.row_number().over(order) - 1).alias("chunk_index"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS chunk_count, round_even(avg(length(line)), 0)::BIGINT AS avg_length, max(length(line))::INTEGER AS max_length, min(length(line))::INTEGER AS min_length, count(*) FILTER (regexp_matches(line, '^[a-z]')) AS broken_count, round_even(count(*) FILTER (regexp_matches(line, '^[a-z]')) / count(*), 4) AS broken_ratio FROM l GROUP BY doc_id")
def chunk_stats(spark, d):
    return sp.chunk_stats(lines(spark, d).select("doc_id", F.col("line").alias("content"), F.col("line").rlike("^[a-z]").alias("broken")))


@query(f"WITH {LINES}, h AS (SELECT *, sum(CASE WHEN pos % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, section::BIGINT AS section, count(*) AS n, sum(length(line))::BIGINT AS chars FROM h GROUP BY ALL")
def section_by_heading(spark, d):
    run = F.sum((F.col("pos") % 5 == 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines(spark, d).withColumn("section", run).groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def _split(name):
    def f(spark, d):
        docs = T(spark, d, "documents").select("doc_id", F.lit(0).alias("section_index"), "text")
        if name == "legal":
            a = articles(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.coalesce("token", F.lit("")), F.lit("　"), "line").alias("t")))).alias("x"))
            docs = a.select("doc_id", F.lit(0).alias("section_index"), F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("text"))
        return sp.number_chunks(sp.split_sections(docs, name))

    f.__name__ = f"split_{name}"
    return f


for _n in ("legal", "semantic", "unstructured", "auto"):
    query()(_split(_n))


@query()
def article_boundaries(spark, d):
    x = articles(spark, d).select("doc_id", F.concat(F.coalesce("token", F.lit("")), F.lit("　"), "line").alias("text"))
    return sp.boundary_audit(x)


@query()
def html_body(spark, d):
    return loaders.load_html_table(T(spark, d, "pages"))


# ---------------------------------------------------------------- retrieval


@query(f"SELECT doc_id, len({TOKENS.format('text')})::INTEGER AS n, sha256(array_to_string({TOKENS.format('text')}, ' ')) AS h FROM documents")
def tokenize_terms(spark, d):
    t = rt.tokens(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


_BM = f"""tok AS (SELECT doc_id, {TOKENS.format("text")} AS terms FROM documents), dl AS (SELECT doc_id, len(terms) AS dl FROM tok WHERE len(terms) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM tf, c GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_QT = f"qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
_SC = "sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY ALL HAVING round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0), bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM sc)"


def chunk_table(spark, d):
    return T(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def question_table(spark, d):
    return T(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark, d):
    """The stored index of whole documents; built at the first call and when the files change."""
    return rt.fresh_index(chunk_table(spark, d), T(spark, d, "documents"), f"{store.shared_folder(spark)}/tessera")


@query(f"WITH {_BM} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index_stats(spark, d):
    return lexical(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM}, {_QT}, {_SC} SELECT query_id, chunk_id, score, rank FROM bm WHERE rank <= 10")
def search_bm25_topk(spark, d):
    return rt.bm25(lexical(spark, d), question_table(spark, d), 10)


_VEC = "v AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0{0}), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM v)"


def vectors(spark, d):
    e = T(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_VEC.format('')} SELECT * FROM vr WHERE rank <= 10")
def search_vector_topk(spark, d):
    return rt.vector_search(*vectors(spark, d), 10)


@query(f"WITH {_VEC.format(' AND e.label = 3')} SELECT * FROM vr WHERE rank <= 10")
def search_vector_filtered(spark, d):
    return rt.vector_search(*vectors(spark, d), 10, "label = 3")


def two_lists(spark, d):
    """BM25 hits and, as the second list, its wider list in another order: fusion alone. search_hybrid fuses vectors."""
    wide = rt.bm25(lexical(spark, d), question_table(spark, d), 20)
    second = rt.ranked(wide.select("query_id", "chunk_id", F.round(1.0 / (1 + F.col("chunk_id") % 17), 6).alias("score")), "score", 10)
    return second, wide.filter("rank <= 10")


_TWO = f"{_BM}, {_QT}, {_SC}, w AS (SELECT * FROM bm WHERE rank <= 20), s0 AS (SELECT query_id, chunk_id, round(1.0 / (1 + chunk_id % 17), 6) AS score FROM w), s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s0), u AS (SELECT query_id, chunk_id, 0 AS list, 'vector' AS name, score, rank FROM s1 WHERE rank <= 10 UNION ALL SELECT query_id, chunk_id, 1, 'bm25', score, rank FROM w WHERE rank <= 10), f0 AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused, count(*) AS n, arg_min(name, list) AS sole, arg_min(score, list) AS own, min(list * 1000 + rank) AS first FROM u GROUP BY ALL), f AS (SELECT query_id, chunk_id, CASE WHEN n > 1 THEN 'hybrid' ELSE sole END AS source, CASE WHEN n > 1 THEN fused ELSE own END AS score, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, chunk_id)::INTEGER AS rank FROM f0)"


@query(f"WITH {_TWO} SELECT * FROM f")
def rrf_fusion(spark, d):
    a, b = two_lists(spark, d)
    return rt.fuse([("vector", a), ("bm25", b)]).select("query_id", "chunk_id", "source", "score", "fused", "rank")


_HY = f"""{_BM}, {_QT}, {_SC}, v0 AS (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e),
v1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM v0), u AS (SELECT query_id, chunk_id, 0 AS list, 'vector' AS name, score, rank FROM v1 WHERE rank <= 100 UNION ALL SELECT query_id, chunk_id, 1, 'bm25', score, rank FROM bm WHERE rank <= 100),
f0 AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS fused, count(*) AS n, arg_min(name, list) AS sole, arg_min(score, list) AS own, min(list * 1000 + rank) AS first FROM u GROUP BY ALL),
f AS (SELECT query_id, chunk_id, CASE WHEN n > 1 THEN 'hybrid' ELSE sole END AS source, CASE WHEN n > 1 THEN fused ELSE own END AS score, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, chunk_id)::INTEGER AS rank FROM f0)"""


@query(f"WITH {_HY} SELECT * FROM f WHERE rank <= 100")
def search_hybrid(spark, d):
    """Vector and lexical lists of 100, fused: a document's vector is the one of its id, a question's likewise."""
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(True).alias("enabled"))
    q = question_table(spark, d).join(e.select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id", "left")
    corpus = se.Corpus(e, e, lexical(spark, d))
    return se.candidates(corpus, q, 100).select("query_id", "chunk_id", "source", "score", "fused", "rank")


def answer_corpus(spark, d):
    docs = T(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    chunks = providers.embed(docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("article_number"), F.lit(None).cast("int").alias("article_int"), text.alias("content"), F.lit(True).alias("enabled")), text="content")
    none = F.lit(None).cast("string")
    documents = docs.select(F.col("doc_id").alias("document_id"), F.concat_ws("_", "source", "doc_id").alias("title"), F.concat("source", F.lit(".txt")).alias("filename"), F.lit("indexed").alias("status"), none.alias("legal_level"), none.alias("validity"), none.alias("doc_number"))
    return se.Corpus(documents, store.written(chunks), lexical(spark, d)), store.written(providers.embed(question_table(spark, d)))


@query()
def search_end_to_end(spark, d):
    corpus, asked = answer_corpus(spark, d)
    return se.search(corpus, asked).select("query_id", "final_rank", "chunk_id", "source", "score", "rerank_score", "score_kind")


@query()
def ask_end_to_end(spark, d):
    corpus, asked = answer_corpus(spark, d)
    return se.ask(corpus, asked)


@query()
def citation_parse(spark, d):
    """Every document's name with an article as a question, against all names."""
    refs = T(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws("_", "source", "doc_id").alias("title"))
    asked = refs.select(F.col("document_id").alias("query_id"), F.concat("title", F.lit("第"), F.pmod("document_id", F.lit(99)) + 1, F.lit("条")).alias("text"))
    return citations.parse_citations(asked, refs).select("query_id", "usable", "number", "document_id", "matched", "reason")


@query("SELECT event_type AS sid, count(*) AS sampled, count(*) FILTER (value > 50) AS with_unknown FROM events GROUP BY ALL")
def fabricated_counts(spark, d):
    e = T(spark, d, "events").withColumn("n_unknown", (F.col("value") > 50).cast("int"))
    return e.groupBy(F.col("event_type").alias("sid")).agg(F.count("*").alias("sampled"), F.count_if(F.coalesce("n_unknown", F.lit(0)) > 0).alias("with_unknown"))


@query("WITH r AS (SELECT doc_id % 5 = 0 AS failed, doc_id % 3 = 0 AS refused, doc_id % 7 = 0 AS says FROM documents) SELECT count(*) AS total, count(*) FILTER (NOT failed) AS valid, count(*) FILTER (NOT failed AND (refused OR says)) AS correct, count(*) FILTER (failed) AS excluded, round(100 * count(*) FILTER (NOT failed AND (refused OR says)) / count(*) FILTER (NOT failed), 1) AS rate FROM r")
def refusal_correctness(spark, d):
    i = F.col("doc_id")
    r = T(spark, d, "documents").select((i % 5 == 0).alias("failed"), (i % 3 == 0).alias("refused"), (i % 7 == 0).alias("says_none"))
    return st.refusal_report(r)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def list_page(spark, d):
    return store.page_of(T(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 20, 20)


@query("WITH q AS (SELECT key, day, event_id, row_number() OVER (PARTITION BY key, day ORDER BY ts, event_id) AS n FROM (SELECT user_id AS key, ts::DATE AS day, ts, event_id FROM events WHERE event_type = 'view')), o AS (SELECT e.user_id AS key, e.event_id, e.ts, ts::DATE AS day, q.n FROM events e LEFT JOIN q USING (event_id)), g AS (SELECT *, sum(CASE WHEN n <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS place FROM o) SELECT event_id, CASE WHEN n > 1 THEN 'key_day' WHEN n <= 1 AND place > 5 THEN 'day' END AS gate FROM g")
def limit_cascade(spark, d):
    """All gates with the minute's wide open, as SQL can't say that one."""
    e = T(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.when(F.col("event_type") == "view", "qa").otherwise("other").alias("kind"))
    return limits.cascade(e, 1_000_000, 1, 5).select("event_id", "gate")


_OVER = "len(list_intersect(list_distinct({q}), list_distinct({t}))) / len(list_distinct({q}))"


@query(f"WITH {_BM}, {_QT}, {_SC}, h AS (SELECT bm.query_id, bm.chunk_id, rank AS rank_before, round({_OVER.format(q=TOKENS.format('b.text'), t=TOKENS.format('d.text'))}, 6) AS rerank_score FROM bm JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank_before)::INTEGER AS rank_after FROM h) SELECT query_id, chunk_id, rank_before, rank_after, rerank_score, rank_before <> rank_after AS moved FROM r WHERE rank_after <= 5")
def rerank_topk(spark, d):
    hits = search_bm25_topk(spark, d).join(chunk_table(spark, d), "chunk_id").join(question_table(spark, d).withColumnRenamed("text", "question"), "query_id")
    return rt.rerank(hits, 5).select("query_id", "chunk_id", "rank_before", "rank_after", "rerank_score", "moved")


@query(f"WITH {_ARTICLES}, c AS (SELECT doc_id, pos, CASE WHEN token IS NOT NULL THEN pos % 999 + 1 ELSE NULL END AS num0 FROM a), k AS (SELECT *, last_value(num0 IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS num FROM c) SELECT doc_id AS query_id, doc_id AS document_id, pos AS chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS piece FROM k WHERE num = 2")
def exact_article_lookup(spark, d):
    carried = F.last("token", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    c = articles(spark, d).select(F.col("doc_id").alias("document_id"), F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), F.col("pos").alias("chunk_index"), numerals.article_number(carried).alias("article_int"), F.lit(True).alias("enabled"))
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.concat_ws("_", "source", "doc_id").alias("title"))
    asked = docs.select(F.col("document_id").alias("query_id"), "title", F.lit(2).alias("number"))
    return rt.article_lookup(asked, c, docs).select("query_id", "document_id", "chunk_index", "piece")


#: Parts of one name in a block of keys, about.
PART_BLOCK = 1024


@query("WITH q AS (SELECT p_partkey AS query_id, p_name || ' specification' AS question FROM part) SELECT query_id, p_partkey, list_max(list_filter(range(5, length(p_name) + 1), lambda k: contains(question, right(p_name, k))))::INTEGER AS n FROM q JOIN part ON length(p_name) >= 5 AND contains(question, right(p_name, 5))")
def title_suffix_match(spark, d):
    """Every part asked about. An ending of 5 or more in the question has its own last 5 there, so names meet by
    those; names are compared once each and stand for all of their parts. These are kept as blocks of keys: pairs of
    blocks are few, are dealt evenly, and become rows where they are used."""
    part = T(spark, d, "part").select("p_partkey", "p_name")
    copies = part.groupBy("p_name").agg(F.count("*").alias("n"))
    names = copies.select("p_name")
    asked = names.select(F.col("p_name").alias("q_name"), F.concat("p_name", F.lit(" specification")).alias("question"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("question") - 4), lambda i: F.substring("question", i, F.lit(5))))
    held = asked.withColumn("tail", F.explode(grams))
    titles = names.filter(F.length("p_name") >= 5).withColumn("tail", F.right("p_name", F.lit(5)))
    found = held.join(titles, "tail").select("q_name", "p_name", questions.title_suffix(F.col("p_name"), F.col("question"), 5).alias("n"))
    most = copies.agg(F.max("n")).first()[0] or 1
    blocks = part.groupBy("p_name", F.pmod(F.xxhash64("p_partkey"), F.lit(-(-most // PART_BLOCK))).alias("block")).agg(F.collect_list("p_partkey").alias("keys"))
    pairs = found.join(blocks.select(F.col("p_name").alias("q_name"), F.col("keys").alias("q_keys")), "q_name").join(blocks.select("p_name", "keys"), "p_name")
    dealt = pairs.select("q_keys", "keys", "n").repartition(8 * max(spark.sparkContext.defaultParallelism, 1))
    return dealt.select(F.explode("q_keys").alias("query_id"), "keys", "n").select("query_id", F.explode("keys").alias("p_partkey"), "n")


@query(f"WITH {_BM}, {_QT}, {_SC}, h AS (SELECT query_id, chunk_id, score, rank, chunk_id % 3 AS document_id FROM bm WHERE rank <= 10), s AS (SELECT query_id, document_id, count(*) AS seen FROM h WHERE rank <= 2 GROUP BY ALL), x AS (SELECT h.*, CASE WHEN rank <= 2 THEN 0 ELSE 1 END AS tier, CASE WHEN rank <= 2 THEN 0 ELSE score - 0.08 * (coalesce(seen, 0) + row_number() OVER (PARTITION BY h.query_id, h.document_id, rank <= 2 ORDER BY score DESC, rank) - 1) END AS lowered FROM h LEFT JOIN s USING (query_id, document_id)) SELECT query_id, chunk_id, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(lowered, 9) DESC, rank)::INTEGER AS final_rank FROM x) WHERE final_rank <= 5")
def diversify_topk(spark, d):
    hits = search_bm25_topk(spark, d).withColumn("document_id", F.col("chunk_id") % 3)
    return rt.diversify(hits, 5).select("query_id", "chunk_id", "final_rank")


@query(f"WITH {_TWO}, e AS (SELECT query_id, chunk_id, rank AS piece FROM f WHERE source = 'hybrid'), x AS (SELECT query_id, chunk_id, 0 AS tier, piece AS place FROM e UNION ALL SELECT query_id, chunk_id, 1, rank FROM bm WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = bm.query_id AND e.chunk_id = bm.chunk_id)) SELECT query_id, chunk_id, CASE WHEN tier = 0 THEN 'exact' ELSE 'ranked' END AS source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, place, chunk_id)::INTEGER AS rank FROM x) WHERE tier = 0 OR rank <= 6")
def exact_on_top(spark, d):
    a, b = two_lists(spark, d)
    exact = rt.fuse([("vector", a), ("bm25", b)]).filter("source = 'hybrid'").select("query_id", "chunk_id", F.col("rank").alias("piece"))
    return rt.exact_first(exact, b, 6)


# ---------------------------------------------------------------- questions

ASKED = ["证券和期货在适当性上有什么区别", "证券期货市场样例规定", "证券期货基金三条线分别怎么规定", "基金样例指引第十条", "各机构分工有何不同", "期货线与基金线的区别", ""]
_ASKED = "a(i, q) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(ASKED)) + ")"
_BARE = "q"
for _t in questions.INDUSTRY_TAILS:
    _BARE = f"replace({_BARE}, '证券期货{_t}', '{_t}')"
_LINES_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains({_BARE}, '{x}') THEN '{x}' END" for x in questions.LINES) + "], lambda x: x IS NOT NULL)"
_MARK_SQL = "(" + " OR ".join(f"contains(q, '{m}')" for m in questions.MARKERS) + ")"


def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "i int, q string")


@query(f"WITH {_ASKED} SELECT i, array_to_string({_LINES_SQL}, ',') AS lines FROM a")
def line_detect(spark, d):
    return asked(spark).select("i", F.array_join(questions.lines_of(F.col("q")), ",").alias("lines"))


@query(f"WITH {_ASKED} SELECT i, {_MARK_SQL} AND (len({_LINES_SQL}) >= 2 OR contains(q, '各') OR contains(q, '哪些机构') OR contains(q, '分工')) AS compares FROM a")
def comparison_gate(spark, d):
    return asked(spark).select("i", questions.comparison(F.col("q")).alias("compares"))


def _restate(line: str) -> str:
    x = "q"
    for o in questions.LINES:
        if o != line:
            x = f"CASE WHEN list_contains({_LINES_SQL}, '{o}') THEN replace(replace({x}, '{o}线', ''), '{o}', '') ELSE {x} END"
    return x


def _fillers(x: str) -> str:
    for m in (*questions.MARKERS, *questions.FILLERS):
        x = f"replace({x}, '{m}', '')"
    return f"trim({x}, ' ')"


_SUBS = "list_filter([" + ", ".join(f"CASE WHEN list_contains(ls, '{x}') THEN {_fillers('r' + str(i))} END" for i, x in enumerate(questions.LINES)) + "], lambda x: x IS NOT NULL AND x <> '')"


@query(f"WITH {_ASKED}, b AS (SELECT i, q, {_LINES_SQL} AS ls, {_MARK_SQL} AS m, {_restate('证券')} AS r0, {_restate('期货')} AS r1, {_restate('基金')} AS r2 FROM a), c AS (SELECT i, m, ls, {_SUBS} AS subs FROM b) SELECT i, CASE WHEN m AND len(ls) >= 2 AND len(list_distinct(subs)) = len(subs) THEN array_to_string(subs, '|') ELSE '' END AS subs FROM c")
def query_split(spark, d):
    return asked(spark).select("i", F.array_join(questions.sub_questions(F.col("q")), "|").alias("subs"))


@query("WITH e AS (SELECT label, list(embedding ORDER BY vec_id)[1]::DOUBLE[] AS v, repeat('x', (label % 4 + 1)::INTEGER) AS trig FROM embeddings GROUP BY label), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS u, repeat('x', (vec_id % 5)::INTEGER) AS words FROM embeddings), s AS (SELECT query_id, label, round(list_cosine_similarity(u, v), 6) AS sem, CASE WHEN length(trig) >= 3 AND contains(words, trig) THEN length(trig) ELSE 0 END AS hit FROM q, e), b AS (SELECT *, max(sem) OVER (PARTITION BY query_id) AS best FROM s) SELECT query_id, label, round(sem + 0.1 * hit, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sem + 0.1 * hit, 6) DESC, label) AS rn FROM b WHERE best >= 0.45) WHERE rn = 1")
def entry_route(spark, d):
    e = T(spark, d, "embeddings")
    entries = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).withColumn("trig", F.repeat(F.lit("x"), (F.col("label") % 4 + 1).cast("int")))
    ask = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("u"), F.repeat(F.lit("x"), (F.col("vec_id") % 5).cast("int")).alias("words"))
    s = ask.join(F.broadcast(entries), F.lit(True)).select("query_id", "label", F.round(rt.cosine(F.col("u"), F.col("v")), 6).alias("sem"), F.when((F.length("trig") >= 3) & F.contains("words", F.col("trig")), F.length("trig")).otherwise(0).alias("hit"))
    s = s.withColumn("best", F.max("sem").over(Window.partitionBy("query_id"))).filter("best >= 0.45").withColumn("score", F.round(F.col("sem") + 0.1 * F.col("hit"), 6))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))).filter("rn = 1").select("query_id", "label", "score")


# ---------------------------------------------------------------- decisions and checks


@query("WITH h AS (SELECT d.doc_id, count(*) FILTER (position(b.text IN d.text) > 0) AS hits FROM documents d, benchmark b GROUP BY d.doc_id) SELECT doc_id, hits FROM h")
def verbatim_verify(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "text")
    held = dc.held_passages(docs, T(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))
    return docs.select("doc_id").join(held.groupBy("doc_id").agg(F.count("*").alias("hits")), "doc_id", "left").select("doc_id", F.coalesce("hits", F.lit(0)).alias("hits"))


CASES = [(0, True, False, 0, False, None), (3, False, True, 2, False, 0.05), (3, False, True, 0, False, 0.9), (3, False, False, 0, True, 0.05), (0, False, False, 0, False, None), (3, False, False, 0, False, None), (3, False, False, 0, False, 0.12), (3, False, False, 0, False, 0.13), (3, True, False, 0, False, 0.5)]


@query("WITH c AS (SELECT doc_id AS i, doc_id % 4 AS hits, doc_id % 5 = 0 AS failed, doc_id % 7 = 0 AS cites, doc_id % 3 AS cited, doc_id % 11 = 0 AS entry, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (doc_id % 100) / 100.0 END::DOUBLE AS best FROM documents) SELECT i, CASE WHEN hits = 0 AND failed THEN 'retrieval_error' WHEN cites AND cited > 0 THEN 'ok' WHEN cites THEN 'citation_missing' WHEN entry THEN 'ok' WHEN hits = 0 THEN 'no_hits' WHEN best IS NULL THEN 'ok' WHEN best < 0.13 THEN 'low_score' ELSE 'ok' END AS kind, CASE WHEN hits = 0 AND failed THEN 'none' WHEN cites AND cited > 0 THEN 'citation_exact' WHEN cites THEN 'none' WHEN entry THEN 'wiki' WHEN hits = 0 THEN 'none' WHEN best IS NULL THEN 'degraded' WHEN best < 0.13 THEN 'none' ELSE 'rerank' END AS evidence FROM c")
def refusal_decide(spark, d):
    i = F.col("doc_id")
    best = F.when(i % 6 != 0, (i % 100) / 100.0)
    x = dc.decide(i % 4, i % 5 == 0, i % 7 == 0, i % 3, i % 11 == 0, best)
    return T(spark, d, "documents").select(i.alias("i"), x.alias("x")).select("i", "x.kind", "x.evidence")


@query("SELECT doc_id, [x::INTEGER FOR x IN [doc_id % 9, doc_id % 4] IF x BETWEEN 1 AND 5] AS positions, len([x FOR x IN [doc_id % 9, doc_id % 4] IF x NOT BETWEEN 1 AND 5]) + 1 AS n_unknown FROM documents")
def citation_restore(spark, d):
    i = F.col("doc_id")
    x = dc.restore(F.array((i % 9).cast("string"), F.concat(F.lit("片段"), i % 4), F.lit("x")), F.lit(5))
    return T(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.positions", F.size("x.unknown").cast("long").alias("n_unknown"))


@query(f"WITH {_SPELL} SELECT n, CASE WHEN n % 4 = 0 THEN '' ELSE token END AS missing FROM s")
def unsupported_clauses(spark, d):
    cited = F.array(F.when(F.col("n") % 4 == 0, F.concat(F.lit("第"), F.col("n"), F.lit("条"))).otherwise(F.lit("第一千条")))
    return spelled(spark).select("n", F.array_join(dc.unsupported(F.array("token"), cited), ",").alias("missing"))


@query("SELECT doc_id, doc_id % 4 <> 3 AND doc_id % 2 = 0 AS flagged FROM documents")
def no_citation_flag(spark, d):
    i = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, (*dc.SUBSTANTIVE, dc.ABSTAIN))), (i % 4 + 1).cast("int"))
    cites = F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1")))
    return T(spark, d, "documents").select("doc_id", dc.no_citation(said, cites).alias("flagged"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 > 0 OR doc_id % 3 > 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'probe_failed' WHEN doc_id % 7 > 0 THEN 'chain_fault' WHEN doc_id % 11 > 0 THEN 'out_of_sync' ELSE 'empty' END AS fault FROM documents")
def silent_empty(spark, d):
    i = F.col("doc_id")
    return T(spark, d, "documents").select("doc_id", rt.silent_empty(i % 2, i % 3, i % 5 != 0, i % 7, i % 11).alias("fault"))


@query("WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id AS session_id, turn, role FROM b WHERE back <= 6 AND length(text) % 5 <> 0")
def session_history(spark, d):
    t = T(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", (F.length("text") % 5 == 0).alias("failed"))
    return st.history(t).select("session_id", "turn", "role")


@query("SELECT d.doc_id, 'EVIDENCE' || chr(10) || '[1] ' || source || chr(10) || coalesce(text, '') || chr(10) || '[2] ' || lang || chr(10) || coalesce(text, '') || chr(10) || 'HISTORY' || chr(10) || chr(10) || 'QUESTION' || chr(10) || 'q' || d.doc_id AS prompt FROM documents d")
def prompt_assembly(spark, d):
    text = F.coalesce("text", F.lit(""))
    e = F.array(*(F.struct(F.col(c).alias("source"), text.alias("content")) for c in ("source", "lang")))
    return T(spark, d, "documents").select("doc_id", dc.prompt(F.concat(F.lit("q"), "doc_id"), e).alias("prompt"))


# ---------------------------------------------------------------- statistics and limits


@query("SELECT event_type, count(*) AS count, list_sort(list(value))[least(floor(count(*) * 0.5), count(*) - 1)::INTEGER + 1] AS p50, list_sort(list(value))[least(floor(count(*) * 0.9), count(*) - 1)::INTEGER + 1] AS p90, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def stats_percentile(spark, d):
    return st.percentiles(T(spark, d, "events"), ["event_type"], "value")


@query("SELECT event_type, trunc(quantile_cont(value, 0.5))::INTEGER AS median FROM events GROUP BY event_type")
def stage_median(spark, d):
    # The median from counts of distinct values, so no event type is gathered.
    v = T(spark, d, "events").filter("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    n = F.sum("c").over(Window.partitionBy("event_type"))
    v = v.withColumns({"upto": upto, "n": n})
    low, high = (F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1 + i) / 2), F.col("value"))) for i in (0, 1))
    return v.groupBy("event_type").agg(((low + high) / 2).cast("int").alias("median"))


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n, trunc(coalesce(avg(n_chars), 0))::INTEGER AS avg_chars FROM documents GROUP BY ALL")
def source_counts(spark, d):
    return T(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.coalesce(F.avg("n_chars"), F.lit(0)).cast("int").alias("avg_chars"))


@query("SELECT role AS conclusion, count(*) AS n FROM conversations GROUP BY role")
def conclusion_hist(spark, d):
    return T(spark, d, "conversations").groupBy(F.coalesce("role", F.lit("unknown")).alias("conclusion")).agg(F.count("*").alias("n"))


@query("SELECT user_id, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id HAVING sum(json_extract(props, '$.k')::BIGINT) > 0")
def map_value_sum(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return T(spark, d, "events").groupBy("user_id").agg(F.sum(F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("total")).filter("total > 0")


@query("SELECT ts::DATE AS usage_date, count(*) FILTER (event_type = 'purchase') AS qa_count, count(*) FILTER (event_type = 'view') AS retrieval_count, count(*) FILTER (event_type = 'error') AS blocked_count, round(sum(value), 4) AS total_value FROM events GROUP BY ALL")
def usage_daily(spark, d):
    return st.usage_daily(T(spark, d, "events"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)::INTEGER AS nth, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def daily_quota(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return limits.daily_quota(e, 3).select("event_id", "nth", "allowed")


@query()
def rate_limit_replay(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return limits.replay(e, 2, 3600.0)


@query("WITH r AS (SELECT source AS dimension, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 + 1 END AS rank FROM documents) SELECT CASE WHEN grouping(dimension) = 1 THEN 'all' ELSE dimension END AS dimension, count(*) AS n, round(100 * count(*) FILTER (rank <= 1) / count(*), 1) AS top1, round(100 * count(*) FILTER (rank <= 3) / count(*), 1) AS top3, round(100 * count(*) FILTER (rank <= 5) / count(*), 1) AS top5, round(100 * count(rank) / count(*), 1) AS recall FROM r GROUP BY ROLLUP (dimension)")
def eval_report(spark, d):
    r = T(spark, d, "documents").select(F.col("source").alias("dimension"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 9 + 1).alias("rank"))
    return st.eval_report(r)


@query("WITH s AS (SELECT quality = 1 AS good, (doc_id % 100) / 100.0::DOUBLE AS score FROM labels), t AS (SELECT unnest([0.13, 0.18, 0.3])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (NOT good AND score < threshold) AS blocked, count(*) FILTER (good AND score < threshold) AS lost, min(CASE WHEN good THEN score END) AS lowest_good FROM s, t GROUP BY threshold")
def threshold_calibration(spark, d):
    return st.threshold_curve(T(spark, d, "labels").select((F.col("quality") == 1).alias("good"), ((F.col("doc_id") % 100) / 100.0).alias("score")), [0.13, 0.18, 0.3])


_EV = "count(*) AS n, round(sum(value), 4) AS total"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, {_EV} FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return limits.windows(T(spark, d, "events"), "1 hour")


@query(f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS window_start, event_type, {_EV} FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def events_sliding(spark, d):
    return limits.windows(T(spark, d, "events"), "1 hour", "30 minutes")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def events_session(spark, d):
    return limits.sessions(T(spark, d, "events"))


# ---------------------------------------------------------------- relational coverage


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)")
def join_semi_anti(spark, d):
    c, o, n = (T(spark, d, x) for x in ("customer", "orders", "nation"))
    c = c.join(o.filter("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_semi")
    return c.join(n.filter("n_regionkey = 0"), c.c_nationkey == n.n_nationkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_inner_chain(spark, d):
    o, c, n, r = (T(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT s_suppkey FROM supplier INTERSECT SELECT p_partkey FROM part")
def set_ops(spark, d):
    o, c, s, p = (T(spark, d, x) for x in ("orders", "customer", "supplier", "part"))
    left = o.select(F.col("o_custkey").alias("k")).subtract(c.filter("c_acctbal > 0").select("c_custkey"))
    return left.union(s.select("s_suppkey").intersect(p.select("p_partkey"))).distinct()


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets_cube(spark, d):
    g = T(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("WITH k AS (SELECT DISTINCT ON (text, lang) * FROM documents WHERE n_chars > 1500 ORDER BY text, lang, doc_id) SELECT count(DISTINCT (sha256(text), lang)) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.text = d.text AND k.lang = d.lang)")
def ingest_register(spark, d):
    t = T(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash"), F.col("lang").alias("knowledge_base"), "doc_id", "n_chars")
    known = t.filter("n_chars > 1500")
    return store.register(known, t).agg(F.count("*").alias("n"))
