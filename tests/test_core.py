import datetime as dt
import random

import pytest
from compare import DIR, connect, same
from pyspark.sql import functions as F

from tessera.functions import metadata, numerals, questions, text as tx
from tessera import providers
from tessera.operators import citations, decide as dc, entries as en, retrieve as rt, search as se, split as sp, stats as st
from tessera.plans import registry as core
from tessera.sources import loaders, store
from tessera.streaming import limits


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_oracle(spark, con, name):
    same(core.QUERIES[name](spark, DIR), core.ORACLE_SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DIR).count() > 0


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(cols[n], str) else 'array<string>'}" for n in names)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("token,number", [("第十条", 10), ("第二十九条", 29), ("第一百零五条", 105), ("第一百三十七条", 137), ("第二百二十六条", 226), ("第29条", 29), ("第条", None), ("第一千条", None)])
def test_numeral(spark, token, number):
    assert one(spark, numerals.article_number(F.col("t")), t=token) == number


def test_clean_and_unwrap(spark):
    assert one(spark, tx.clean_text(F.col("t")), t="第三条 机构\t应当\r\n\r\n\r\n\r\n结束  ") == "第三条　机构应当\n\n结束"
    assert one(spark, tx.unwrap_lines(F.col("t")), t="为了规范\n样例行为\n，维护权益。\n第二条\n内容") == "为了规范样例行为，维护权益。\n第二条内容"


def test_boundaries_and_split():
    t = "第一条　机构应当保存记录。\n第二条　违反本办法第一条，处以警告。\n第三条规定的事项另行公布。"
    assert [(x, ok) for _, x, ok, _ in sp.boundaries(t)] == [("第一条", True), ("第二条", True), ("第一条", False), ("第三条", False)]
    assert not sp.looks_legal(t)
    assert [x for _, x, *_ in sp.boundaries("第\n十八\n条")] == ["第十八条"]
    assert [(a, b) for a, b, _ in sp.split_fixed("a" * 1200)] == [(0, 500), (450, 950), (900, 1200)]


def test_split_covers_text():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice(["第一条 ", "。\n", "# H\n", "word ", "条文内容", "\n\n", "1. Title\n"]) for _ in range(rng.randint(0, 400)))
        for f in (sp.split_legal, sp.split_semantic):
            got = f(t)
            assert all(a < b for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
            covered = set().union(*(range(a, b) for a, b, _ in got)) if got else set()
            assert not "".join(c for i, c in enumerate(t) if i not in covered).strip()


def test_scope_and_questions(spark):
    assert one(spark, tx.scope_text(F.col("s")), s=["证券", "基金"]) == ";证券;基金;"
    assert one(spark, questions.lines_of(F.col("q")), q="证券期货市场样例规定") == []
    assert one(spark, questions.sub_questions(F.col("q")), q="证券和期货在样例义务上有什么区别") == ["证券在样例义务上", "期货在样例义务上"]


def test_rrf_and_diversify(spark):
    hit = lambda *x: spark.createDataFrame([("q", c, 1.0 / (i + 1), i + 1) for i, c in enumerate(x)], "query_id string, chunk_id string, score double, rank int")
    got = {r["chunk_id"]: (r["fused"], r["source"]) for r in rt.fuse([("vector", hit("a", "b", "c")), ("bm25", hit("b", "d"))]).collect()}
    assert got == {"b": (0.032522, "hybrid"), "a": (0.016393, "vector"), "d": (0.016129, "bm25"), "c": (0.015873, "vector")}
    h = spark.createDataFrame([("q", f"c{i}", d, s, i + 1) for i, (d, s) in enumerate([("A", 0.5), ("A", 0.45), ("A", 0.44), ("B", 0.4), ("A", 0.43), ("C", 0.3)])], "query_id string, chunk_id string, document_id string, score double, rank int")
    assert [r["chunk_id"] for r in rt.diversify(h, 5).orderBy("final_rank").collect()] == ["c0", "c1", "c3", "c5", "c2"]


def test_decisions(spark):
    rows = spark.createDataFrame(core.CASES, "h int, f boolean, c boolean, n int, e boolean, b double")
    got = [tuple(r) for r in rows.select(dc.decide(*(F.col(x) for x in "hfcneb")).alias("x")).select("x.refuse", "x.kind", "x.evidence").collect()]
    assert got == [(True, "retrieval_error", "none"), (False, "ok", "citation_exact"), (True, "citation_missing", "none"), (False, "ok", "wiki"), (True, "no_hits", "none"), (False, "ok", "degraded"), (True, "low_score", "none"), (False, "ok", "rerank"), (False, "ok", "rerank")]


def test_verbatim_restore_unsupported(spark):
    p = ["应当承担相应的—５１—\n赔偿责任。"]
    assert one(spark, dc.verbatim(F.col("o"), F.col("p")), o="应当承担相应的赔偿责任", p=p) and not one(spark, dc.verbatim(F.col("o"), F.col("p")), o="应当……责任", p=p)
    r = one(spark, dc.restore(F.col("c"), F.lit(5)), c=["1", "片段3", "9", "x"])
    assert (r["positions"], r["unknown"]) == ([1, 3], ["9", "x"])
    assert one(spark, dc.unsupported(F.col("c"), F.col("h")), c=["《甲》第29条、第五十条"], h=["第二十九条"]) == ["第五十条"]


def test_percentile_limits_metadata(spark):
    v = spark.createDataFrame([("a", x) for x in (10, 20, 30, 40)], "g string, v int")
    assert st.percentiles(v, ["g"], "v").first()[1:] == (4, 30, 40, 40)
    assert limits.admit([0, 10, 20, 60, 61, 70.1], [], 2, 60)[0] == [True, True, False, False, True, True]
    x = one(spark, metadata.effective_date(F.col("t")), t="2020年1月2日公布，自2020年3月1日起施行")
    assert x == dt.date(2020, 3, 1)


def test_loaders(spark, tmp_path):
    assert loaders.decode("条文".encode("gb18030")) == "条文" and [t for t, _ in loaders.markdown_sections("a\n# B\nc")] == ["(start)", "B"]
    page = "<html><title>T</title><body><nav>menu</nav><div class='content'><p>" + "x" * 300 + "</p></div></body></html>"
    assert loaders.html_body(page)[:2] == ("T", "x" * 300)
    (tmp_path / "a.md").write_text("# One\ntext\n# Two\nmore")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = loaders.load_files(spark, str(tmp_path)).collect()
    assert sorted((r["parser"], r["section_index"]) for r in got) == [("markdown", 0), ("markdown", 1), ("none", 0)]


def test_store_and_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "parsing", True, None), (2, "parsed", False, None), (3, "indexed", True, None)], "document_id int, status string, has_source boolean, reason string")
    assert [r["status"] for r in store.recover(docs).orderBy("document_id").collect()] == ["queued", "failed", "indexed"]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a\n\n\n\nb"), (2, "c ")], "doc_id long, text string").write.parquet(src)
    stream = spark.readStream.schema("doc_id long, text string").parquet(src)
    limits.ingest(stream, out, str(tmp_path / "cp"), lambda b: b.withColumn("text", tx.clean_text(F.col("text")))).awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a\n\nb", "c"]


def test_title_suffix_asks_every_part(spark, tmp_path):
    names = ["green", "misty green", "misty greens", "rose", "specification", "a specification", "lace misty green", ""]
    spark.createDataFrame(list(enumerate(names, 40)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for q, asked in enumerate(names, 40):
        for p, title in enumerate(names, 40):
            n = max((k for k in range(5, len(title) + 1) if title[-k:] in f"{asked} specification"), default=0)
            want |= {(q, p): n} if n else {}
    whole = {(r["query_id"], r["p_partkey"]): r["n"] for r in core.QUERIES["title_suffix_match"](spark, str(tmp_path)).collect()}
    assert whole == want
    parts = spark.read.parquet(f"{DIR}/part.parquet")
    assert core.QUERIES["title_suffix_match"](spark, DIR).select("query_id").distinct().count() == parts.filter("length(p_name) >= 5").count() > 50


def test_prompt_holds_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = core.QUERIES["prompt_assembly"](spark, DIR).collect()
    assert len(got) == len(texts) and max(map(len, texts.values())) > 60
    assert all(r["prompt"].count(texts[r["doc_id"]]) >= 2 for r in got)


def test_html_rules():
    long = "法规条文内容。" * 40
    page = f"<html><head><title>T</title><meta charset=x><link rel=y></head><body><nav>menu</nav><div class='context-menu'>{long * 2}</div><div id='main'><p>面包屑开始</p><p>首页</p><p>面包屑结束</p><p>第一章 总则</p><blockquote>{long}</blockquote><p>第二章 附则</p><pre>end</pre></div></body></html>"
    title, lines, _ = loaders.html_lines(page)
    assert title == "T" and lines == ["第一章 总则", long, "第二章 附则", "end"]
    assert loaders.html_sections("T", ["before", *lines]) == [("T（前言）", "before"), ("第一章 总则", f"第一章 总则\n{long}"), ("第二章 附则", "第二章 附则\nend")]
    assert loaders.html_lines("<nav>menu</nav><p>a</p>")[1] == ["menu", "a"]
    assert loaders.without_crumbs(["a", "面包屑结束", "面包屑开始"]) == ["a", "面包屑结束", "面包屑开始"]


def test_metadata_rules(spark):
    t = "国务院证券监督管理机构 中国证券业协会 证监会" + "字" * 800
    df = spark.createDataFrame([(t, "admin_regulation"), (t, "self_regulation"), (t, "x"), (t, None)], "t string, level string")
    got = df.select(metadata.issuer(F.col("t"), F.col("level")).alias("i"), metadata.level_label(F.col("level")).alias("l"), metadata.level_rank(F.col("level")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("国务院", "行政法规", 2), ("中国证券业协会", "自律规则", 5), ("中国证券监督管理委员会", "x", None), ("中国证券监督管理委员会", "未分类", None)]
    lv = metadata.infer_level(F.lit("中国证券监督管理委员会"), F.lit(None).cast("string"), F.lit("关于"), F.col("t"))
    assert [r[0] for r in spark.createDataFrame([("第5号令",), ("公告",)], "t string").select(lv).collect()] == ["department_rule", "normative_document"]


def test_cut_and_pieces():
    assert sp.cut("a" * 649, 0, 500) == 649 and sp.cut("a" * 650, 0, 500) == 500
    assert sp.pieces("a" * 2000, 0, 1001, 500) == [(0, 500), (500, 1001)]
    assert sp.pieces("a" * 1800, 0, 1600, 500) == [(0, 500), (500, 1600)][:1] + sp.pieces("a" * 1800, 500, 1600, 500)


def test_split_by_document(spark):
    legal = "\n".join(f"第{numerals.spell(i)}条　内容。" for i in range(1, 4))
    rows = [(1, 0, legal), (1, 1, legal.replace("第", "\n第")), (1, 2, "# A\nx\n# B\ny\n# C\nz"), (2, 0, "plain text"), (2, 1, "# A\n\nx\n# B\n\ny\n# C\nz"), (3, 0, None)]
    got = sp.split_sections(spark.createDataFrame(rows, "doc_id long, section_index int, text string")).select("doc_id", "section_index", "splitter").distinct().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, 0): "legal", (1, 1): "legal", (1, 2): "legal", (2, 0): "semantic", (2, 1): "semantic"}


def test_parse_citations(spark):
    docs = spark.createDataFrame([(1, "样例管理办法", "a.txt", "indexed"), (2, "样例管理办法问答", "b.txt", "indexed"), (3, "基金样例指引（试行）", "c.txt", "indexed"), (4, None, "别的规定.pdf", "indexed"), (5, "样例管理办法", "d.txt", "failed")], "document_id long, title string, filename string, status string")
    qs = ["《样例管理办法》第二十九条怎么规定", "基金样例指引第十条", "第二十九条", "样例管理办法第一条和第二条", "某某管理办法第三条", "别的规定第3条", "没有", None, "样例管理办法第一千条"]
    got = citations.parse_citations(spark.createDataFrame(list(enumerate(qs)), "query_id int, text string"), citations.document_refs(docs)).orderBy("query_id").collect()
    assert [(r["document_id"], r["number"], r["matched"]) if r["usable"] else r["reason"] for r in got] == [(1, 29, 6), (3, 10, 6), "no known title", "several articles", (1, 3, 4), (4, 3, 4), "no article", "no article", "no article"]


def chunk_rows(spark):
    rows = [(10, 1, 0, "第一条", 1, "第一条 甲", True), (11, 1, 1, "第一条", 1, "乙", True), (12, 1, 2, "第二条", 2, "丙", False), (13, 2, 0, None, None, "丁", True)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, article_number string, article_int int, content string, enabled boolean")


def test_citations_in_tables(spark):
    docs = spark.createDataFrame([(1, "样例管理办法", "a.txt"), (2, "其他", "b.txt")], "document_id long, title string, filename string")
    c = chunk_rows(spark)
    e = spark.createDataFrame([("s", [("样例管理办法", "第1条"), ("a.txt", "第二条"), ("无", "第一条")])], "slug string, citations array<struct<name:string,article:string>>")
    assert [r["chunk_id"] for r in citations.entry_evidence(e, docs, c).orderBy("piece").collect()] == [10, 11]
    src = spark.createDataFrame([("s", "a.txt", "第二条"), ("s", "a.txt", "第一条"), ("s", "b.txt", "第九条")], "slug string, filename string, article string")
    assert {(r["filename"], r["article"]): r["passage"] for r in citations.passages(src, docs, c).collect()} == {("a.txt", "第二条"): "丙", ("a.txt", "第一条"): "第一条 甲\n乙", ("b.txt", "第九条"): None}
    v = spark.createDataFrame([(1, "样例", "第二条"), (2, "样例", "第五条"), (3, "管理办法样", "第一条"), (4, "", "第一条")], "id int, name string, article string")
    assert {r["id"]: r["verified"] for r in citations.citations_exist(v, docs, c).collect()} == {1: True, 2: False, 3: False}
    drafts = spark.createDataFrame([("s", [("第一条 甲……第一条甲",)]), ("t", [("没有这句",)])], "slug string, rows array<struct<original:string>>")
    done = en.compiled(drafts, citations.passages(src, docs, c)).collect()
    assert {r["slug"]: r["citation_verified"] for r in done} == {"s": True, "t": False}


def test_route(spark):
    e = spark.createDataFrame([("a", "t", ["行政处罚", "短"], ["证券"], "reviewed", True, [1.0, 0.0]), ("b", "t", ["适当性义务的法律规定"], ["期货", "证券"], "reviewed", True, [0.9, 0.1]), ("c", "t", ["行政处罚"], [], "draft", True, [1.0, 0.0])], "slug string, title string, triggers array<string>, legal_lines array<string>, status string, citation_verified boolean, embedding array<double>")
    q = spark.createDataFrame([(1, "证券和期货在行政处罚上有什么区别", [1.0, 0.05]), (2, "证券和期货的适当性义务上的法律规定有什么不同", [1.0, 0.0]), (3, "证券和期货的适当性义务上的法律规定有什么不同", None), (4, "什么是基金", [1.0, 0.0]), (5, "证券和期货有何不同", [0.0, -1.0])], "query_id int, text string, embedding array<double>")
    assert {r["query_id"]: r["slug"] for r in en.route(q, e).collect()} == {1: "a", 2: "b", 3: "b"}


def test_search_and_ask(spark, tmp_path):
    docs = spark.createDataFrame([(1, "样例管理办法", "a.txt", "indexed", "law", None, None), (2, "other rules", "b.txt", "indexed", None, "repealed", None)], "document_id long, title string, filename string, status string, legal_level string, validity string, doc_number string")
    more = spark.createDataFrame([(20 + i, 2, 1 + i, None, None, f"green apples number {i} grow on trees", True) for i in range(8)], chunk_rows(spark).schema)
    chunks = store.written(providers.embed(chunk_rows(spark).unionByName(more), text="content"))
    corpus = se.Corpus(docs, chunks, rt.build_index(chunks.filter("enabled").select("chunk_id", F.col("content").alias("text")), str(tmp_path / "index")))
    asked = providers.embed(spark.createDataFrame([(1, "样例管理办法第一条"), (2, "green apples number 3"), (3, "   "), (4, "样例管理办法第七条")], "query_id int, text string").withColumn("query_id", F.col("query_id").cast("long")))
    hits = se.search(corpus, asked).orderBy("query_id", "final_rank").collect()
    by = {i: [r for r in hits if r["query_id"] == i] for i in range(1, 5)}
    assert [(r["chunk_id"], r["score_kind"]) for r in by[1]][:2] == [(10, "exact"), (11, "exact")] and by[1][0]["legal_level_label"] == "法律"
    assert by[2][0]["chunk_id"] == 23 and len(by[2]) == 5 and by[2][0]["validity_label"] == "已废止" and not by[3]
    got = {r["query_id"]: r for r in se.ask(corpus, asked).collect()}
    assert (got[1]["kind"], got[1]["evidence"], got[1]["cited"]) == ("ok", "citation_exact", [10]) and got[2]["evidence"] == "rerank" and got[2]["cited"] == [23]
    assert got[3]["refused"] and got[3]["kind"] == "no_hits" and got[4]["kind"] == "citation_missing"
    assert se.Settings(k=7).dense_k == 28 and se.Settings(rerank=False).candidate_k == 20
    with pytest.raises(ValueError):
        se.Settings(k=51)


def test_providers(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 2:
            raise OSError
        return [[1.0]] * len(texts)

    assert providers.with_retries(flaky, ["a", "b"], wait=0) == [[1.0], [1.0]] and calls == [2, 2]
    with pytest.raises(ValueError):
        providers.with_retries(lambda t: [], ["a"], wait=0)


def test_index_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *t: spark.createDataFrame(list(enumerate(t)), "chunk_id long, text string").coalesce(1)
    rows("alpha beta", "beta").write.parquet(path)
    scan = lambda: spark.read.parquet(path)
    one = rt.fresh_index(scan(), scan(), str(tmp_path))
    assert one.terms.count() == 2 and rt.version_of(scan()) == rt.version_of(scan())
    rows("gamma").write.mode("append").parquet(path)
    assert rt.fresh_index(scan(), scan(), str(tmp_path)).terms.count() == 3


def test_run_index_and_rewrite(spark):
    f = spark.createDataFrame([("x/r_20250101_101010.csv",), ("x/q_20250101_101010.csv",), ("x/r_20250102_101010.csv",), ("x/none.csv",)], "name string")
    assert [tuple(r) for r in st.run_index(f, {"r_": "retrieval", "q_": "qa"}).collect()] == [("20250102_101010", "r_20250102_101010.csv", None), ("20250101_101010", "r_20250101_101010.csv", "q_20250101_101010.csv")]
    q = spark.createDataFrame([("a?", "longer question", True), ("a?", "x", True), ("a?", "longer", False)], "q string, p string, h boolean")
    assert [r[0] for r in q.select(se.rewritten(F.col("q"), F.col("p"), F.col("h"))).collect()] == ["longer question", "a?", "a?"]


def test_jobs(spark):
    d = spark.createDataFrame([(1, "indexed", None), (2, "indexed", None), (3, "failed", "x")], "document_id long, status string, reason string")
    j = spark.createDataFrame([(1, "reindex"), (2, "reindex"), (3, "retry")], "document_id long, job string")
    got = {r["document_id"]: (r["status"], r["reason"]) for r in store.requeue(d, j, chunk_rows(spark).filter("document_id = 1")).collect()}
    assert got == {1: ("vectorizing", None), 2: ("failed", "no chunks to index"), 3: ("queued", None)}
    assert limits.progress(1, 2) == 87 and limits.progress(2, 2) == 95 and store.missing_fields(["a", "status"], d) == ["a"]
    assert store.health(None) == (True, 0, "")


def test_held_passages(spark):
    """Against brute force: nulls, empty and long texts, repeated rows, double spaces, passages of few words."""
    texts = [(1, "a b c d e f"), (2, None), (3, ""), (4, "x a b  c d e"), (5, "zz a b c d eg"), (5, "zz a b c d eg"), (6, "word " * 20_000 + "a b c d e"), (7, "ab"), (8, "a b c d")]
    passages = [("p", "a b c d e"), ("q", "a b  c d e"), ("r", "b"), ("s", "word word word word word"), ("t", None), ("u", "not in any of them"), ("v", "e a b c d")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id string, passage string")
    got = dc.held_passages(docs, items).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(i, k) for i, t in texts for k, p in passages if t is not None and p is not None and p in t}
    assert dc.held_passages(docs.limit(0), items).count() == dc.held_passages(docs, items.limit(0)).count() == 0


def test_title_suffix_blocks_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(core, "PART_BLOCK", 2, raising=False)
    names = ["misty green"] * 7 + ["green"] * 5 + ["rose"]
    spark.createDataFrame(list(enumerate(names, 40)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = core.QUERIES["title_suffix_match"](spark, str(tmp_path)).collect()
    assert len({(r["query_id"], r["p_partkey"]) for r in got}) == len(got) == 7 * 7 + 2 * 7 * 5 + 5 * 5
    pairs = core.QUERIES["title_suffix_match"](spark, DIR)
    assert pairs.select(F.spark_partition_id().alias("task")).distinct().count() > 4


@pytest.mark.parametrize("most", [200_000, 3])
def test_longest_endings_by_brute_force(spark, monkeypatch, most):
    for module in (citations, rt):
        monkeypatch.setattr(module, "BROADCAST_ROWS", most, raising=False)
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("ab1") for _ in range(rng.randint(a, b)))
    names, forms = {i: word(3, 9) for i in range(150)}, {i: word(0, 16) for i in range(100)}
    want = {}
    for q, form in forms.items():
        found = [(-max(k for k in range(3, len(n) + 1) if n[-k:] in form), len(n), i) for i, n in names.items() if n[-3:] in form]
        if found:
            want[q] = (min(found)[2], -min(found)[0])
    held = spark.createDataFrame(list(forms.items()), "query_id long, form string")
    got = citations.longest_endings(held, spark.createDataFrame([(i, n, n) for i, n in names.items()], "document_id long, title string, name string"))
    assert {r["query_id"]: (r["document_id"], r["matched"]) for r in got.collect()} == want and len(want) > 50


def test_index_by_blocks(spark, monkeypatch):
    """Blocks of any size score alike, text keys and ties too; postings and their figures need no shuffle of chunks."""
    rows = [(f"c{i:02}", t) for i, t in enumerate(["b a a", "a", "", None, "条文 a c", "c " * 30, "a", "b b d", "条文", "d e f"])]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "a a b"), (2, "条文 d"), (3, "nothing"), (4, "e c")], "query_id int, text string")
    whole = sorted(map(tuple, rt.bm25(chunks, asked, 3).collect()))
    assert sorted(r[1] for r in whole if r[0] == 1) == ["c00", "c07"] and {r[0] for r in whole} == {1, 2, 4}
    tie = rt.bm25(chunks, spark.createDataFrame([(5, "d")], "query_id int, text string"), 1)
    assert [r["chunk_id"] for r in tie.collect()] == ["c07"]
    monkeypatch.setattr(rt, "BLOCK_TOKENS", 3)
    post = rt.postings(chunks)
    assert post.select("block").distinct().count() > 3 and "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    assert tuple(rt.term_weights(post)[1].first()) == (8, (3 + 1 + 5 + 30 + 1 + 3 + 3 + 3) / 8)
    assert sorted(map(tuple, rt.bm25(chunks, asked, 3).collect())) == whole


def test_unwrap_is_linear_and_like_the_fold(spark):
    rng = random.Random(5)
    bits = ["", "—", "- -", "12", "— 3 —", "１２", "12345", "1 2", "第", "第三条", "甲乙。", "甲", "ab", "# x", "IV. x", "一、x", " x　", "\x1c", "（一）y", "第　"]
    for _ in range(3000):
        text = "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        acc = []
        for line in (x.strip() for x in text.split("\n")):
            last = acc[-1] if acc else ""
            if not acc or not line or not last or last[-1] in "。！？；：第" or tx.PAGE.fullmatch(last) or tx.STARTS.match(line):
                acc.append(line)
            else:
                acc[-1] = last + ("" if tx.CJK_CHAR.match(last[-1]) or tx.CJK_CHAR.match(line) else " ") + line
        assert tx.unwrapped(text) == "\n".join(acc), repr(text)
    long = spark.createDataFrame([("some words of a line\n" * 50_000 + "end",), (None,)], "t string").select(tx.unwrap_lines(F.col("t")).alias("x")).collect()
    assert long[0]["x"] == "some words of a line " * 50_000 + "end" and long[1]["x"] is None


def test_split_holds_few_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sp, "PART", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "text": ["a" * 4, None, "b" * 6, "c" * 50, "d"]})
    assert [list(x.doc_id) for x in sp.parts([batch])] == [[1, 2, 3], [4], [5]]
