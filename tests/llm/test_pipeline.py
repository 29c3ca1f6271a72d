import __spark_entry__ as entry
import corpus_pipeline as cp
from tessera.llm import exact_dedup, near_dedup, pii
from tessera.llm.common import stash

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = spark.read.parquet(f"{DIR}/documents.parquet"), None
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = stash(stage(spark, docs, DIR))
        if name == "exact_dedup":
            kept = {r["doc_id"] for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == kept
        if name == "near_dedup":
            assert out.count() == near_dedup.near_classes(docs).filter("kept").count()
        if name == "pii":
            assert out.count() == docs.count()
            assert not any(pii.base_spans(r["text"]) for r in out.collect())
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        else:
            assert out.columns == columns
        docs = out


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and all(any(x.startswith(f"op{n}_") for x in q) for n in range(1, 11))


def test_null_and_reused_ids(spark):
    words = [f"w{i}" for i in range(120)]
    near = " ".join([*words[:119], "other"])
    rows = [(1, "a b"), (None, "a b"), (None, "a b"), (None, "only here"), (2, "a b"), (2, "clean and unique"), (3, " ".join(words))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    left = cp.drop_copies(spark, docs, DIR)
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == sorted({t for _, t in rows})
    assert [r["doc_id"] for r in left.filter("text = 'a b'").collect()] == [1]
    more = left.unionByName(spark.createDataFrame([(None, near, "x"), (2, near, "x")], docs.schema))
    assert sorted(r["text"] for r in cp.drop_near_copies(spark, more, DIR).collect()) == sorted({t for _, t in rows})


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, row long"
    rows = [(1, "a b", "en", "s", 3, 1, 1), (1, "zzz", "en", "s", 3, 1, 1), (2, "a   b", None, None, None, None, None), (None, None, None, "s", 0, 2, 2), (None, "", "en", "s", 0, 2, 2), (3, "word " * 30_000, "en", "s", 150_000, 3, 3), (3, "word " * 30_000, "en", "s", 150_000, 3, 3), (4, "mail a.b@c.de", "en", "s", 13, 4, 4)]
    docs = spark.createDataFrame(rows, schema)
    kept = {"toxicity": 8, "exact_dedup": 5, "near_dedup": 5, "pii": 5}
    for name, stage in cp.STAGES:
        out = stash(stage(spark, docs, DIR))
        empty = stage(spark, docs.limit(0), DIR)
        assert empty.count() == 0
        if name == "packing":
            assert out.filter("length < 1 OR length > 1024").count() == 0 and out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        else:
            assert out.columns == docs.columns and (name == "toxicity" or out.count() == kept[name])
        docs = out if name != "toxicity" else docs
    assert True
