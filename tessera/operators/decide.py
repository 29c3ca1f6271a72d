"""Answer or refuse, and checks of what an answer cites. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numerals import TOKEN, article_number
from ..functions.text import verify_form

THRESHOLD = 0.13
SUBSTANTIVE = ("违反", "不违反", "解释说明")
ABSTAIN = "无法判断"
MESSAGES = {
    "ok": "", "retrieval_error": "检索服务出错，请稍后再试。", "citation_missing": "未找到所引条文。",
    "no_hits": "知识库中没有相关内容。", "low_score": "找到的内容相关度不足。", "model_abstain": "依据现有材料不能作出判断。",
}


def decide(hits: Column, failed: Column, cites: Column, cited_hits: Column, entry: Column, best: Column, threshold: float = THRESHOLD) -> Column:
    """kind and evidence by the first rule that applies; `best` null means that no rerank score exists."""
    rules = [
        ((hits == 0) & failed, "retrieval_error", "none"),
        (cites & (cited_hits > 0), "ok", "citation_exact"),
        (cites, "citation_missing", "none"),
        (entry, "ok", "wiki"),
        (hits == 0, "no_hits", "none"),
        (best.isNull(), "ok", "degraded"),
        (best < threshold, "low_score", "none"),
    ]
    made = lambda kind, evidence: F.struct(F.lit(kind != "ok").alias("refuse"), F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence"))
    out = F.when(rules[0][0], made(*rules[0][1:]))
    for when, *what in rules[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), made(*what))
    return out.otherwise(made("ok", "rerank"))


def message(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(""))


def restore(claimed: Column, n_evidence: Column) -> Column:
    """Positions that claimed labels mean (digits only, 1-based, in range) and the labels that mean none."""
    number = lambda x: F.regexp_extract(x, r"(\d+)", 1).try_cast("int")
    good = lambda x: F.coalesce(number(x).between(1, n_evidence), F.lit(False))
    labels = F.coalesce(claimed, F.array().cast("array<string>"))
    return F.struct(F.transform(F.filter(labels, good), number).alias("positions"), F.filter(labels, lambda x: ~good(x)).alias("unknown"))


def unsupported(clauses: Column, cited_articles: Column) -> Column:
    """Claimed article tokens whose number none of the cited articles has; one without a number is unsupported.
    Repeats stay; nothing is checked where nothing is claimed or cited."""
    have = F.transform(cited_articles, article_number)
    tokens = F.flatten(F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))))
    left = F.filter(tokens, lambda t: ~F.coalesce(F.array_contains(F.filter(have, lambda h: h.isNotNull()), article_number(t)), F.lit(False)))
    none = F.array().cast("array<string>")
    return F.when((F.size(clauses) > 0) & (F.size(cited_articles) > 0), left).otherwise(none)


def no_citation(conclusion: Column, citations: Column) -> Column:
    return conclusion.isin(*SUBSTANTIVE) & (F.coalesce(F.size(citations), F.lit(0)) <= 0)


def abstains(conclusion: Column) -> Column:
    return F.coalesce(conclusion == ABSTAIN, F.lit(False))


def verbatim(original: Column, passages: Column) -> Column:
    """Every part between ellipses of four or more characters stands word for word in the passages; no part, false."""
    hay = verify_form(F.array_join(passages, " "))
    parts = F.filter(F.transform(F.split(F.coalesce(original, F.lit("")), r"…+|\.{3,}|。{3,}"), verify_form), lambda x: F.length(x) >= 4)
    return (F.size(parts) > 0) & F.forall(parts, lambda x: F.contains(hay, x))


def parse_answer(raw: Column, schema: str = "conclusion string, reason string, citations array<string>") -> Column:
    """The object in a model's answer: as it is, or from the first to the last brace; null if neither parses."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"^\s*```(?:json)?", ""), r"```\s*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    opts = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}
    return F.when(inner != "", F.from_json(inner, schema, opts))


def prompt(question: Column, evidence: Column, history: Column | None = None) -> Column:
    """Numbered evidence (structs of source and content), history and question, as one text."""
    blocks = F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["source"], F.lit("\n"), e["content"]))
    past = F.coalesce(F.array_join(history, "\n"), F.lit("")) if history is not None else F.lit("")
    return F.concat(F.lit("EVIDENCE\n"), F.array_join(blocks, "\n"), F.lit("\nHISTORY\n"), past, F.lit("\nQUESTION\n"), question)


def held_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id of every passage (item_id, passage) that a text (doc_id, text) holds word for word.

    What holds a passage holds its second to fourth words in a row between the same spaces, so texts and passages
    meet by a hash of these; passages of fewer than five words, a stated few, are held against every text."""
    words = F.split("passage", " ", -1)
    p = passages.filter("passage IS NOT NULL").withColumn("w", words)
    long_ = p.filter(F.size("w") >= 5).select("item_id", "passage", F.xxhash64(*(F.get("w", F.lit(i)) for i in (1, 2, 3))).alias("h"))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    # the words are the variable of a transform over one element, so that a text is split once and not once a word
    grams = F.element_at(F.transform(F.array(F.split("text", " ", -1)), lambda w: F.when(F.size(w) >= 3, F.array_distinct(hashes(w)))), 1)
    keys = docs.select("doc_id", F.explode(grams).alias("h"))
    met = keys.join(long_.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    held = met.join(docs, "doc_id").join(long_.select("item_id", "passage"), "item_id").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id").distinct()
    short = p.filter(F.size("w") < 5).select("item_id", "passage")
    if short.isEmpty():
        return held
    return held.unionByName(docs.join(short, F.contains("text", F.col("passage"))).select("doc_id", "item_id").distinct())
