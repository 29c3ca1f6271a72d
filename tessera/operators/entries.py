"""Compiled entries: which one answers a comparison, how its index reads, what it stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.questions import comparison, lines_of
from ..functions.text import bare
from .decide import verbatim
from .retrieve import cosine, small

TRIGGER_LEAST, SEMANTIC_LEAST, PER_CHARACTER = 3, 0.45, 0.10


def trigger_hit(question: Column, triggers: Column) -> Column:
    """Length of the longest trigger of three characters or more that the question holds, particles aside; else 0."""
    q = bare(question)
    hits = F.transform(F.coalesce(triggers, F.array().cast("array<string>")), lambda t: F.when((F.length(t) >= TRIGGER_LEAST) & F.contains(q, bare(t)), F.length(t)))
    return F.coalesce(F.array_max(hits), F.lit(0))


def usable(entries: DataFrame) -> DataFrame:
    return entries.filter("status = 'reviewed' AND citation_verified")


def route(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, slug, score of the entry that a comparing question goes to; others have no row.

    questions (query_id, text, embedding), entries (slug, title, triggers, legal_lines, status, citation_verified,
    embedding). With a question vector: the best cosine must reach 0.45, then cosine and 0.1 a character of the
    longest trigger decide. Without: only entries with a trigger, by shared lines (100 each) and trigger length. Ties
    go to the smaller slug. Reviewed entries are a stated set that is held against every question."""
    q = questions.filter(comparison(F.col("text"))).select("query_id", "text", F.col("embedding").alias("asked"))
    e = usable(entries).select("slug", "triggers", "legal_lines", "embedding")
    rows = q.join(small(e), F.lit(True)).withColumn("hit", trigger_hit(F.col("text"), F.col("triggers")))
    rows = rows.withColumn("near", F.when(F.col("asked").isNotNull(), cosine(F.col("embedding"), F.col("asked"))))
    shared = F.size(F.array_intersect(lines_of(F.col("text")), F.coalesce("legal_lines", F.array().cast("array<string>"))))
    top = F.max("near").over(Window.partitionBy("query_id"))
    score = F.when(F.col("asked").isNotNull(), F.when(F.col("top") >= SEMANTIC_LEAST, F.col("near") + PER_CHARACTER * F.col("hit"))).when(F.col("hit") > 0, (shared * 100 + F.col("hit")).cast("double"))
    rows = rows.withColumn("top", top).withColumn("score", F.round(score, 6)).filter("score IS NOT NULL")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slug"))
    return rows.withColumn("rn", rn).filter("rn = 1").select("query_id", "slug", "score")


def context(entries: DataFrame) -> DataFrame:
    """What an answer is given of an entry."""
    return entries.select("slug", "title", "summary", "content", "legal_lines", "citations")


def rendered(dimensions: Column) -> Column:
    """An entry's index (structs of name and rows of source, extracted, confidence, verified, original) as Markdown."""
    row = lambda r: F.concat(F.lit("- **"), r["source"], F.lit("** → "), r["extracted"], F.lit("（"), r["confidence"], F.lit("｜"), F.when(r["verified"], "✅").otherwise("⚠️未核实"), F.lit("）\n  > "), r["original"], F.lit("\n"))
    return F.rtrim(F.regexp_replace(F.array_join(F.transform(dimensions, lambda d: F.concat(F.lit("### "), d["name"], F.lit("\n"), F.array_join(F.transform(d["rows"], row), ""))), "\n"), r"\s+$", ""))


def compiled(drafts: DataFrame, passages: DataFrame) -> DataFrame:
    """drafts (slug, rows: structs of original and more) with every row checked word for word against the slug's
    passages (slug, passage); citation_verified: all rows are. New entries are drafts."""
    p = passages.filter("passage IS NOT NULL").groupBy("slug").agg(F.array_sort(F.collect_list("passage")).alias("p"))
    d = drafts.join(p, "slug", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    rows = F.transform("rows", lambda r: r.withField("verified", verbatim(r["original"], F.col("p"))))
    return d.withColumn("rows", rows).withColumn("citation_verified", (F.size("rows") > 0) & F.forall("rows", lambda r: r["verified"])).withColumn("status", F.lit("draft")).drop("p")
