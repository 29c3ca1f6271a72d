"""Cited articles: what a question, an entry or an answer cites, found in the tables.

Names meet texts by substrings that both must hold, so no join lists all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numerals import article_number, article_tokens
from ..functions.text import query_form, title_form
from .retrieve import BROADCAST_ROWS, small

LEAST = 3  # characters of a title's ending that name it


def substrings(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    last = F.length(text) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def document_refs(documents: DataFrame) -> DataFrame:
    """document_id, title of indexed documents; without a title the file name's stem."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return documents.filter("status = 'indexed'").select("document_id", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(stem).alias("title"))


def longest_endings(held: DataFrame, names: DataFrame) -> DataFrame:
    """held (query_id, form), names (document_id, title, name) -> query_id, document_id, title, matched: of the names
    of which form holds an ending, the one with the longest, then the shortest, then of the smallest document_id.

    Every ending of a name stands for the first of the names that share it, so a question meets an ending once,
    however many names have it. Only places where some name's last characters stand are looked at."""
    tails = names.groupBy(F.right("name", F.lit(LEAST)).alias("tail")).agg(F.max(F.length("name")).alias("most"))
    places = held.filter(F.length("form") >= LEAST).select("query_id", "form", F.explode(F.sequence(F.lit(LEAST), F.length("form"))).alias("to"))
    places = places.withColumn("tail", F.substr("form", F.col("to") - (LEAST - 1), F.lit(LEAST))).join(small(tails), "tail")
    rows = places.select("query_id", "form", "to", F.explode(F.sequence(F.lit(LEAST), F.least("to", "most"))).alias("matched"))
    rows = rows.select("query_id", "matched", F.substr("form", F.col("to") - F.col("matched") + 1, F.col("matched")).alias("ending"))
    known = names.select("document_id", "title", "name", F.length("name").alias("n"), F.explode(F.sequence(F.lit(LEAST), F.length("name"))).alias("k"))
    known = known.select(F.right("name", F.col("k")).alias("ending"), "n", "document_id", "title")
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        rows = F.broadcast(rows)
        known = known.join(F.broadcast(rows.select("ending").distinct()), "ending", "left_semi")
    first = known.groupBy("ending").agg(F.min(F.struct("n", "document_id", "title")).alias("first"))
    met = first.join(rows, "ending").groupBy("query_id").agg(F.min(F.struct((-F.col("matched")).alias("less"), "first")).alias("best"))
    return met.select("query_id", "best.first.document_id", "best.first.title", (-F.col("best.less")).alias("matched"))


def parse_citations(questions: DataFrame, refs: DataFrame) -> DataFrame:
    """questions (query_id, text) -> query_id, usable, article, number, document_id, title, matched, reason.

    Usable: one article, as written, with a number, and a known title of which the question holds an ending of three
    characters or more; the longest ending wins, then the shorter title, then the smaller document_id."""
    tokens = F.array_distinct(article_tokens(F.coalesce("text", F.lit(""))))
    q = questions.select("query_id", query_form(F.coalesce("text", F.lit(""))).alias("form"), tokens.alias("tokens"))
    q = q.withColumn("article", F.when(F.size("tokens") == 1, F.get("tokens", F.lit(0)))).withColumn("number", article_number(F.col("article")))
    names = refs.select("document_id", "title", title_form(F.coalesce("title", F.lit(""))).alias("name")).filter(F.length("name") >= LEAST)
    best = longest_endings(q.filter("number IS NOT NULL").select("query_id", "form"), names)
    out = q.join(best, "query_id", "left")
    reason = F.when(F.size("tokens") == 0, "no article").when(F.size("tokens") > 1, "several articles").when(F.col("number").isNull(), "article without a number").when(F.col("document_id").isNull(), "no known title").otherwise("ok")
    return out.select("query_id", (reason == "ok").alias("usable"), "article", "number", "document_id", "title", F.coalesce("matched", F.lit(0)).alias("matched"), reason.alias("reason"))


def cited_pieces(cited: DataFrame, chunks: DataFrame, by: str = "query_id", enabled: bool = True) -> DataFrame:
    """cited (by, document_id, number) -> by, document_id, chunk_id, chunk_index, piece: the article's chunks in order."""
    found = chunks.filter("enabled AND article_int IS NOT NULL" if enabled else "article_int IS NOT NULL")
    hits = cited.select(by, "document_id", F.col("number").alias("article_int")).distinct().join(found, ["document_id", "article_int"])
    piece = F.row_number().over(Window.partitionBy(by).orderBy("document_id", "chunk_index"))
    return hits.select(by, "document_id", "chunk_id", "chunk_index", piece.alias("piece"))


def entry_evidence(entries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """entries (slug, citations: structs of name and article) -> slug, chunks that these mean; a document is known by
    title or file name, the smaller document_id of several; what isn't found is left out."""
    c = entries.select("slug", F.explode("citations").alias("c")).select("slug", F.col("c.name").alias("name"), article_number(F.col("c.article")).alias("number"))
    known = documents.select("document_id", F.explode(F.array_distinct(F.array("title", "filename"))).alias("name")).filter("name IS NOT NULL").groupBy("name").agg(F.min("document_id").alias("document_id"))
    return cited_pieces(c.filter("number IS NOT NULL").join(known, "name"), chunks, "slug")


def passages(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """sources (slug, filename, article) -> slug, filename, article, passage: all pieces of the article, disabled ones
    too, joined by line ends; null where there is none."""
    s = sources.select("slug", "filename", "article", article_number(F.col("article")).alias("article_int"))
    ids = documents.groupBy("filename").agg(F.min("document_id").alias("document_id"))
    pieces = chunks.filter("article_int IS NOT NULL").groupBy("document_id", "article_int").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("p"))
    out = s.join(ids, "filename", "left").join(pieces, ["document_id", "article_int"], "left")
    return out.select("slug", "filename", "article", F.when(F.col("p").isNotNull(), F.array_join(F.transform("p", lambda x: x["content"]), "\n")).alias("passage"))


def citations_exist(citations: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (id, name, article), less those without either, with verified: a document whose title contains the
    name has the article."""
    c = citations.select("id", F.trim("name").alias("name"), F.trim("article").alias("article")).filter("name <> '' AND article <> ''").withColumn("article_int", article_number(F.col("article")))
    two = F.length("name") >= 2
    asked = c.select("name").distinct().withColumn("key", F.when(two, F.substring("name", 1, 2)).otherwise(F.substring("name", 1, 1)))
    titles = documents.select("document_id", "title", F.explode(F.concat(substrings(F.col("title"), 2), substrings(F.col("title"), 1))).alias("key"))
    met = asked.join(titles, "key").filter(F.contains("title", F.col("name"))).select("name", "document_id").distinct()
    have = met.join(chunks.filter("article_int IS NOT NULL").select("document_id", "article_int").distinct(), "document_id").select("name", "article_int", F.lit(True).alias("found")).distinct()
    return c.join(have, ["name", "article_int"], "left").select("id", "name", "article", F.coalesce("found", F.lit(False)).alias("verified"))
