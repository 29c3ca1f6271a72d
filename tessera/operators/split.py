"""Structure-aware splitting of sections into chunks.

A document's text is one value, so splitting is a function of a row: it runs in Arrow batches. What spans
sections (article inheritance, chunk numbers, statistics) is relational."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import NUMERALS

# Sizes and marks of the chunking rules.
SIZE, HARD, SMALLEST, OVERLAP = 500, 1000, 80, 50
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ")
LEGAL_LEAST, HEADINGS_LEAST, HEADING_LINES, HEADING_MOST = 5, 3, 400, 110
ARTICLE = re.compile(rf"第(?:\s{{0,3}}[{NUMERALS}])+\s{{0,3}}条|第\d+条")
CHAPTER = re.compile(rf"^第[{NUMERALS}\d]{{1,4}}[章节编]")
REFERS = re.compile(rf"规定|所称|所列|列明|要求|规定情形|第[{NUMERALS}\d]+[款项]")
CONNECTORS, ENDS, BLANK = "、，,。；;：:至和及与或称并且", "。；;：:\n", " \t　"
STRONG = re.compile(r"#{1,6}\s+\S|第[一二三四五六七八九十百千]+[条章节编]|(?i:Article)\s+\d+|Standard\s+[IVX]+(?:\s*\([A-Z]\))?\b|[IVX]{1,5}\.\s+[A-Z]|\d+\.\s+[A-Z]|[A-Z][A-Z0-9 ,&/'\-]{8,}$")
WEAK = re.compile(r"[A-Z]\.\s+\S|\d+\.\d+\s+\S|[a-z]\)\s+\S")
PART = 4_000_000  # bytes of text held as Python objects at once; a longer text is alone
CHUNK = "start int, end int, content string, article_number string"


def boundaries(text: str) -> Iterator[tuple[int, str, bool, str]]:
    """(place, token, accepted, reason) of every article token."""
    for m in ARTICLE.finditer(text):
        before, after = text[: m.start()].rstrip(BLANK), text[m.end() :].lstrip(BLANK + "\r\n")
        token = re.sub(r"\s", "", m.group())
        opens = not before or before[-1] in ENDS
        if not opens:  # a short chapter title may stand before on its line
            line = before[before.rfind("\n") + 1 :]
            opens = len(line) <= 12 and not re.search(r"[，。；：、]", line) and bool(CHAPTER.match(before[: -len(line) or None].rstrip().split("\n")[-1].strip())) and before[: -len(line)].endswith("\n\n")
        if not opens:
            yield m.start(), token, False, "no terminator before"
        elif after[:1] and after[0] in CONNECTORS:
            yield m.start(), token, False, "connector after"
        elif REFERS.match(after):
            yield m.start(), token, False, "reference continues"
        else:
            yield m.start(), token, True, ""


def cut(text: str, start: int, limit: int) -> int:
    """Where a piece from start ends: with the text if less than 30 % of limit would remain, else after the
    rightmost separator past half, else at the last space past half, else at the limit."""
    end = min(start + limit, len(text))
    if len(text) - end < limit * 0.3:
        return len(text)
    half = start + limit // 2
    found = [i + len(s) for s in SEPARATORS if (i := text.rfind(s, half, end)) >= 0]
    if found:
        return max(found)
    space = text.rfind(" ", half + 1, end)
    return space + 1 if space >= 0 else end


def pieces(text: str, a: int, b: int, limit: int, hard: int = HARD) -> list[tuple[int, int]]:
    """The range a to b in pieces, until what is left isn't longer than hard."""
    out = []
    while b - a > hard:
        e = min(cut(text, a, limit), b)
        out.append((a, e))
        a = e
    return [*out, (a, b)] if a < b else out


def level(line: str) -> int:
    s = line.strip()
    return 0 if not s or len(s) > HEADING_MOST else 2 if STRONG.match(s) else 1 if WEAK.match(s) else 0


def looks_legal(text: str) -> bool:
    return sum(ok for *_, ok, _ in boundaries(text)) >= LEGAL_LEAST


def looks_structured(text: str) -> bool:
    return sum(level(x) > 0 for x in text.split("\n")[:HEADING_LINES]) >= HEADINGS_LEAST


def split_fixed(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, None]]:
    out, a = [], 0
    while a < len(text):
        b = min(len(text), a + size)
        if b < len(text):
            half = a + size // 2
            b = max([text.rfind(s, half, b) + len(s) for s in SEPARATORS if text.rfind(s, half, b) >= 0], default=b)
            b = min(b, a + size)
        if text[a:b].strip():
            out.append((a, b, None))
        if b >= len(text):
            break
        a = max(b - overlap, a + 1)
    return out


def split_semantic(text: str, size: int = SIZE, hard: int = HARD) -> list[tuple[int, int, None]]:
    """Units open at headings, consecutive headings share one; small or weak neighbours merge up to size; longer
    than hard are cut again; ranges below the least size join a neighbour."""
    units: list[list[int]] = []
    at, last = 0, 0
    for line in text.split("\n"):
        now = level(line)
        if not units or (now and not last):
            units.append([at, at, now])
        last, at = now, at + len(line) + 1
        units[-1][1] = min(at, len(text))
    merged: list[list[int]] = []
    for a, b, lv in units:
        if merged and b - merged[-1][0] <= size and ((lv < 2 and merged[-1][2] < 2) or min(b - a, merged[-1][1] - merged[-1][0]) < SMALLEST):
            merged[-1][1] = b
        else:
            merged.append([a, b, lv])
    ranges = [r for a, b, _ in merged for r in pieces(text, a, b, size, hard)]
    out: list[list[int]] = []
    for a, b in ranges:
        if out and len(text[a:b].strip()) < SMALLEST:
            out[-1][1] = b
        elif len(out) == 1 and len(text[out[0][0] : out[0][1]].strip()) < SMALLEST:
            out[0][1] = b
        else:
            out.append([a, b])
    return [(a, b, None) for a, b in out if text[a:b].strip()]


def split_legal(text: str, size: int = SIZE, hard: int = HARD) -> list[tuple[int, int, str | None]]:
    """One article, one chunk; a longer one is cut and all pieces keep its number; what stands before the first
    article has none. Without any boundary: by headings."""
    marks = [(p, t) for p, t, ok, _ in boundaries(text) if ok]
    if not marks:
        return split_semantic(text, size, hard)
    spans = [(0, marks[0][0], None)] if text[: marks[0][0]].strip() else []
    spans += [(p, marks[i + 1][0] if i + 1 < len(marks) else len(text), t) for i, (p, t) in enumerate(marks)]
    return [(a, b, t) for x, y, t in spans for a, b in pieces(text, x, y, size, hard)]


SPLITTERS = {"legal": split_legal, "semantic": split_semantic, "unstructured": split_fixed}


def choose(whole: str) -> str:
    return "legal" if looks_legal(whole) else "semantic" if looks_structured(whole) else "unstructured"


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of batches, as few at once as their texts are long."""
    for b in batches:
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy())]
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
            yield b.slice(at, to - at).to_pandas()
            at = to


def batch_of(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def document_splitters(sections: DataFrame) -> DataFrame:
    """doc_id, whole: the splitter that a document's sections call for together: legal with enough article
    boundaries in all, semantic with enough headings among its first lines, else by size. No text is moved."""

    kind = pa.schema({"doc_id": pa.int64(), "section_index": pa.int32(), "articles": pa.int64(), "n_lines": pa.int64(), "heads": pa.list_(pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for doc, sec, text in zip(b.doc_id, b.section_index, b.text, strict=True):
                lines = (text or "").split("\n")
                heads = [i for i, x in enumerate(lines[:HEADING_LINES]) if level(x) > 0]
                rows.append((doc, sec, sum(ok for *_, ok, _ in boundaries(text or "")), len(lines) + 1, heads))
            yield batch_of(rows, kind)

    found = sections.filter("text <> ''").select("doc_id", "section_index", "text").mapInArrow(run, "doc_id long, section_index int, articles long, n_lines long, heads array<long>")
    before = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("at", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
    g = found.groupBy("doc_id").agg(F.sum("articles").alias("articles"), F.sum(F.size(F.filter("heads", lambda i: i + F.col("at") < HEADING_LINES))).alias("heads"))
    return g.select("doc_id", F.when(F.col("articles") >= LEGAL_LEAST, "legal").when(F.col("heads") >= HEADINGS_LEAST, "semantic").otherwise("unstructured").alias("whole"))


def split_sections(sections: DataFrame, splitter: str = "auto") -> DataFrame:
    """sections (doc_id, section_index, text) -> doc_id, section_index, splitter, start, end, content,
    article_number. With auto, a document's sections are split alike, but for sections of an unstructured one
    that have headings of their own."""
    auto = splitter == "auto"
    rows = sections.select("doc_id", "section_index", "text")
    rows = rows.join(document_splitters(sections), "doc_id", "left") if auto else rows.withColumn("whole", F.lit(splitter))

    kind = pa.schema({"doc_id": pa.int64(), "section_index": pa.int32(), "splitter": pa.string(), "start": pa.int32(), "end": pa.int32(), "content": pa.string(), "article_number": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = []
            for doc, sec, text, name in zip(b.doc_id, b.section_index, b.text, b.whole, strict=True):
                text = text or ""
                if auto and name != "legal" and choose(text) == "semantic":
                    name = "semantic"
                name = name or "unstructured"
                rows += [(doc, sec, name, x, y, text[x:y], t) for x, y, t in SPLITTERS[name](text)]
            yield batch_of(rows, kind)

    return rows.select("doc_id", "section_index", "text", "whole").mapInArrow(run, f"doc_id long, section_index int, splitter string, {CHUNK}")


def boundary_audit(docs: DataFrame) -> DataFrame:
    """doc_id, place, token, accepted, reason."""

    kind = pa.schema({"doc_id": pa.int64(), "place": pa.int32(), "token": pa.string(), "accepted": pa.bool_(), "reason": pa.string()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield batch_of([(d, *x) for d, t in zip(b.doc_id, b.text, strict=True) for x in boundaries(t or "")], kind)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place int, token string, accepted boolean, reason string")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_index in document order, and under the legal splitter the last article number carried on."""
    order = Window.partitionBy("doc_id").orderBy("section_index", "start")
    carried = F.last("article_number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("article_number", F.when(F.col("splitter") == "legal", carried).otherwise(F.col("article_number"))).withColumn("chunk_index", F.row_number().over(order) - 1)


def mid_word(text: Column, start: Column) -> Column:
    return (start > 0) & F.coalesce(F.substr(text, start, F.lit(2)).rlike("^[A-Za-z]{2}$"), F.lit(False))


def chunk_stats(chunks: DataFrame, content: str = "content", broken: str = "broken") -> DataFrame:
    n = F.length(content)
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.bround(F.avg(n)).cast("long").alias("avg_length"), F.max(n).alias("max_length"), F.min(n).alias("min_length"),
        F.count_if(broken).alias("broken_count"), F.bround(F.count_if(broken) / F.count("*"), 4).alias("broken_ratio"),
    )


def opens_article(content: Column) -> Column:
    """Whether a chunk starts an article (else it goes on with one)."""
    return F.coalesce(F.regexp_replace(content, r"(?U)^\s+", "").rlike(rf"(?U)^(?:第(?:\s{{0,3}}[{NUMERALS}])+\s{{0,3}}条|第\d+条)"), F.lit(False))
