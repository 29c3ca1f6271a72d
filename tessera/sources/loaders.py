"""Files to sections: text, Markdown, HTML, DOCX; PDF pages as they come from an extractor. Readers are Arrow
functions over binaryFile rows; everything after them is relational."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import clean_text, long_lines, unwrap_lines
from ..operators.split import ARTICLE

# Tags and container rules of the page reader.
DROPPED = {"script", "style", "noscript", "iframe", "svg", "title", "meta", "link", "base", "template"}
VOID = {"meta", "link", "base", "br"}  # tags without an end
BLOCKS = {"p", "div", "li", "tr", "td", "th", "br", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt"}
CONTAINERS = {"div", "article", "section", "td", "main"}
HINT = re.compile(r"(^|[\s_-])(content|article|main|text|zoom|body)([\s_-]|$)", re.I)
CRUMBS = ("面包屑开始", "面包屑结束")
CHAPTER_LINE = re.compile(r"^第([一二三四五六七八九十百零〇\d]+)章\s*(.*)$")
FOREWORD = "（前言）"
CONTAINER_LEAST, ARTICLE_POINTS = 200, 1000
SECTION = "path string, parser string, section_index int, title string, text string, warning string"
HEADING = re.compile(r"^(#{1,6})\s+(\S.*)$")


def decode(raw: bytes) -> str:
    """UTF-8 (with or without BOM), else GB18030, else UTF-8 with replacement; judged on the first 20 000 bytes."""
    head = raw[:20_000]
    for name in ("utf-8-sig", "gb18030"):
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            if len(raw) == len(head) or e.start < len(head) - 4:  # else the cut may have split a character
                continue
        return raw.decode(name, "replace")
    return raw.decode("utf-8", "replace")


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(title, text) per heading, which stays in its text; text before the first is untitled; empty ones go."""
    out: list[tuple[str, list[str]]] = [("(start)", [])]
    for line in text.split("\n"):
        m = HEADING.match(line.strip())
        if m:
            out.append((m.group(2).strip(), []))
        out[-1][1].append(line)
    return [(t, "\n".join(x).strip()) for t, x in out if "\n".join(x).strip()]


#: Ends a paragraph; no text has it.
BREAK = "\0"


class Page(HTMLParser):
    """Text of blocks, and for each container candidate where its text begins and ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.found, self.open, self.skip, self.in_title = "", [], [], [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag in DROPPED and tag not in VOID:
            self.skip += 1
        if tag in BLOCKS:
            self.out.append(BREAK)
        a = dict(attrs)
        if tag in CONTAINERS:
            self.open.append((tag, bool(HINT.search(f"{a.get('id') or ''} {a.get('class') or ''}".strip())), len(self.out)))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in DROPPED and tag not in VOID:
            self.skip = max(0, self.skip - 1)
        if tag in BLOCKS:
            self.out.append(BREAK)
        if tag in CONTAINERS:
            while self.open:
                t, hint, at = self.open.pop()
                if hint and t == tag:
                    self.found.append((at, len(self.out)))
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(data.replace(BREAK, ""))

    def paragraphs(self, a: int = 0, b: int | None = None) -> list[str]:
        lines = [re.sub(r"[\s\u3000]+", " ", x).strip() for x in "".join(self.out[a:b]).split(BREAK)]
        return without_crumbs([x for x in lines if x])


def without_crumbs(lines: list[str]) -> list[str]:
    """lines less the navigation between a start mark and the first end mark after it, if both are there."""
    start = next((i for i, x in enumerate(lines) if CRUMBS[0] in x), None)
    end = next((i for i, x in enumerate(lines) if CRUMBS[1] in x and start is not None and i >= start), None)
    return lines if end is None else lines[:start] + lines[end + 1 :]


def html_lines(html: str) -> tuple[str, list[str], bool]:
    """title, paragraphs of the body and whether most of the page was left out. The best container has most
    article marks, then the longest text; the first of equals; without one, the whole page."""
    p = Page()
    p.feed(html or "")
    squeeze = lambda x: " ".join("".join(x).replace(BREAK, "").split())
    best, points = (0, None), -1
    for a, b in sorted(p.found):
        t = squeeze(p.out[a:b])
        if len(t) >= CONTAINER_LEAST and (s := ARTICLE_POINTS * len(ARTICLE.findall(t)) + len(t)) > points:
            best, points = (a, b), s
    body = p.paragraphs(*best)
    whole = len(squeeze(p.out))
    return p.title.strip(), body, whole > 0 and 1 - sum(map(len, body)) / whole > 0.5


def html_body(html: str) -> tuple[str, str, bool]:
    title, body, noisy = html_lines(html)
    return title, "\n".join(body), noisy


def html_sections(title: str, lines: list[str]) -> list[tuple[str, str]]:
    """(title, text) of each chapter, after what stands before the first; all in one with fewer than two chapters."""
    if sum(bool(CHAPTER_LINE.match(x)) for x in lines) < 2:
        return [(title, "\n".join(lines))]
    out: list[tuple[str, list[str]]] = [(f"{title}{FOREWORD}", [])]
    for x in lines:
        if m := CHAPTER_LINE.match(x):
            out.append((f"第{m.group(1)}章 {m.group(2).strip()}".strip(), []))
        out[-1][1].append(x)
    return [(t, "\n".join(x)) for t, x in out if "".join(x).strip()]


def docx_sections(raw: bytes) -> tuple[list[tuple[str, str]], int]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{w}body")
    out: list[tuple[str, list[str]]] = [("(start)", [])]
    for p in body.findall(f"{w}p"):
        text, style = "".join(t.text or "" for t in p.iter(f"{w}t")).strip(), p.find(f"{w}pPr/{w}pStyle")
        if style is not None and (style.get(f"{w}val") or "").startswith("Heading") and text:
            out.append((text, []))
        if text:
            out[-1][1].append(text)
    return [(t, "\n".join(x)) for t, x in out if x], len(body.findall(f"{w}tbl"))


def parse(path: str, raw: bytes) -> list[tuple]:
    """Section rows of one file; a file that no reader takes gives one row with the reason."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if suffix == "txt":
            return [(path, "text", 0, "full_text", decode(raw), None)]
        if suffix == "md":
            return [(path, "markdown", i, t, x, None) for i, (t, x) in enumerate(markdown_sections(decode(raw)))]
        if suffix in ("html", "htm"):
            title, body, noisy = html_lines(decode(raw))
            return [(path, "html", i, t or "html_body", x, "most of the page was left out" if noisy and not i else None) for i, (t, x) in enumerate(html_sections(title, body))]
        if suffix == "docx":
            found, tables = docx_sections(raw)
            return [(path, "docx", i, t, x, f"{tables} tables were left out" if tables and not i else None) for i, (t, x) in enumerate(found)]
        return [(path, "none", 0, None, None, f"unknown type {suffix}")]
    except Exception as e:  # a broken file is a row, not a failed job
        return [(path, "none", 0, None, None, f"unreadable: {type(e).__name__}")]


def inline_text(rows: DataFrame) -> DataFrame:
    """Sections of texts given as values: rows (path, text); a path ending in .md is read by headings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, t in zip(b.path, b.text, strict=True):
                found = markdown_sections(t or "") if p.lower().endswith(".md") else [("inline_text", t or "")]
                out += [(p, "inline_text", i, name, x, None) for i, (name, x) in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "parser", "section_index", "title", "text", "warning"])

    return rows.select("path", "text").mapInPandas(run, SECTION).withColumn("text", clean_text(F.col("text")))


def load_files(spark: SparkSession, path: str, most_bytes: int = 50 << 20) -> DataFrame:
    """path, parser, section_index, title, text (cleaned), warning of all files under path up to most_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b.path, b.content, strict=True) for r in parse(p, bytes(c))], columns=["path", "parser", "section_index", "title", "text", "warning"])

    return files.select("path", "content").mapInPandas(run, SECTION).withColumn("text", clean_text(F.col("text")))


def load_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, raw text -> one section per page, empty ones too, cleaned and unwrapped."""
    return pages.select("doc_id", "page_number", (F.col("page_number") - 1).alias("section_index"), unwrap_lines(clean_text(F.col("text"))).alias("text"))


def page_warnings(sections: DataFrame) -> DataFrame:
    """Per document: pages, empty pages, lines too long, and the warning they give."""
    g = sections.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty_pages"), F.sum(long_lines(F.coalesce("text", F.lit("")))).alias("long_lines"))
    return g.withColumn("warning", F.when(F.col("empty_pages") * 2 >= F.col("pages"), "half of the pages or more are empty").when(F.col("empty_pages") > 0, "some pages are empty").when(F.col("long_lines") > F.col("pages"), "many long lines"))


def load_html_table(pages: DataFrame) -> DataFrame:
    """page_id, title, body, noisy of a table of raw pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *html_body(h)) for i, h in zip(b.page_id, b.html, strict=True)], columns=["page_id", "title", "body", "noisy"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, body string, noisy boolean")


def apply_overrides(docs: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """docs with the fields that overrides (filename, values map) name: a null value overwrites, a missing key
    doesn't."""
    j = docs.join(overrides.select("filename", "values"), "filename", "left")
    return j.select(*[F.when(F.coalesce(F.map_contains_key("values", F.lit(c)), F.lit(False)), F.try_element_at("values", F.lit(c)).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in docs.columns])


def eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """The newest report under path by modification time, with its header."""
    rows = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path).select("*", F.col("_metadata.file_modification_time").alias("_at"))
    newest = rows.agg(F.max("_at").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("_at") == F.col("_newest")).drop("_at", "_newest")
