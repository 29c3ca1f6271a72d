"""Cleaning and normalisation as columns, expressions but for unwrapping; (?U) gives Java's classes their Unicode meaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Character ranges, limits and marks of the source format.
CJK = r"一-鿿　-〿＀-￯"
LONG_LINE = 300
NUMERALS = "一二三四五六七八九十百零〇"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what Java's (?U)\s means
STARTS = re.compile(rf"第[{NUMERALS}\d]{{1,4}}[条章节编]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\)|#{{1,6}}[{SPACE}]|[IVX]{{1,5}}\.[{SPACE}]")
PAGE, DASHES = re.compile(rf"[{SPACE}—\-–]*\d{{1,4}}[{SPACE}—\-–]*"), re.compile(rf"[{SPACE}—\-–]*")
SENTENCE_ENDS, CJK_CHAR = "。！？；：", re.compile(f"[{CJK}]")


def sub(col: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col, pattern, to)


def strip(col: Column) -> Column:
    """Python's strip: any Unicode white space at both ends."""
    return sub(sub(col, r"(?U)^[\s\x1c-\x1f]+"), r"(?U)[\s\x1c-\x1f]+$")


def compact(col: Column) -> Column:
    return sub(col, r"(?U)\s+")


def clean_text(col: Column) -> Column:
    """Line ends, hyphenated breaks, blanks after numbered headings and between CJK characters, line tails, blank runs."""
    x = sub(sub(col, r"\r\n?", "\n"), r"(?U)(\w)-\n(\w)", "$1$2")
    x = sub(x, rf"(?U)(第[{NUMERALS}\d]{{1,4}}[条章节编])[ \t]+", "$1　")
    x = sub(x, rf"(?<=[{CJK}])[ \t]+(?=[{CJK}])")
    return strip(sub(sub(x, r"(?U)(?m)[^\S\n]+$"), r"\n{3,}", "\n\n"))


def unwrapped(text: str) -> str:
    """text with its wrapped lines joined, in one pass: of the line so far only its last part, and whether it's dashes,
    a page number or neither, decide how it goes on."""
    out: list[str] = []
    last, kind = "", ""
    for i, raw in enumerate(text.split("\n")):
        line = raw.strip()
        own = "page" if PAGE.fullmatch(line) else "dashes" if DASHES.fullmatch(line) else "text"
        if not i or not line or not last or last[-1] in SENTENCE_ENDS or last[-1] == "第" or kind == "page" or STARTS.match(line):
            out += ["\n", line] if i else [line]
            kind = own
        else:
            out += [line] if CJK_CHAR.match(last[-1]) or CJK_CHAR.match(line) else [" ", line]
            kind = own if kind == "dashes" else kind
        last = line
    return "".join(out)


def unwrap_lines(col: Column) -> Column:
    """Join wrapped lines: a line goes on in the next one unless it ends a sentence, is a page number or ends
    with a lone ordinal mark, or the next starts a structure."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unwrapped(t))

    return F.pandas_udf(run, "string")(col)


def long_lines(col: Column) -> Column:
    return F.size(F.filter(F.split(col, "\n"), lambda x: F.length(x) > LONG_LINE))


def token_estimate(col: Column) -> Column:
    n = F.length(F.coalesce(col, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3))).cast("int")


def query_form(col: Column) -> Column:
    """A query as it's matched: without title marks and white space."""
    return compact(F.translate(col, "《》", ""))


def title_form(col: Column) -> Column:
    """A title as users type it: also without bracketed endings, however many."""
    return sub(query_form(col), r"(?:[（(][^（()）]*[）)])+$")


def verify_form(col: Column) -> Column:
    """Text as quotations are compared: without white space and page furniture."""
    return sub(sub(compact(F.coalesce(col, F.lit(""))), "[—–\\-][０-９0-9]{1,4}[—–\\-]"), "全国人民代表大会常务委员会公报[０-９0-9·．.]*")


def safe_filename(col: Column) -> Column:
    base = F.element_at(F.split(col, r"[/\\]"), -1)
    x = sub(base, r"[^A-Za-z0-9._-]+", "_")
    return F.when(F.coalesce(x, F.lit("")).isin("", "_"), F.lit("file")).otherwise(x)


def title_of_filename(col: Column) -> Column:
    return strip(sub(sub(sub(col, r"\.[A-Za-z0-9]+$"), r"_\d{6,8}$"), r"(?U)\s*\(\d+\)$"))


def cn_date(col: Column) -> Column:
    return F.concat(F.year(col), F.lit("年"), F.month(col), F.lit("月"), F.day(col), F.lit("日"))


def scope_text(col: Column) -> Column:
    some = F.filter(F.coalesce(col, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) == 0, F.lit(";")).otherwise(F.concat(F.lit(";"), F.array_join(some, ";"), F.lit(";")))


def hash_preview(col: Column) -> Column:
    return F.substring(col, 1, 8)


def bare(col: Column) -> Column:
    """Without the particles that questions and triggers differ in."""
    return F.translate(F.coalesce(col, F.lit("")), "的上了中里着", "")
