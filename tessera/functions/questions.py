"""What a question asks for: business lines, comparisons, sub-questions, cited titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import strip

# Business lines, comparison marks and fillers of the question language.
LINES = ("证券", "期货", "基金")
MARKERS = (
    "区别", "差异", "不同", "对比", "相比", "分别", "异同", "一样吗", "有什么不一样",
    "共同要求", "共同点", "各自负责", "分别由谁", "分别负责",
    "有什么不同", "有何不同", "异同点", "是否一致",
    "谁负责",
)
FILLERS = ("有什么", "什么", "和", "与", "、", "，", ",", "及", "吗", "？", "?")
INDUSTRY = "证券期货(?=投资者|市场|经营机构|业|监管|交易场所|规章|法律|行业)"
INDUSTRY_TAILS = ("投资者", "市场", "经营机构", "业", "监管", "交易场所", "规章", "法律", "行业")


def lines_of(q: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(q, F.lit("")), INDUSTRY, "")
    return F.filter(F.array(*[F.when(bare.contains(x), F.lit(x)) for x in LINES]), lambda x: x.isNotNull())


def compares(q: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(q.contains(m), F.lit(False)) for m in MARKERS])


def comparison(q: Column, parallel: tuple[str, ...] = ("各", "哪些机构", "分工")) -> Column:
    many = reduce(lambda a, b: a | b, [F.coalesce(q.contains(m), F.lit(False)) for m in parallel])
    return compares(q) & ((F.size(lines_of(q)) >= 2) | many)


def sub_questions(q: Column) -> Column:
    """One question per named line, without the other lines' names, comparison marks and fillers; none if any
    two would be equal or fewer than two lines are compared."""
    text, lines = F.coalesce(q, F.lit("")), lines_of(q)

    def restate(line: Column) -> Column:
        x = text
        for other in LINES:
            gone = F.replace(F.replace(x, F.lit(f"{other}线"), F.lit("")), F.lit(other), F.lit(""))
            x = F.when((line != other) & F.array_contains(lines, other), gone).otherwise(x)
        for m in (*MARKERS, *FILLERS):
            x = F.replace(x, F.lit(m), F.lit(""))
        return strip(x)

    out = F.filter(F.transform(lines, restate), lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.when(compares(q) & (F.size(lines) >= 2) & (F.size(F.array_distinct(out)) == F.size(out)), out).otherwise(none)


def title_suffix(title: Column, question: Column, least: int = 3) -> Column:
    """Length of the longest ending of title, of `least` characters or more, that the question holds; else 0.

    Titles of two forms only: a whole match, or an ending that is long enough to tell documents apart."""
    n = F.length(title)
    ends = F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    hit = F.filter(ends, lambda k: F.contains(question, F.right(title, k)))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0))
