"""Article tokens and Chinese numerals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import NUMERALS, compact

#: An article token: numerals with up to three white space characters anywhere inside, or plain digits.
TOKEN = rf"(?U)第(?:\s{{0,3}}[{NUMERALS}])+\s{{0,3}}条|第\d+条"
DIGITS = "一二三四五六七八九"


def spell(n: int) -> str:
    """1..999 as it's written after an ordinal mark; the rule that the lookup tables come from."""
    h, t, u = n // 100, n // 10 % 10, n % 10
    out = f"{DIGITS[h - 1]}百" if h else ""
    if t:
        out += "十" if t == 1 and not h else f"{DIGITS[t - 1]}十"
    elif h and u:
        out += "零"
    return out + (DIGITS[u - 1] if u else "")


def article_tokens(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0)), compact)


def article_number(col: Column) -> Column:
    """The number of an article token, null for what isn't one (thousands, other signs, nothing)."""
    body = F.regexp_extract(compact(col), rf"^第?([{NUMERALS}0-9]+)条?$", 1)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    chars = F.filter(F.split(body, ""), lambda x: x != "")
    table = F.create_map(*[x for i, c in enumerate(DIGITS) for x in (F.lit(c), F.lit(i + 1))], F.lit("零"), F.lit(0), F.lit("〇"), F.lit(0))

    def fold(acc: Column, c: Column) -> Column:
        unit = F.when(c == "十", F.lit(10)).when(c == "百", F.lit(100))
        held = F.when((c == "十") & (acc["digit"] == 0), F.lit(1)).otherwise(acc["digit"])
        total = F.when(unit.isNotNull(), acc["total"] + held * unit).otherwise(acc["total"])
        digit = F.when(unit.isNotNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(0)))
        return F.struct(total.alias("total"), digit.alias("digit"))

    spelled = F.aggregate(chars, zero, fold, lambda acc: acc["total"] + acc["digit"])
    return F.when(body == "", F.lit(None)).when(body.rlike("^[0-9]+$"), body.try_cast("int")).when(body.rlike("[0-9]"), F.lit(None)).otherwise(spelled)
