"""Document metadata, each field with the evidence that it rests on. Column expressions over (text, filename)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import compact, title_of_filename

# Levels, issuers, marks and patterns of the regulations' own format.
LEVELS = {"law": ("法律", 1), "admin_regulation": ("行政法规", 2), "department_rule": ("部门规章", 3), "normative_document": ("规范性文件", 4), "self_regulation": ("自律规则", 5)}
VALIDITY = {"effective": "现行有效", "draft": "征求意见稿", "superseded": "已被修订", "repealed": "已废止"}
ISSUERS = {
    "中国证券监督管理委员会": "中国证券监督管理委员会|证监会",
    "上海证券交易所": "上海证券交易所|上交所",
    "深圳证券交易所": "深圳证券交易所|深交所",
    "北京证券交易所": "北京证券交易所|北交所",
    "中国证券业协会": "中国证券业协会",
    "中国证券投资基金业协会": "中国证券投资基金业协会",
    "中国期货业协会": "中国期货业协会",
    "全国人民代表大会常务委员会": "全国人民代表大会|全国人大常委会",
    "国务院": "国务院",
}
NUMBER_FORMS = (
    r"(?U)[〔\[［【]\s*(?:19|20)\d{2}\s*[〕\]］】]\s*第?\s*\d+\s*号",
    r"(?U)中国证券监督管理委员会令\s*第\s*[一二三四五六七八九十百零〇\d]+\s*号",
    r"(?U)第\s*[一二三四五六七八九十百零〇\d]+\s*号令",
)
DATE = r"((?:19|20)\d{2})年(\d{1,2})月(\d{1,2})日"
ISSUED, EFFECTIVE = "公布|发布|通过|修订|修正|批准", "施行|实施|生效|执行"
SCOPES = {"证券": "证券", "期货": "期货", "基金": "基金", "衍生品": "衍生品|衍生工具"}
# Issuers that a document of a level can have.
ISSUERS_OF_LEVEL = {
    "law": ("全国人民代表大会常务委员会", "国务院"),
    "admin_regulation": ("国务院",),
    "department_rule": ("中国证券监督管理委员会", "国务院"),
    "normative_document": ("中国证券监督管理委员会", "上海证券交易所", "深圳证券交易所", "北京证券交易所", "国务院"),
    "self_regulation": ("上海证券交易所", "深圳证券交易所", "北京证券交易所", "中国证券业协会", "中国证券投资基金业协会", "中国期货业协会", "中国证券监督管理委员会"),
}
DRAFT, PLACEHOLDER = "征求意见稿|征求意见|草案", r"T/[A-Z]+\s*0*X|\*{2,}"
LEVEL_OF_ISSUER = {
    "全国人民代表大会常务委员会": "law",
    "国务院": "admin_regulation",
    "中国证券监督管理委员会": "department_rule",
    "上海证券交易所": "self_regulation",
    "深圳证券交易所": "self_regulation",
    "北京证券交易所": "self_regulation",
    "中国证券业协会": "self_regulation",
    "中国证券投资基金业协会": "self_regulation",
    "中国期货业协会": "self_regulation",
}


def level_label(level: Column) -> Column:
    """The level's name; an unknown level keeps its own, none is unclassified."""
    table = F.create_map(*[F.lit(x) for k, (label, _) in LEVELS.items() for x in (k, label)])
    return F.when(F.coalesce(level, F.lit("")) == "", F.lit("未分类")).otherwise(F.coalesce(F.try_element_at(table, level), level))


def level_rank(level: Column) -> Column:
    """1 for the highest; null for no or an unknown level."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (_, rank) in LEVELS.items() for x in (k, rank)]), level)


def validity_label(validity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in VALIDITY.items() for x in (k, v)])
    return F.when(validity.isNull(), F.lit(VALIDITY["effective"])).otherwise(F.coalesce(F.try_element_at(table, validity), F.lit("未知")))


def validity(text: Column, title: Column) -> Column:
    head = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 1500))
    return F.when(head.rlike(DRAFT) | head.rlike(PLACEHOLDER), F.lit("draft")).otherwise(F.lit("effective"))


def scope(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    return F.filter(F.array(*[F.when(head.rlike(p), F.lit(k)) for k, p in SCOPES.items()]), lambda x: x.isNotNull())


def issuer(text: Column, level: Column | None = None) -> Column:
    """The first issuer in list order that the head names, else one that the whole text names. A known level
    allows its own issuers only, in its order."""
    body = F.coalesce(text, F.lit(""))
    parts = [compact(F.substring(body, 1, 800)), compact(body)]

    def first(names) -> Column:
        return F.coalesce(*[F.when(part.rlike(ISSUERS[k]), F.lit(k)) for part in parts for k in names])

    out = first(ISSUERS)
    for k, names in ISSUERS_OF_LEVEL.items() if level is not None else ():
        out = F.when(level == k, first(names)).otherwise(out)
    return out


def document_number(text: Column) -> Column:
    body = compact(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract(body, p, 0) for p in NUMBER_FORMS]
    return F.coalesce(*[F.when(x != "", x) for x in found])


def dates(text: Column, hints: str, window: int = 12) -> Column:
    """Dates, in order, with one of the hints within `window` characters before or after; others are skipped."""
    body = compact(F.coalesce(text, F.lit("")))
    near = F.regexp_extract_all(body, F.lit(rf"(?:(?:{hints})[^年月日]{{0,{window}}}{DATE})|(?:{DATE}(?=.{{0,{window}}}(?:{hints})))"), F.lit(0))
    parts = F.transform(near, lambda x: F.regexp_extract(x, DATE, 0))
    as_date = lambda x: F.try_to_date(F.regexp_replace(F.regexp_replace(x, "[年月]", "-"), "日", ""), "y-M-d")
    return F.filter(F.transform(parts, as_date), lambda d: d.isNotNull())


def issued_date(text: Column, filename: Column) -> Column:
    suffix = F.try_to_date(F.regexp_extract(filename, r"_((?:19|20)\d{6})(?:\.[A-Za-z]+)?$", 1), "yyyyMMdd")
    return F.coalesce(F.try_element_at(dates(text, ISSUED), F.lit(1)), suffix)


def effective_date(text: Column) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, 300)
    return F.coalesce(F.try_element_at(dates(head, EFFECTIVE), F.lit(1)), F.try_element_at(dates(text, EFFECTIVE), F.lit(-1)))


def title(text: Column, filename: Column) -> Column:
    """The file's name if it is long enough and has CJK characters, else the first line that could be a title."""
    stem = title_of_filename(filename)
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda x: x != ""), 1, 20)
    fit = F.filter(lines, lambda x: F.length(x).between(6, 60) & x.rlike("[一-鿿]") & ~x.rlike("[。；，]"))
    return F.when((F.length(stem) >= 6) & stem.rlike("[一-鿿]"), stem).otherwise(F.coalesce(F.try_element_at(fit, F.lit(1)), stem))


def infer_level(issuer_: Column, number: Column, title_: Column | None = None, text: Column | None = None) -> Column:
    """The issuer's level; of the commission's documents an order is a rule, anything else normative. Without a
    number, title and first 300 characters tell."""
    table = F.create_map(*[F.lit(x) for k, v in LEVEL_OF_ISSUER.items() for x in (k, v)])
    found = F.try_element_at(table, issuer_)
    none = F.lit("")
    head = F.concat(F.coalesce(title_, none), F.substring(F.coalesce(text, none), 1, 300)) if text is not None else none
    return F.when((found == "department_rule") & ~F.contains(F.coalesce(number, head), F.lit("令")), F.lit("normative_document")).otherwise(found)


def extract(text: Column, filename: Column, level: Column | None = None) -> Column:
    """One struct of all fields; evidence maps each found field to what it rests on."""
    t, who, number = title(text, filename), issuer(text, level), document_number(text)
    guess = infer_level(who, number, t, text)
    lv = F.coalesce(level, guess) if level is not None else guess
    fields = {"title": t, "regulator": who, "doc_number": number, "legal_level": lv, "level_rank": level_rank(lv), "issued_date": issued_date(text, filename), "effective_date": effective_date(text), "validity": validity(text, t), "scope": scope(text), "content_hash": F.sha2(F.coalesce(text, F.lit("")), 256)}
    proof = F.create_map(*[x for k, v in fields.items() if k != "scope" for x in (F.lit(k), F.when(v.isNotNull(), F.concat(F.lit(k + ": "), v.cast("string"))))])
    return F.struct(*[v.alias(k) for k, v in fields.items()], proof.alias("evidence"))
