"""Checks of answers against what was retrieved, and of questions against their answers, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import any_of, let

ISSUES = "array<struct<kind:string,value:string>>"


@dataclass(frozen=True)
class Grounding:
    """What an answer is checked for: numbers with one of units, citations between marks, phrases that say nothing was
    found, the number of contexts from which that is doubtful, and the length from which an answer must cite."""

    # Units, citation marks, phrases and limits of the checks.
    number: str = r"([\d,]+\.?\d*)\s*(元|万元|万|亿|折|%|％|天|个月|年|期|件|次|个|小时|分钟|公里|克|公斤|号)"
    citation: str = r"\[来源[:：]\s*([^\]]+)\]"
    not_found: tuple[str, ...] = ("未找到", "无法确定", "不存在该数据", "未在资料")
    enough: int = 3
    long: int = 80


# Units of numbers that a question must not give away; words between terms, and words that are none.
LEAK_NUMBER = r"([\d,]+\.?\d*)\s*(元|折|天|件|次|个|小时|分钟|公里|克|公斤|%|号)"
TERM_GAP = r"[\s，。！？；：、,.!?;:\d]+"
TERM_STOP = ("怎么", "如何", "什么", "多少", "为什么", "请问", "是否", "能不能", "可以", "需要", "应该", "如果", "但是", "然后", "还有", "或者", "怎么办", "哪些", "哪个", "几种", "是什么", "吗", "呢", "了", "的", "请")


def answer_issues(answer: Column, context: Column, sources: Column, n_contexts: Column, g: Grounding | None = None) -> Column:
    """array<struct<kind, value>>: what is wrong with an answer, in the order of the checks.

    number: a number with a unit that context doesn't hold, once for each time it is given; source: a cited source
    that isn't among sources; not_found: contexts are enough, and the answer says that nothing was found; uncited: a
    long answer without a citation though there are contexts, and it doesn't say so. Null texts are empty.
    """
    g = g or Grounding()
    a, c = F.coalesce(answer, F.lit("")), F.coalesce(context, F.lit(""))
    kind = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    one = lambda k, when, v=F.lit(""): F.when(when, F.array(kind(k, v))).otherwise(F.array().cast(ISSUES))
    pairs = F.arrays_zip(F.regexp_extract_all(a, F.lit(g.number), F.lit(1)).alias("n"), F.regexp_extract_all(a, F.lit(g.number), F.lit(2)).alias("u"))
    numbers = F.transform(F.filter(pairs, lambda p: ~F.contains(c, p["n"])), lambda p: kind("number", F.concat(p["n"], p["u"])))
    known = F.coalesce(F.transform(sources, lambda s: F.trim(s)), F.array().cast("array<string>"))

    def of(cited: Column) -> Column:
        foreign = F.transform(F.filter(cited, lambda s: (s != "") & ~F.array_contains(known, s)), lambda s: kind("source", s))
        says = any_of(a, g.not_found)
        return F.concat(numbers, foreign, one("not_found", says & (n_contexts >= g.enough)), one("uncited", (n_contexts > 0) & (F.length(a) > g.long) & (F.size(cited) == 0) & ~says))

    return let(F.transform(F.regexp_extract_all(a, F.lit(g.citation), F.lit(1)), lambda s: F.trim(s)), of)


def answer_terms(text: Column, gap: str = TERM_GAP, stop: tuple[str, ...] = TERM_STOP, script: str = "[一-鿿]", least: int = 2, most: int = 12) -> Column:
    """Distinct pieces between gaps, of least to most characters with one of script among them, that aren't stop words."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), gap, -1), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p).between(least, most) & F.rlike(p, F.lit(script)) & ~p.isin(*stop)))


def support(terms: Column, context: Column, most: float = 0.4) -> Column:
    """struct<supported, missing>: terms that context doesn't hold, and whether they are at most a share of all; no
    terms are supported."""
    missing = F.filter(terms, lambda t: ~F.contains(F.coalesce(context, F.lit("")), t))
    return let(missing, lambda m: F.struct((F.size(m) <= F.size(terms) * most).alias("supported"), m.alias("missing")))


def leaked_numbers(question: Column, answer: Column, number: str = LEAK_NUMBER) -> Column:
    """Numbers of the answer (with a unit) that the question gives away, commas and spaces aside, in order."""
    bare = F.regexp_replace(F.coalesce(question, F.lit("")), r"[,\s]", "")
    return F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(number), F.lit(1)), lambda n: F.contains(bare, F.regexp_replace(n, r"[,\s]", "")))
