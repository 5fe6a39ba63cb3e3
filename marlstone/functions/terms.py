"""What a question asks about: strong signals (names, risk classes, spans and numbers) and terms, as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import let


@dataclass(frozen=True)
class Vocabulary:
    """names: of products and their aliases; core: terms that count wherever they stand; stop: words that cut a run of
    script into pieces, longest first; risk, span, latin: patterns; trimmed: characters taken off the ends of pieces of
    at most `longest` characters."""

    names: tuple[str, ...] = ()
    # Core terms, stop words and patterns.
    core: tuple[str, ...] = (
        "存款保险", "非存款", "不受存款保险", "保本", "保收益", "业绩比较基准", "七日年化", "万份收益", "赎回", "申购", "冷静期", "犹豫期", "双录",
        "适当性", "风险等级", "风险承受", "起购", "到账", "确认", "费率", "管理费", "托管费", "销售服务费", "大额存单", "结构性存款", "定期",
        "活期", "封闭期", "开放日", "提前支取", "违约", "征信", "退保", "养老金", "增额终身寿", "代销", "自营", "净值", "T+0", "T+1",
    )
    stop: tuple[str, ...] = (
        "是多少", "有多少", "怎么样", "什么样", "为什么", "是什么", "有没有", "大概", "大约", "请问", "能不能", "分别", "时候", "哪些", "哪个",
        "多少", "什么", "怎么", "如何", "是否", "哪里", "哪种", "是", "的", "了", "吗", "呢", "在", "与", "及", "和", "或", "对", "为", "从", "到", "就", "请",
        "介绍", "了解", "情况", "相关", "主要", "一下", "那", "这个", "那个", "进行", "其中", "以及", "属于", "位于", "期", "公司", "今年", "去年", "本期",
    )
    risk: str = "R[1-5]|低风险|中低风险|中风险|中高风险|高风险"
    span: str = r"\d+(?:\.\d+)?\s*(?:天|个月|年|年化|万元|元|%)?"
    latin: str = r"[A-Za-z][A-Za-z0-9&.\- ]{1,}"
    script: str = "[一-鿿]"
    trimmed: str = "？?。！!；;：:、，, "
    longest: int = 8

    def cuts(self) -> str:
        """Pattern of what pieces end at: digits, and stop words with the longest first."""
        return "|".join([r"\d+", *map(re.escape, sorted(self.stop, key=lambda w: (-len(w), w)))])


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _trimmed(piece: Column, chars: str) -> Column:
    return F.btrim(F.regexp_replace(piece, r"^\s+|\s+$", ""), F.lit(chars))


def strong_signals(text: Column, v: Vocabulary) -> Column:
    """Sorted names that stand in text (none inside a longer one that does), risk classes, and numbers with their units."""
    t = F.coalesce(text, F.lit(""))
    held = F.filter(F.array(*[F.lit(n) for n in v.names]).cast("array<string>"), lambda n: F.contains(t, n))
    names = let(held, lambda h: F.filter(h, lambda n: ~F.exists(h, lambda o: (o != n) & F.contains(o, n))))
    spans = F.filter(F.transform(_all(t, v.span), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_sort(F.array_distinct(F.concat(names, _all(t, v.risk), spans)))


def terms(text: Column, v: Vocabulary) -> Column:
    """Sorted core terms that stand in text, Latin words and phrases in lower case, and pieces of script between stop
    words and digits, of two characters at least."""
    t = F.coalesce(text, F.lit(""))
    core = F.filter(F.array(*[F.lit(c) for c in v.core]).cast("array<string>"), lambda c: F.contains(t, c))
    latin = F.filter(F.transform(_all(t, v.latin), lambda s: F.lower(F.trim(s))), lambda s: F.length(s) >= 2)
    pieces = F.transform(F.split(t, v.cuts(), -1), lambda p: _trimmed(p, v.trimmed))
    pieces = F.filter(pieces, lambda p: F.length(p).between(2, v.longest) & F.rlike(p, F.lit(v.script)))
    return F.array_sort(F.array_distinct(F.concat(core, latin, pieces)))


def asked(text: Column, v: Vocabulary) -> Column:
    """struct<strong, terms>: all that the lexical rerank looks for; what is both counts twice there."""
    return F.struct(strong_signals(text, v).alias("strong"), terms(text, v).alias("terms"))
