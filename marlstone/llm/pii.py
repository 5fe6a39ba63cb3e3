"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Seeds (base matches) induce lexical patterns, the words around them. A bipartite graph of patterns and
instances is scored over a few rounds, and patterns of high confidence discover identifiers of the same loose
kind that no base pattern matches. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import WS, cut, keep, let, spans_of, text_of, words_of

KINDS = ("email", "ip", "card", "phone")
# Possessive quantifiers and boundaries that change no match: every text is scanned in linear time, without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Loose kinds, which only a trusted context turns into personal data.
LOOSE_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+"
LOOSE_IP = r"(?:\G|(?<![0-9A-Fa-f:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++(?![0-9A-Za-z])"


#: Patterns up to which their table is broadcast; a pattern is a few dozen bytes.
BROADCAST_PATTERNS = 100_000


@dataclass(frozen=True)
class Bootstrap:
    """Parameters of the bootstrap.

    rounds: of scoring; min_confidence: of a pattern, the expected share of its slots that hold an instance of
    its kind; min_support: distinct instances that a pattern needs, so that one identifier can't make a pattern.
    """

    rounds: int = 3
    min_confidence: float = 0.5
    min_support: int = 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _kind(spans: Column, kind: str, ok=None) -> Column:
    kept = spans if ok is None else F.filter(spans, lambda x: ok(x["m"]))
    return F.transform(kept, lambda x: F.struct(x["s"], F.lit(KINDS.index(kind)).alias("k"), x["e"], F.lit(kind).alias("kind"), x["m"]))


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: array<struct<s,k,e,kind,m>> of the base matches that pass their checks."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def card_ok(m: Column) -> Column:
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))

    return {
        "email": _kind(F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL)).otherwise(none), "email"),
        "ip": _kind(spans_of(text, IP), "ip", lambda m: F.rlike(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        "card": _kind(spans_of(text, CARD), "card", card_ok),
        "phone": _kind(F.when(F.contains(text, F.lit("+")), spans_of(text, PHONE)).otherwise(none), "phone", lambda m: F.length(_digits(m)).between(9, 15)),
    }


def loose_spans(text: Column) -> Column:
    """Candidates: loosely typed identifiers as array<struct<s,e,m,loose>>."""

    def typed(spans: Column, loose: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["m"], F.lit(loose).alias("loose")))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    mail = F.when(F.rlike(text, F.lit(r"@|[\[(]at[\])]")), spans_of(text, LOOSE_EMAIL)).otherwise(none)
    return F.concat(
        typed(mail, "email"),
        typed(F.when(F.rlike(text, F.lit("[0-9A-Fa-f]:[0-9A-Fa-f:]")), spans_of(text, LOOSE_IP)).otherwise(none), "ip"),
        typed(F.filter(spans_of(text, LOOSE_NUMBER), lambda x: F.length(_digits(x["m"])).between(7, 19)), "number"),
    )


def _slot(text: Column, s: Column, e: Column) -> Column:
    """Lexical patterns around a span: the word before it, the two words before it, the word behind it.

    Only the 200 characters next to the span are looked at: no pattern is longer.
    """
    left = F.lower(F.substring(text, F.greatest(s - 199, F.lit(1)), F.least(s, F.lit(200))))
    right = F.lower(F.substring(text, e + 1, F.lit(200)))
    l1 = F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    l2 = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    r1 = F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    two = F.regexp_replace(l2, WS + "+", " ")
    made = F.array(F.concat(F.lit("L "), l1), F.concat(F.lit("LL "), two), F.concat(F.lit("R "), r1))
    return F.filter(made, lambda p: ~F.rlike(p, F.lit("^(?:L|LL|R) $|[0-9@]")))


def none_type() -> str:
    return "array<struct<s:int,k:int,e:int,kind:string,m:string>>"


def scan(df: DataFrame, text: str) -> DataFrame:
    """df with the columns email, ip, card, phone (base spans) and loose (candidates with patterns), texts read once."""
    t = text_of(F.col(text))
    numeric = F.rlike(t, F.lit("[0-9]"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,m:string>>")
    base = base_spans(t)
    out = df.withColumns({f"__{k}": (F.when(numeric, c).otherwise(empty) if k != "email" else c) for k, c in base.items()})
    all_base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    free = F.filter(loose_spans(t), lambda x: ~F.exists(all_base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    out = out.withColumn("__loose", F.when(numeric | F.rlike(t, F.lit(r"@|[\[(]at[\])]|:")), free).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,loose:string>>")))
    loosely = F.create_map(*[F.lit(x) for x in ("email", "email", "ip", "ip", "card", "number", "phone", "number")])
    occ = F.concat(
        F.transform(all_base, lambda b: F.struct(b["s"], b["e"], b["m"], loosely[b["kind"]].alias("loose"), b["kind"].alias("seed"), _slot(t, b["s"], b["e"]).alias("ps"))),
        F.transform("__loose", lambda b: F.struct(b["s"], b["e"], b["m"], b["loose"], F.lit(None).cast("string").alias("seed"), _slot(t, b["s"], b["e"]).alias("ps"))),
    )
    out = out.withColumn("__occ", F.when(F.size(all_base) + F.size("__loose") > 0, occ))
    return out


def _slots(texts: Column, docs: DataFrame, live: DataFrame) -> DataFrame:
    """p, slots: how often the words of each live pattern occur in all texts."""
    # Counted first: a small set of patterns is broadcast, a larger one is joined by a shuffle.
    small = live.select("p").distinct()
    hint = F.broadcast if small.count() <= BROADCAST_PATTERNS else (lambda d: d)
    one = small.filter("p not like 'LL %'").select(F.regexp_replace("p", "^(L|R) ", "").alias("w")).distinct().withColumn("hit1", F.lit(True))
    two = small.filter("p like 'LL %'").select(F.substring("p", F.lit(4), F.length("p")).alias("pair"))
    two = two.select(F.substring_index("pair", " ", 1).alias("v"), F.substring_index("pair", " ", -1).alias("w"), F.lit(True).alias("hit2"))
    words = words_of(F.lower(texts))
    before = lambda w: F.concat(F.array(F.lit("")), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
    pairs = let(words, lambda w: F.zip_with(w, before(w), lambda x, v: F.struct(x.alias("w"), F.coalesce(v, F.lit("")).alias("v"))))
    # Of a text without words, before() is one longer than the words: that row has no word.
    seen = docs.select(F.inline(pairs)).filter("w is not null")
    seen = seen.join(hint(one), "w", "left").join(hint(two), ["v", "w"], "left").filter("hit1 or hit2")
    word = F.when(F.col("hit1"), F.col("w"))
    counted = seen.groupBy(word.alias("w1"), F.when(F.col("hit2"), F.concat_ws(" ", "v", "w")).alias("w2")).agg(F.count("*").alias("n"))
    return (
        counted.select(F.explode(F.array(F.concat(F.lit("L "), "w1"), F.concat(F.lit("R "), "w1"), F.concat(F.lit("LL "), "w2"))).alias("p"), "n")
        .filter("p is not null")
        .groupBy("p")
        .agg(F.sum("n").alias("slots"))
    )


def discover(scanned: DataFrame, docs: DataFrame, text: str, p: Bootstrap) -> DataFrame:
    """Occurrences that trusted patterns turn into personal data: __rid, __found array<struct<s,k,e,kind,m>>."""
    rid = "__rid"
    occ = cut(scanned.filter("__occ is not null").select(rid, F.explode("__occ").alias("o")).select(rid, "o.*"))
    edges = cut(occ.select(F.explode("ps").alias("p"), "loose", "m", "seed").groupBy("p", "loose", "m").agg(F.max("seed").alias("seed")))
    # Patterns that seeds and candidates share are all that can discover anything.
    live = cut(
        edges.groupBy("p", "loose")
        .agg(F.count_if(F.col("seed").isNotNull()).alias("n_seed"), F.count_if(F.col("seed").isNull()).alias("n_new"))
        .filter((F.col("n_seed") >= p.min_support) & (F.col("n_new") > 0))
        .select("p", "loose")
    )
    none = docs.sparkSession.createDataFrame([], f"{rid} long, __found {none_type()}")
    if live.isEmpty():
        return none
    filled = occ.select(F.explode("ps").alias("p"), "loose").groupBy("p", "loose").agg(F.count("*").alias("n_filled"))
    slots = _slots(text_of(F.col(text)), docs, live)
    live = cut(live.join(filled, ["p", "loose"]).join(slots, "p", "left").withColumn("slots", F.coalesce("slots", F.lit(0))))
    inst = edges.groupBy("m", "loose").agg(F.max("seed").alias("seed")).select("m", "loose", F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    linked = edges.join(live.select("p", "loose"), ["p", "loose"], "left_semi")
    linked = cut(linked)
    inst = cut(inst.join(linked.select("m", "loose").distinct(), ["m", "loose"], "left_semi"))
    conf = None
    for _ in range(p.rounds):
        # Share of a pattern's distinct instances that are believed, times the share of its slots that are filled.
        conf = (
            linked.join(inst, ["m", "loose"])
            .groupBy("p", "loose")
            .agg(F.avg("score").alias("believed"))
            .join(live, ["p", "loose"])
            .select("p", "loose", (F.col("believed") * F.least(F.lit(1.0), F.col("n_filled") / F.greatest("slots", "n_filled"))).alias("conf"))
        )
        conf = cut(conf)
        inst = cut(
            linked.join(conf, ["p", "loose"])
            .groupBy("m", "loose")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.999)))))).alias("by_context"), F.max(F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)).alias("is_seed"))
            .select("m", "loose", F.greatest("by_context", "is_seed").alias("score"))
        )
    # A candidate takes the kind of most seeds of its trusted patterns.
    kinds = linked.filter("seed is not null").groupBy("p", "loose", "seed").agg(F.count("*").alias("n")).groupBy("p", "loose").agg(F.max_by("seed", F.struct("n", "seed")).alias("kind"))
    trusted = conf.filter(F.col("conf") >= p.min_confidence).join(kinds, ["p", "loose"])
    hits = (
        occ.filter("seed is null")
        .select(rid, "s", "e", "m", "loose", F.explode("ps").alias("p"))
        .join(trusted, ["p", "loose"])
        .groupBy(rid, "s", "e", "m")
        .agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    )
    k = F.create_map(*[F.lit(x) for i, name in enumerate(KINDS) for x in (name, i)])
    return hits.groupBy(rid).agg(F.collect_list(F.struct("s", k[F.col("kind")].alias("k"), "e", "kind", "m")).alias("__found"))


def find_pii(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), bootstrap: Bootstrap | None = None) -> DataFrame:
    """Personal data of every whole text: carry columns, the base spans email, ip, card, phone, and found (by context).

    Each is an array<struct<s,k,e,kind,m>>: start and end (exclusive) in code points, kind, match.
    Null text: empty, without spans. Rows are told apart by a row number of their own, so null or repeated ids and
    repeated rows each keep their row. Found spans never overlap base spans. Columns other than text and carry are
    not read. An empty table gives no rows.
    """
    p = bootstrap or Bootstrap()
    src = docs.select(*[F.col(c) for c in carry], F.col(text).alias("__text"))
    s = scan(src, "__text").withColumn("__rid", F.monotonically_increasing_id())
    s = cut(s.select("__rid", *carry, *[f"__{k}" for k in KINDS], "__occ"))
    found = discover(s, docs, text, p)
    none = F.array().cast(none_type())
    held = s.filter("__occ is not null").drop("__occ").join(found, "__rid", "left")
    rest = s.filter("__occ is null").drop("__occ").withColumn("__found", F.lit(None).cast(none_type()))
    return held.unionByName(rest).select(*carry, *[F.col(f"__{k}").alias(k) for k in KINDS], F.array_sort(F.coalesce("__found", none)).alias("found"))


def mask_pii(docs: DataFrame, text: str = "text", bootstrap: Bootstrap | None = None) -> DataFrame:
    """docs with every span of personal data in text replaced by <KIND>, and nothing else changed.

    Rows without a span pass as they are; a null text stays null. Columns keep their order and types.
    Overlapping spans are masked once, from the first start to the last end, as the kind that starts first.
    """
    p = bootstrap or Bootstrap()
    cols = docs.columns
    s = keep(scan(docs, text).withColumn("__rid", F.monotonically_increasing_id()), "pii")
    found = discover(s, s, text, p)
    none = F.array().cast(none_type())
    plain = s.filter("__occ is null").select(*cols)
    held = s.filter("__occ is not null").join(found, "__rid", "left")
    spans = F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS], F.coalesce("__found", none)))
    return plain.unionByName(held.withColumn(text, masked(F.col(text), spans)).select(*cols))


def masked(text: Column, spans: Column) -> Column:
    """text with each span of the sorted array replaced by <KIND>."""
    piece = "struct<at:int,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        return F.when(x["e"] <= a["at"], a).otherwise(
            F.struct(
                F.greatest(a["at"], x["e"]).alias("at"),
                F.when(x["s"] < a["at"], a["out"])
                .otherwise(F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))))
                .alias("out"),
            ).cast(piece)
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(piece)
    return let(F.aggregate(spans, zero, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
