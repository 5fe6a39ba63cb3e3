"""Quality rules whose cutoffs come with a guarantee: few good documents of any stratum are rejected.

Labelled documents are the holdout, each id and each text once. For each stratum and rule, cutoffs are tested from
the laxest to the strictest against the hypothesis that the rule rejects more than its share of good documents; the p-value is the
exact binomial tail. Testing stops at the first cutoff that isn't certified (fixed-sequence testing), and the
level is divided among strata and rules (Bonferroni), so that with probability 1 - delta no rule rejects more
than its share in any stratum, and all rules together no more than max_false_rejection, of the good documents that pass
the base.
DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, let, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: Labelled ids up to which their table is broadcast.
BROADCAST_LABELS = 500_000


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ratio is above the cutoff (or below it, if low). cutoffs: laxest first."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]
    low: bool = False

    def beyond(self, cutoff: Column) -> Column:
        ratio = F.col(self.numerator).cast("double") / F.col(self.denominator)
        hit = ratio < cutoff if self.low else ratio > cutoff
        return F.when(F.col(self.denominator) > 0, hit).otherwise(F.lit(False))


RULES = (
    Rule("symbols", "n_symbols", "n_words", (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.7, 0.5, 0.4, 0.3, 0.25, 0.2)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", "word_chars", "n_words", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    Rule("short_words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0), low=True),
)


@dataclass(frozen=True)
class Risk:
    """strata: values of the stratum column that have cutoffs of their own; all others, and null, form one more."""

    strata: tuple[str, ...] = ("en", "de", "fr", "es")
    max_false_rejection: float = 0.05
    delta: float = 0.05
    min_words: int = 50
    max_repeat_percent: int = 50


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    last = F.size(words) - 3
    at = lambda w, i: F.get(w, i)

    def exact(w: Column) -> Column:
        keyed = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", at(w, i), at(w, i + 1), at(w, i + 2)).alias("k"), i.alias("i"))))

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) & (j > 0) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
                lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["e"], p)).alias("n"), (p + 3).alias("e")),
            )["n"]

        return let(keyed, covered)

    # Windows without a repeated hash hold no repeated window: most texts end here.
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(words, i), at(words, i + 1), at(words, i + 2)))
    twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, F.lit(0)).when(~twice, F.lit(0)).otherwise(exact(words)).cast("long")


def measures(text: Column) -> Column:
    """struct<n_words,word_chars,n_symbols,n_dup_lines,n_lines,n_repeat_words> of a whole text (null: empty)."""

    def of(t: Column) -> Column:
        lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        return let(
            F.struct(words_of(t).alias("w"), lines.alias("l")),
            lambda x: F.struct(
                F.size(x["w"]).cast("long").alias("n_words"),
                F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                x["l"]["dup"].alias("n_dup_lines"),
                x["l"]["n"].alias("n_lines"),
                repeat_words(x["w"]).alias("n_repeat_words"),
            ),
        )

    return let(text_of(text), of)


def _log_factorial(n: Column) -> Column:
    """ln n!: exact to double precision (Stirling's series above 20)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), X binomial (n, p), summed down from k until terms are below double precision; 1 if k is above the mean."""
    q = 1 - p
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(q))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p * q)) + 80)

    def add(a: Column, i: Column) -> Column:
        j = k - i  # the term after that of j
        nxt = a["t"] * j * q / ((n - j + 1) * p)
        return F.struct((a["s"] + nxt).alias("s"), nxt.alias("t"))

    zero = F.struct(top.alias("s"), top.alias("t"))
    total = F.when(terms < 1, top).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), terms.cast("long") - 1), zero, add)["s"])
    return F.when((n <= 0) | (k > n * p), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def good_ids(labels: DataFrame, id_col: str) -> DataFrame:
    """id, q, t of every labelled id: the least quality and the highest toxicity that its labels give."""
    told = labels.filter(f"{id_col} is not null and quality is not null").groupBy(F.col(id_col).alias("id"))
    return told.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))


def trials(measured: DataFrame, told: DataFrame) -> DataFrame:
    """stratum, base_failed and measures of distinct good documents: one row for each labelled id, one for each text.

    Copies of a text, and rows that repeat an id, are no independent trials. Of an id's texts the one of the least
    hash counts; a text is good if all labels of its ids say quality 1 and none says toxic.
    measured: id, stratum, hash (of the text), base_failed, measures. told: good_ids().
    """
    row = F.struct("stratum", "base_failed", *MEASURES)
    one = measured.join(told, "id").groupBy("id").agg(F.min("hash").alias("hash"), F.min_by(row, F.struct("hash", "stratum")).alias("x"), F.first("q").alias("q"), F.first("t").alias("t"))
    return one.groupBy("hash").agg(F.min_by("x", "id").alias("x"), F.min("q").alias("q"), F.max("t").alias("t")).filter("q = 1 and t = 0").select("x.*")


def certify(held: DataFrame, risk: Risk, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stratum, rule, cutoff: the strictest certified cutoff; no row where none is. At most strata x rules rows.

    held: trials(). What the base rules reject takes no part: the guarantee is for good documents that pass them.
    """
    held = held.filter("not base_failed")
    counts = held.groupBy(stratum_of(F.col("stratum"), risk).alias("stratum")).agg(
        F.count("*").alias("n"), *[F.count_if(r.beyond(F.lit(c))).alias(f"k_{r.name}_{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    )
    tests = counts.select(
        "stratum",
        "n",
        F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"k_{r.name}_{i}").alias("k")) for r in rules for i, c in enumerate(r.cutoffs)])).alias("x"),
    ).select("stratum", "n", "x.*")
    level = risk.delta / ((len(risk.strata) + 1) * len(rules))
    tests = tests.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), risk.max_false_rejection / len(rules)) <= level)
    run = tests.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("i", "ok", "cutoff"))).alias("xs"))
    first_bad = F.coalesce(F.array_min(F.transform(F.filter("xs", lambda x: ~x["ok"]), lambda x: x["i"])), F.size("xs"))
    return run.withColumn("m", first_bad).filter("m > 0").select("stratum", "rule", F.get("xs", F.col("m") - 1)["cutoff"].alias("cutoff"))


def stratum_of(col: Column, risk: Risk) -> Column:
    """The stratum's own name if it is listed, else the empty one."""
    return F.when(col.isin(*risk.strata), col).otherwise(F.lit(""))


def verdict(certified: list, stratum: str, risk: Risk, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether no certified rule rejects. certified: collected rows of certify(), at most strata x rules of them."""
    s = stratum_of(F.col(stratum), risk)
    out = F.lit(True)
    for row in certified:
        rule = next(r for r in rules if r.name == row["rule"])
        out = out & ~((s == row["stratum"]) & rule.beyond(F.lit(row["cutoff"])))
    return out


def _measured(docs: DataFrame, text: str, risk: Risk) -> DataFrame:
    """docs with MEASURES and base_failed. A generator, unlike a projection, is never inlined and evaluated again."""
    m = docs.select("*", F.inline(F.array(measures(F.col(text)))))
    return m.withColumn("base_failed", (F.col("n_words") < risk.min_words) | (100 * F.col("n_repeat_words") > risk.max_repeat_percent * F.col("n_words")))


def _slim(docs: DataFrame, text: str, id_col: str, stratum: str, risk: Risk) -> DataFrame:
    """id, stratum, hash, base_failed and measures of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{text}`").alias("text"))
    return _measured(rows.withColumn("hash", F.xxhash64(text_of(F.col("text")))), "text", risk).drop("text")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", stratum: str = "lang", risk: Risk | None = None) -> DataFrame:
    """Measures and verdict of every document: id, stratum, the measures, base_failed, kept.

    Null text: no words, which fails the base. Null or repeated ids and repeated rows keep their rows (a null id
    has no label). Columns other than text, id and stratum are not read. An empty table gives no rows; without
    labels nothing is certified and the base alone decides.
    """
    risk = risk or Risk()
    m = cut(_slim(docs, text, id_col, stratum, risk))
    found = certify(trials(m, good_ids(labels, id_col)), risk).collect()  # at most strata x rules rows
    kept = ~F.col("base_failed") & verdict(found, "stratum", risk)
    return m.select(F.col("id").alias(id_col), F.col("stratum").alias(stratum), *MEASURES, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", stratum: str = "lang", risk: Risk | None = None) -> DataFrame:
    """docs without the rows that judge() rejects; all columns stay.

    Cutoffs need labelled documents only: these are measured first, then every document is measured and judged as it
    is written. Where labels are too many to be broadcast, all documents are measured first, as texts aren't shuffled.
    """
    risk = risk or Risk()
    told = cut(good_ids(labels, id_col))
    few = told.count() <= BROADCAST_LABELS
    labelled = docs.join(F.broadcast(told.select(F.col("id").alias("__labelled"))), F.col(f"`{id_col}`") == F.col("__labelled"), "left_semi") if few else docs
    found = certify(trials(cut(_slim(labelled, text, id_col, stratum, risk)), told), risk).collect()  # at most strata x rules rows
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    m = _measured(own, names[text], risk)
    return m.filter(~F.col("base_failed") & verdict(found, names[stratum], risk)).select(*[F.col(n).alias(c) for c, n in names.items()])
