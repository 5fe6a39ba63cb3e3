"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by weight, none above a multiple of its own size. Whole copies that the target
allows every document are certain. For the rest, each document has an inclusion probability of its own, in proportion
to its size, and certain for those whose share would exceed 1; documents of a source are ranked by their random odds
divided by their inclusion odds, and the first ones are taken until the source's remaining words are reached: a sample
of fixed size (in words) with unequal inclusion probabilities. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, keep, n_words_of, text_of

#: Sources up to which their table is broadcast; a row is about a hundred bytes.
BROADCAST_SOURCES = 20_000
#: Repeated rows (hashes of 32 characters) up to which their table is broadcast.
BROADCAST_TIES = 100_000
#: Ranks are 52-bit integers; their first 16 bits make the buckets in which a source's words are summed first.
RANK_BITS, BUCKET_BITS = 52, 16


@dataclass(frozen=True)
class Mix:
    """weights: repeated over the sources in code point order (null last); share: of all words, that the mix
    takes; cap: most times that a source, and a document, is taken; seed: of the random odds."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix-1"


def _key(source: Column) -> Column:
    """The source as a key that is never null: null and the empty string stay apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows (a table that is read from disk) with __i, from 1, within their group ([]: in the order of partitions).

    Rows are numbered within a partition and group, after those of the partitions before: a group is never in one task.
    """
    rows = rows.withColumn("__pid", F.spark_partition_id())
    per = cut(rows.groupBy(*group, "__pid").agg(F.count("*").alias("__n")))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(per, [*group, "__pid"])


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """skey, source_size, target, rate: the water level that reshares what capped sources leave.

    sizes: skey, source, size. Sources are numbered by partitions of their sorted table; the level is raised until no
    further source is full, by two sums over the sources a round.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    per = _numbered(cut(per.orderBy(F.col("source").asc_nulls_last())), [])
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__pid").orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.array(*[F.lit(float(x)) for x in mix.weights])
    per = cut(per.select("skey", "source_size", F.get(w, (number % len(mix.weights)).cast("int")).alias("w"), (mix.cap * F.col("source_size")).alias("most")))
    every = per.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        is_full = F.col("most") <= F.col("w") * level
        held, open_, now = per.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("w"))), F.count_if(is_full)).first()
        if not open_ or now == full:
            break
        level, full = (mix.share * every - (held or 0.0)) / open_, now
    target = F.least(F.col("most"), F.col("w") * level)
    return per.select("skey", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def scales(s: DataFrame, t: DataFrame) -> DataFrame:
    """skey, scale: a document of n words is included with the probability min(1, scale * n), its source's remainder being
    the expected words.

    s: skey, size; t: targets(). Size classes of a source are passed from the largest down until one isn't certain.
    """
    classes = s.filter("size > 0").groupBy("skey", "size").agg(F.count("*").cast("double").alias("n"))
    down = Window.partitionBy("skey").orderBy(F.desc("size"))
    c = classes.withColumns(
        {
            "above": F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "squares": F.sum(F.col("n") * F.col("size") * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    need = t.select("skey", (F.col("target") - F.floor("rate") * F.col("source_size")).alias("need"))
    c = c.join(need, "skey").withColumn("scale", F.greatest(F.col("need") - F.col("above"), F.lit(0.0)) / F.col("squares")).filter(F.col("scale") * F.col("size") < 1)
    return c.groupBy("skey").agg(F.max_by("scale", "size").alias("scale"))


def _ranked(df: DataFrame) -> DataFrame:
    """df with whole (copies that all documents of the source get), part (inclusion probability) and rank (52 bits, -1: certain; null if part is 0)."""
    u = (F.conv(F.substring("__hash", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << RANK_BITS)
    part = F.when((F.col("size") > 0) & (F.col("rate") > F.floor("rate")), F.least(F.col("scale") * F.col("size"), F.lit(1.0))).otherwise(F.lit(0.0))
    df = df.withColumns({"whole": F.floor("rate").cast("long"), "part": part})
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    rank = F.least(F.floor(odds / (1 + odds) * float(1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long")
    return df.withColumn("rank", F.when(F.col("part") >= 1, F.lit(-1).cast("long")).when(F.col("part") > 0, rank))


def sized(docs: DataFrame, text: str, id_col: str, source: str, mix: Mix) -> DataFrame:
    """docs with skey, size (words) and __hash, the document's random bits: of seed, source, id and text."""
    t = F.col(text)
    skey = _key(F.col(source))
    bits = F.md5(F.concat_ws("|", F.lit(mix.seed), F.md5(skey.cast("binary")), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(t).cast("binary"))).cast("binary"))
    return docs.withColumns({"skey": skey, "size": n_words_of(t), "__hash": bits})


def repeated(s: DataFrame) -> DataFrame:
    """__hash of rows that repeat source, id and text."""
    return cut(s.groupBy("__hash").agg(F.count("*").alias("n")).filter("n > 1").select("__hash"))


def apart(s: DataFrame, ties: DataFrame, stored) -> DataFrame:
    """s with another __hash for each of the rows that repeat one (ties), by their number: their odds differ.

    stored: from a table to the same, read from disk.
    """
    if ties.isEmpty():
        return s
    hint = F.broadcast if ties.count() <= BROADCAST_TIES else (lambda d: d)
    tied = _numbered(stored(s.join(hint(ties), "__hash", "left_semi")), ["__hash"])
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__hash", "__pid").orderBy("__before"))
    tied = tied.withColumn("__hash", F.md5(F.concat_ws("|", "__hash", number.cast("string")).cast("binary"))).select(*s.columns)
    return s.join(hint(ties), "__hash", "left_anti").select(*s.columns).unionByName(tied)


def plan(s: DataFrame, mix: Mix) -> DataFrame:
    """skey, source_size, target, rate, scale, last_rank, last_hash: all that a document's number of copies depends on.

    s: skey, source, size, __hash. Words are summed per source and bucket of ranks; only the bucket in which a
    source's remainder ends is ordered row by row: about a 65,536th of a source.
    """
    t = cut(targets(s, mix))
    t = cut(t.join(scales(s, t), "skey", "left").withColumn("scale", F.coalesce("scale", F.lit(0.0))))
    few = t.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda d: d)
    r = _ranked(s.join(hint(t), "skey")).filter("rank is not null").select("skey", "size", "rank", "__hash", F.shiftright("rank", RANK_BITS - BUCKET_BITS).alias("bucket"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    sums = r.groupBy("skey", "bucket").agg(F.sum("size").alias("n"), F.first("need").alias("need"))
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("upto", F.sum("n").over(upto)).filter("upto > need").groupBy("skey").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("c")).select("skey", F.col("c.bucket").alias("bucket"), F.col("c.before").alias("before"))
    at = cut(at)
    # Within the bucket: a document is in if the remainder reaches the middle of its words, which keeps the total nearest.
    inside = r.join(hint(at), ["skey", "bucket"])
    w = Window.partitionBy("skey").orderBy("rank", "__hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("mid", F.col("before") + F.sum("size").over(w) - F.col("size") / 2).filter("mid <= need")
    last = inside.groupBy("skey").agg(F.max(F.struct("rank", "__hash")).alias("l"))
    lows = at.select("skey", F.shiftleft(F.col("bucket"), RANK_BITS - BUCKET_BITS).alias("low"))
    out = t.join(lows, "skey", "left").join(last, "skey", "left")
    # No cut: every document with a part is in. A cut before the bucket's first document: only lower buckets are.
    return out.select(
        "skey", "source_size", "target", "rate", "scale",
        F.when(F.col("low").isNull(), F.lit(1 << RANK_BITS)).otherwise(F.coalesce("l.rank", F.col("low") - 1)).cast("long").alias("last_rank"),
        F.coalesce("l.__hash", F.lit("g")).alias("last_hash"),
    )


def with_copies(s: DataFrame, p: DataFrame) -> DataFrame:
    """s with source_size, target and copies."""
    few = p.count() <= BROADCAST_SOURCES
    r = _ranked(s.join(F.broadcast(p) if few else p, "skey"))
    taken = (F.col("rank") < F.col("last_rank")) | ((F.col("rank") == F.col("last_rank")) & (F.col("__hash") <= F.col("last_hash")))
    return r.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long")))


def mix_sources(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", mix: Mix | None = None) -> DataFrame:
    """id, size, source_size, target, copies, taken (words, repeats counted) of every document.

    Null text has size 0 and is never taken. Null sources form a source of their own. Rows that repeat source, id and
    text have odds of their own, by their number, so part of them may be taken. Columns other than text, id and source
    are not read. An empty table gives no rows. Reruns agree: the random odds are a hash of seed, source, id and text.
    """
    mix = mix or Mix()
    slim = docs.select(F.col(id_col), F.col(source).alias("source"), F.col(text).alias("__text"))
    s = cut(sized(slim, "__text", id_col, "source", mix).drop("__text"))
    ties = repeated(s)
    s = s if ties.isEmpty() else cut(apart(s, ties, cut))
    return with_copies(s, cut(plan(s, mix))).select(id_col, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", mix: Mix | None = None) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns stay."""
    mix = mix or Mix()
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    s = sized(own, names[text], names[id_col], names[source], mix)
    slim = cut(s.select("skey", F.col(names[source]).alias("source"), "size", "__hash"))
    ties = repeated(slim)
    p = cut(plan(slim if ties.isEmpty() else cut(apart(slim, ties, cut)), mix))
    out = with_copies(apart(s, ties, lambda d: keep(d, "ties")), p).filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
