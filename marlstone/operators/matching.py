"""Best matches of sets of words by Jaccard similarity, exact without joining on frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut

#: Words of items up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _best(pairs: DataFrame) -> DataFrame:
    """item, doc, score of each item's best pair; ties to the smaller doc."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return pairs.withColumn("n", F.row_number().over(w)).filter("n = 1").select("item", "doc", "score")


def _jaccard(common: Column) -> Column:
    return common / (F.col("n_item") + F.col("n_doc") - common)


def best_match(items: DataFrame, docs: DataFrame, words, share: float = 0.5) -> DataFrame:
    """item, doc, score: of each item (item, text) the doc (doc, text) whose set of words is most similar to its own, ties
    to the smaller doc; items that share no word with any have no row. words: of a text column, an array<string>.

    An item's words are looked up rarest first. The documents that hold one of the rarest `share` of them are scored: by the
    common words found so far they are bounded, and only those whose bound reaches the best one found are compared as
    a whole. A document without these words can share the others at most, so it can only be better if it is short
    enough; the frequent words are looked up in such documents alone. share changes the work, not the result.
    """
    w = cut(items.select("item", F.array_distinct(words(F.col("text"))).alias("ws")).select("item", F.size("ws").alias("n_item"), F.explode("ws").alias("w")))
    held = docs.select("doc", F.array_distinct(words(F.col("text"))).alias("ws")).select("doc", F.size("ws").alias("n_doc"), F.explode("ws").alias("w"))
    counts = cut(held.join(_hint(w.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df")))
    order = Window.partitionBy("item").orderBy("df", "w")
    # Words that no document holds come first: they cost nothing, and are never found.
    placed = cut(w.join(counts, "w", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("p", F.row_number().over(order)))
    early = F.col("p") <= F.ceil(F.col("n_item") * share)
    rare, rest = placed.filter(early), placed.filter(~early)
    near = held.join(_hint(rare.select("item", "n_item", "w")), "w").groupBy("item", "n_item", "doc", "n_doc").agg(F.count("*").alias("c"))
    near = cut(near)
    left = F.col("n_item") - F.ceil(F.col("n_item") * share)
    least = near.groupBy("item").agg(F.max(_jaccard(F.col("c"))).alias("least"))
    most = F.least(F.col("c") + left, F.col("n_doc").cast("long"), F.col("n_item").cast("long"))
    kept = near.join(least, "item").filter(_jaccard(most) >= F.col("least")).select("item", "n_item", "doc", "n_doc", "c")
    kept = cut(kept)
    # The frequent words of the pairs that are left, from their documents alone.
    texts = docs.join(_hint(kept.select("doc").distinct()), "doc", "left_semi").select("doc", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    more = texts.join(_hint(rest.select("w").distinct()), "w", "left_semi").join(kept.select("item", "doc"), "doc").join(rest.select("item", "w"), ["item", "w"]).groupBy("item", "doc").agg(F.count("*").alias("more"))
    scored = kept.join(more, ["item", "doc"], "left").select("item", "doc", _jaccard(F.col("c") + F.coalesce("more", F.lit(0))).alias("score"))
    best = cut(_best(scored))
    # Without a rare word a document shares `left` words at most: (left) / (n_item + n_doc - left) must reach the best.
    open_ = rest.join(best.select("item", "score"), "item", "left")
    room = F.when(F.col("score").isNotNull(), left / F.col("score") + left - F.col("n_item") + 1e-6)
    open_ = cut(open_.select("item", "n_item", "w", room.alias("room")))
    far = held.join(_hint(open_), "w").filter(F.col("room").isNull() | (F.col("n_doc") <= F.col("room")))
    far = far.groupBy("item", "n_item", "doc", "n_doc").agg(F.count("*").alias("c"))
    # A pair found both ways is scored by all its words in the first.
    return _best(best.unionByName(far.join(near.select("item", "doc"), ["item", "doc"], "left_anti").select("item", "doc", _jaccard(F.col("c")).alias("score"))))
