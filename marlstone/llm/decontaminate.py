"""Benchmark decontamination over a distributed positional inverted index.

The index holds a posting (term, row, place) of every token of the training documents that some test item uses, written
by the tasks that read the documents: each file is the inverted index of its own documents, ordered by term. Items are
looked up by intersecting lists: a posting at place p of the word at place i of an item speaks for the alignment
p - i. The lists of the rarest two words of every window are intersected first; only alignments that both speak for
are looked up with all words of the item. A run of words at one alignment is an exact phrase; words whose alignments
differ by at most `slack` are a match in proximity.

Words: A-Z lower-cased, then maximal runs of other than the ASCII characters that are no letters or digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, keep, text_of

#: What lies between words, before A-Z are lower-cased.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Term of the entries that tell a document: its id and number of words in place of a posting.
DOCUMENT = -1


@dataclass(frozen=True)
class Match:
    """size: words of a window; slack: places that the words of a match in proximity may be off its alignment.

    span: places that alignments are compared in at first (changes the work, not the result); broadcast_rows: rows up
    to which terms, words looked up first, and rows with an alignment are broadcast.
    """

    size: int = 10
    slack: int = 3
    span: int = 64
    broadcast_rows: int = 500_000


def _words(text: Column) -> Column:
    """An empty string, then the words of a text, then another empty string if it ends in a gap."""
    return F.split(F.concat(F.lit(" "), text_of(text)), GAP, -1)


def _lowered(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _hint(df: DataFrame, most: int) -> DataFrame:
    """df, broadcast if it has at most so many rows, which are counted."""
    return F.broadcast(df) if df.count() <= most else df


def item_words(items: DataFrame, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """item (a number of its own for each row), item_id (as string), i (from 1), word, m (words of the item), written once."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"), _words(F.col(text)).alias("ws"))
    m = F.size("ws") - 1 - (F.element_at("ws", -1) == "").cast("int")
    words = rows.select("item", "item_id", m.alias("m"), F.posexplode("ws").alias("i", "w")).filter("w <> ''")
    return keep(words.select("item", "item_id", "i", _lowered(F.col("w")).alias("word"), "m"), "items")


def dictionary(words: DataFrame) -> DataFrame:
    """word, term: a number from 0 up for each word, written once."""
    return keep(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")


def build_index(docs: DataFrame, terms: DataFrame, match: Match | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The positional index of docs over terms (word, term), written in the shared folder: term, row, place, doc_id.

    row tells the document's row; entries of term DOCUMENT hold its doc_id and, as place, its number of words. One pass
    over the texts and no shuffle: every file is ordered by term, row and place.
    """
    most = (match or Match()).broadcast_rows
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text)).alias("ws"))
    n = F.size("ws") - 1 - (F.element_at("ws", -1) == "").cast("int")
    tokens = own.select("row", "doc_id", n.alias("n"), F.posexplode("ws").alias("place", "w"))
    tokens = tokens.select("row", "doc_id", "n", "place", _lowered(F.col("w")).alias("word"))
    first = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(DOCUMENT).cast("long").alias("term"))
    found = tokens.join(_hint(terms.select("word", "term").unionByName(first), most), "word").filter(f"term <> {DOCUMENT} or place = 0")
    entry = F.col("term") == DOCUMENT
    return keep(found.select("term", "row", F.when(entry, F.col("n")).otherwise(F.col("place")).alias("place"), F.when(entry, F.col("doc_id")).alias("doc_id")).sortWithinPartitions("term", "row", "place"), "postings")


def _rarest(words: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """item, i, term, one of the places of words (item, i, term, m) that are looked up first: of each window of an
    item its two words with the fewest postings."""
    w = words.join(counts, "term", "left").select("item", "i", "term", "m", F.coalesce("count", F.lit(0)).alias("count"))
    m = F.least(F.col("m"), F.lit(size))
    starts = F.sequence(F.greatest(F.col("i") - m + 1, F.lit(1)), F.least(F.col("i"), F.col("m") - m + 1))
    order = Window.partitionBy("item", "start").orderBy("count", "i")
    top = w.select("*", F.explode(starts).alias("start")).withColumn("n", F.row_number().over(order)).filter("n <= 2")
    return top.select("item", "i", "term", (F.col("m") == 1).alias("one")).distinct()


def alignments(index: DataFrame, words: DataFrame, match: Match) -> DataFrame:
    """item, row, band: bands of `span` alignments of an item in a document that two of its rarest words speak for.

    A match in proximity with alignments from a to a + slack is told by the band of a; words near the end of a band
    speak for the next one too.
    """
    counts = index.filter(f"term <> {DOCUMENT}").groupBy("term").count()
    rare = cut(_rarest(words.select("item", "i", "term", "m"), counts, match.size))
    at = index.filter(f"term <> {DOCUMENT}").join(_hint(rare, match.broadcast_rows), "term").select("item", "row", "i", "one", (F.col("place") - F.col("i")).alias("off"))
    bands = F.array_distinct(F.array(F.floor((F.col("off") - match.slack) / match.span), F.floor(F.col("off") / match.span)))
    near = at.select("item", "row", "i", "one", F.explode(bands).alias("band")).groupBy("item", "row", "band")
    return near.agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("one").alias("one")).filter("one or lo < hi").select("item", "row", "band")


def occurrences(index: DataFrame, words: DataFrame, match: Match) -> DataFrame:
    """item, item_id, row, begin, end, exact: runs of an item's words in a document that hold a window, as places.

    exact: the words follow each other in the document; otherwise each is at most `slack` places behind the alignment
    that the run begins with. An exact run is given as one in proximity too.
    """
    found = cut(alignments(index, words, match))
    wanted = found.join(words.select("item", "item_id", "i", "term", "m"), "item")
    low = F.col("band") * match.span + F.col("i")
    blocks = F.sequence(F.floor(low / match.span), F.floor((low + match.span + match.slack) / match.span))
    wanted = wanted.select("item", "row", "band", "i", "term", "m", F.explode(blocks).alias("block"))
    rows = _hint(found.select("row").distinct(), match.broadcast_rows)
    lists = index.filter(f"term <> {DOCUMENT}").join(rows, "row", "left_semi").select("row", "term", "place", F.floor(F.col("place") / match.span).alias("block"))
    off = F.col("place") - F.col("i")
    hits = lists.join(wanted, ["row", "term", "block"]).withColumn("off", off).filter((F.col("off") >= F.col("band") * match.span) & (F.col("off") < (F.col("band") + 1) * match.span + match.slack))
    # A word speaks for the alignments up to `slack` before its own; the bands of a match don't overlap.
    starts = F.sequence(F.greatest(F.col("off") - match.slack, F.col("band") * match.span), F.least(F.col("off"), (F.col("band") + 1) * match.span - 1))
    at = hits.select("item", "row", "m", "i", "off", F.explode(starts).alias("start"))
    at = at.groupBy("item", "row", "m", "start", "i").agg(F.max(F.col("off") == F.col("start")).alias("same"), F.max("off").alias("last"))
    both = at.select("item", "row", "m", "start", "i", (F.col("start") + F.col("i")).alias("from"), (F.col("last") + F.col("i")).alias("to"), F.explode(F.when(F.col("same"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("exact"))
    order = Window.partitionBy("item", "row", "start", "exact").orderBy("i")
    runs = both.withColumn("run", F.col("i") - F.row_number().over(order)).groupBy("item", "row", "m", "start", "exact", "run")
    runs = runs.agg(F.count("*").alias("n"), F.min("from").alias("begin"), F.max(F.when(F.col("exact"), F.col("from")).otherwise(F.col("to"))).alias("end")).filter((F.col("n") >= F.least(F.col("m"), F.lit(match.size))) & (F.col("n") > 0))
    return runs.join(words.select("item", "item_id").distinct(), "item").select("item", "item_id", "row", "begin", "end", "exact")


def decontaminate(docs: DataFrame, items: DataFrame, match: Match | None = None, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, items, near_items, spans of every row of docs.

    n_hit: words in exact occurrences of windows, each once. items, near_items: sorted ids, as strings, of the items with a
    window that occurs exactly, and in proximity (exact ones included). spans: begin and end (words, from 1, inclusive)
    of the merged exact occurrences. An item with fewer words than a window, but not none, is one window. Null and
    wordless texts are hit by nothing; repeated rows get a row each; items that repeat an id count once, items without an id
    hit but aren't listed. Other columns are not read. Empty tables give no rows, and no hits.
    """
    m = match or Match()
    words = item_words(items, item_text, item_id)
    terms = dictionary(words)
    index = build_index(docs, terms, m, text, id_col)
    words = cut(words.join(terms, "word").select("item", "item_id", "i", "term", "m"))
    runs = cut(occurrences(index, words, m))
    # Overlapping exact runs of a row are merged: what begins behind all that came before opens a new one.
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = runs.filter("exact").select("row", "begin", "end").distinct()
    opens = F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)).cast("int")
    isle = each.withColumn("opens", opens).withColumn("isle", F.sum("opens").over(Window.partitionBy("row").orderBy("begin", "end")))
    isle = isle.groupBy("row", "isle").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    hit = isle.groupBy("row").agg(F.sum(F.col("end") - F.col("begin") + 1).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    # One row for each item and document first: lists hold as many ids as there are items, at most.
    named = runs.filter("item_id is not null").groupBy("row", "item_id").agg(F.max("exact").alias("exact")).groupBy("row")
    named = named.agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"), F.array_sort(F.collect_list("item_id")).alias("near_items"))
    told = index.filter(f"term = {DOCUMENT}").select("row", "doc_id", F.col("place").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = told.join(hit, "row", "left").join(named, "row", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
    )
