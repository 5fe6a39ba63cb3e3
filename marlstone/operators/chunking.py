"""Section-aware parent and child chunks of documents.

Headings, offsets and windows are DataFrame functions; the packing of sentences is a fold. Nothing leaves the row
of its document until it is exploded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import let, short_hash
from marlstone.operators.ordering import numbered
from marlstone.session import ship

# What headings look like, by level, and what is none.
HEADING_LEVELS = (
    ("^(?:第[一二三四五六七八九十百千零\\d]+[章节篇]|[一二三四五六七八九十百千]+[、．]|# )", 1),
    ("^(?:\\d+\\.\\d+(?:\\.\\d+)?\\s|（[一二三四五六七八九十]+）|## )", 2),
    ("^(?:\\(\\d+\\)|### )", 3),
)
NO_HEADING = "[。，；！？…]|^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|^\\d+$|^第\\d+页$"
SENTENCE_END = "(?<=[。！？；\\n])"
LATIN_SENTENCE_END = "(?<=[.!?\\n])"
SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")


def windows(docs: DataFrame, size: int = 350, overlap: int = 70, least: int = 30, keep_short: bool = False, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n, start, content: plain windows; a window ends the text when it reaches it. Short ones go, unless kept."""
    step = size - overlap
    t = F.coalesce(F.col(text), F.lit(""))
    last = F.greatest(F.ceil((F.length(t) - overlap) / step) - 1, F.lit(0)).cast("int")
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    out = docs.select(F.col(doc), F.posexplode(F.transform(starts, lambda i: F.struct((i * step).alias("start"), F.substring(t, i * step + 1, F.lit(size)).alias("content")))).alias("n", "c")).select(doc, "n", "c.start", "c.content")
    return out if keep_short else out.filter(F.length(F.trim("content")) >= least)


def _packed(pieces: list[str], sep: str, size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces joined by sep: as long as size allows, each beginning with at most overlap characters of the last."""
    ends = np.concatenate([[0], np.cumsum([len(p) + len(sep) for p in pieces])])
    width = lambda a, b: int(ends[b] - ends[a]) - len(sep)
    a = 0
    for b in range(len(pieces)):
        if b > a and width(a, b + 1) > size:
            yield sep.join(pieces[a:b])
            while a < b and (width(a, b) > overlap or width(a, b + 1) > size):
                a += 1
    if a < len(pieces):
        yield sep.join(pieces[a:])


def split_text(text: str, size: int = 350, overlap: int = 70, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped pieces of one text: cut at the first separator that occurs in it; parts of size and more at the next ones."""
    at = next((i for i, x in enumerate(separators) if x in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for part in filter(None, text.split(sep) if sep else text):
        if len(part) < size:
            short.append(part)
            continue
        out += _packed(short, sep, size, overlap)
        short = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    out += _packed(short, sep, size, overlap)
    return [x for x in map(str.strip, out) if x]


def recursive_chunks(chunks: DataFrame, size: int = 350, overlap: int = 70, least: int = 30, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """chunk_id, source, page, content: chunks (chunk_id string, source, page, content) cut anew at separators, coarse ones first.

    Pieces are numbered within their chunk before short ones go. A null source is empty, a null page 0; null and blank
    contents give nothing.
    """
    ship(chunks.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(f"{c}_{i:02d}", s, p, x) for c, s, p, t in f.itertuples(index=False) for i, x in enumerate(split_text(t, size, overlap, separators)) if len(x) >= least]
            yield pd.DataFrame(rows, columns=["chunk_id", "source", "page", "content"])

    whole = chunks.select("chunk_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), F.coalesce("content", F.lit("")).alias("content"))
    return whole.mapInPandas(cut, "chunk_id string, source string, page int, content string")


def headings(docs: DataFrame, doc: str = "doc_id", text: str = "text", levels=HEADING_LEVELS, excluded: str = NO_HEADING) -> DataFrame:
    """doc, start, level, title of every heading line; a title repeated within 200 characters of the last kept heading goes."""
    lines = docs.select(F.col(doc), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "line"))
    w = Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).withColumn("title", F.trim("line"))
    level = None
    for pattern, n in levels:
        hit = F.rlike("title", F.lit(pattern)) & ((F.length("title") <= 20) if n >= 2 else F.lit(True))
        level = F.when(hit, n) if level is None else level.when(hit, n)
    found = lines.withColumn("level", level).filter("level is not null and length(title) between 2 and 120").filter(~F.rlike("title", F.lit(excluded)))
    # Compared with the last kept heading, in order: a fold over the headings of a document.
    head = "struct<start:bigint,level:int,title:string>"
    hs = found.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "level", "title"))).cast(f"array<{head}>").alias("hs"))

    def keep(acc: Column, h: Column) -> Column:
        seen = F.exists(acc, lambda k: (k["title"] == h["title"]) & (k["level"] == h["level"]))
        near = F.size(acc).cast("boolean") & (F.abs(h["start"] - F.try_element_at(acc, F.lit(-1))["start"]) < 200)
        return F.when(seen & near, acc).otherwise(F.concat(acc, F.array(h)))

    return hs.select(doc, F.explode(F.aggregate("hs", F.array().cast(f"array<{head}>"), keep)).alias("h")).select(doc, "h.*")


def sections(heads: DataFrame, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, start, level, title, own_end (the next heading), path (titles of the open sections, '>>' between)."""
    w = Window.partitionBy(doc).orderBy("start")
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    h = heads.join(docs.select(doc, F.length(text).alias("__len")), doc)
    h = h.withColumn("own_end", F.coalesce(F.lead("start").over(w), F.col("__len")).cast("long"))
    # A section of level 2 is below the last level 1 before it, one of level 3 also below a level 2 since then.
    mark = lambda n: F.last(F.when(F.col("level") <= n, F.struct("level", "title", "start")), ignorenulls=True).over(back)
    h = h.withColumn("up2", mark(2)).withColumn("up1", mark(1))
    one = F.when(F.col("level") > 1, F.col("up1.title"))
    two = F.when((F.col("level") > 2) & (F.col("up2.level") == 2) & (F.col("up2.start") > F.coalesce("up1.start", F.lit(-1))), F.col("up2.title"))
    return h.withColumn("path", F.concat_ws(" >> ", one, two, F.col("title"))).select(doc, "start", "level", "title", "own_end", "path")


def parents(docs: DataFrame, secs: DataFrame, least: int = 30, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, chunk_id, section, content: a parent chunk of each section of documents with two headings or more."""
    many = secs.withColumn("n", F.count("*").over(Window.partitionBy(doc))).filter("n >= 2")
    t = many.join(docs.select(doc, text), doc)
    body = F.trim(F.substring(F.col(text), (F.col("start") + 1).cast("int"), (F.col("own_end") - F.col("start")).cast("int")))
    t = t.withColumn("body", body).filter(F.length("body") >= least)
    n = F.row_number().over(Window.partitionBy(doc).orderBy("start"))
    return t.select(doc, F.concat(F.col(doc).cast("string"), F.lit("_"), F.lpad(n.cast("string"), 4, "0")).alias("chunk_id"), F.col("path").alias("section"), F.concat(F.lit("["), "path", F.lit("] "), "body").alias("content"))


def sentences(text: Column, latin: bool = False) -> Column:
    """Sentences with their delimiters; blank ones go."""
    return F.filter(F.split(text, LATIN_SENTENCE_END if latin else SENTENCE_END, -1), lambda s: F.trim(F.regexp_replace(s, "\\s", "")) != "")


def children(text: Column, most: int = 150, overlap: int = 30, latin: bool = False) -> Column:
    """array<string>: sentences packed greedily up to `most` characters with the section's prefix on each.

    The next child begins with the last sentence of the one before, if that is shorter than overlap.
    """

    def pack(x: Column) -> Column:
        prefix, ss = x["p"], x["s"]
        state = "struct<out:array<string>,cur:string,last:string>"

        def step(a: Column, s: Column) -> Column:
            fits = F.length(prefix) + F.length(a["cur"]) + F.length(s) <= most
            start = F.when((a["last"] != "") & (F.length(a["last"]) < overlap), F.concat(a["last"], s)).otherwise(s)
            return (
                F.when(a["cur"] == "", F.struct(a["out"].alias("out"), s.alias("cur"), s.alias("last")))
                .when(fits, F.struct(a["out"].alias("out"), F.concat(a["cur"], s).alias("cur"), s.alias("last")))
                .otherwise(F.struct(F.concat(a["out"], F.array(F.concat(prefix, a["cur"]))).alias("out"), start.alias("cur"), s.alias("last")))
                .cast(state)
            )

        zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit("").alias("last")).cast(state)
        done = F.aggregate(ss, zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(F.concat(prefix, a["cur"])))).otherwise(a["out"]))
        return F.when(F.size(ss) == 0, F.array().cast("array<string>")).when(F.length(x["t"]) <= most, F.array(x["t"])).otherwise(done)

    t = F.coalesce(text, F.lit(""))
    prefix = F.regexp_extract(t, "^(\\[[^\\]]+\\]\\s*)", 1)
    return let(F.struct(t.alias("t"), prefix.alias("p"), sentences(F.substring(t, F.length(prefix) + 1, F.length(t)), latin).alias("s")), pack)


def child_chunks(parent_rows: DataFrame, most: int = 150, latin: bool = False, id_col: str = "chunk_id", content: str = "content") -> DataFrame:
    """chunk_id, parent_id, content, content_hash, chunk_type of the children of each parent."""
    kids = parent_rows.select(F.col(id_col).alias("parent_id"), F.posexplode(children(F.col(content), most, latin=latin)).alias("i", "content"))
    return kids.select(F.concat("parent_id", F.lit("_c"), (F.col("i") + 1).cast("string")).alias("chunk_id"), "parent_id", "content", short_hash(F.col("content")).alias("content_hash"), F.lit("child").alias("chunk_type"))


def indexable(chunks: DataFrame) -> DataFrame:
    """Chunks that go to the index: all but parents, a missing type included."""
    return chunks.filter("coalesce(chunk_type, '') <> 'parent'")


def stable_ids(rows: DataFrame, doc: str, title: str, pos: str) -> DataFrame:
    """rows with chunk_id: ten digits of the title's sha1, _2, _3 on repeats within a document in order of pos."""
    base = F.substring(F.sha1(F.col(title).cast("binary")), 1, 10)
    n = F.row_number().over(Window.partitionBy(doc, "__base").orderBy(pos))
    return rows.withColumn("__base", base).withColumn("chunk_id", F.when(n == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), n.cast("string")))).drop("__base")


def keep_first(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key in order of pos."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).filter("__n = 1").drop("__n")


def markdown_entries(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, pos, title, body of each '## ' section of markdown files; what stands before the first is no entry."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n## "), F.lit(2), F.greatest(F.size(F.split(F.concat(F.lit("\n"), text), "\n## ")) - 1, F.lit(0)))
    e = files.select(path, F.posexplode(parts).alias("pos", "part"))
    return e.select(path, "pos", F.trim(F.substring_index("part", "\n", 1)).alias("title"), F.trim(F.regexp_replace("part", "^[^\\n]*\\n?", "")).alias("body"))


def long_enough(rows: DataFrame, least: int, text: str = "text") -> DataFrame:
    """rows whose text has `least` characters or more, white space (Unicode) at its ends left out; a null text has none."""
    return rows.filter(F.length(F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")) >= least)


def uniform_sample(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """limit rows spread evenly over all rows in the order given: those at the places nearest to i * (n - 1) / (limit - 1),
    half to even. All rows, where there are no more."""
    placed = numbered(rows, *order, name="__pos")
    n = placed.count()
    at = rows.sparkSession.range(limit).select(F.bround(F.col("id") * (n - 1) / max(limit - 1, 1)).cast("long").alias("__pos")).distinct()
    return (placed if n <= limit else placed.join(F.broadcast(at), "__pos", "left_semi")).drop("__pos")  # limit rows


def stable_ids(chunks: DataFrame, title: str = "title", group: str = "source", order: str = "pos") -> DataFrame:
    """chunks with chunk_id: ten digits of the title's sha1, with _2, _3 and so on where a group repeats a title, in
    order (the first has no number). Null titles are empty."""
    base = F.substring(F.sha1(F.coalesce(F.col(title), F.lit("")).cast("binary")), 1, 10)
    n = F.row_number().over(Window.partitionBy(group, "__base").orderBy(order))
    out = chunks.withColumn("__base", base).withColumn("__n", n)
    return out.withColumn("chunk_id", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), F.col("__n").cast("string")))).drop("__base", "__n")


def weighted_choice(rows: DataFrame, weights: dict[str, float], key: Column) -> DataFrame:
    """rows with choice: a value by cumulative weight at a uniform number hashed from key."""
    u = (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)) * sum(weights.values())
    out, upto = None, 0.0
    for v, w in weights.items():
        upto += w
        out = F.when(u < upto, v) if out is None else out.when(u < upto, v)
    return rows.withColumn("choice", out.otherwise(next(reversed(weights))))
