"""Chunking plans over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import chunking as ch
from marlstone.plans.registry import plan
from marlstone.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first lines are marked as headings of three levels: the fixture has none of its own."""
    t = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 4 == 0) & (i < 12), F.concat(F.element_at(F.array(F.lit("# "), F.lit("## "), F.lit("### ")), (F.floor(i / 4) % 3 + 1).cast("int")), F.substring(F.regexp_replace(x, "[^A-Za-z ]", ""), 1, 12), F.lit("\n"), x)).otherwise(x)), "\n")
    return _docs(spark, sf_dir).select("doc_id", t.alias("text"))


_WIN = """SELECT doc_id, n::INT AS n, (n * {step})::INT AS start, md5(substring(text, (n * {step} + 1)::INT, {size})) AS content FROM
(SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - {ov}) / {step}::DOUBLE)::INT, 1))) AS n FROM documents WHERE length(text) > 0) x {where}"""


@plan("c6_windows", _WIN.format(step=280, size=350, ov=70, where="WHERE length(trim(substring(text, (n * 280 + 1)::INT, 350), ' ')) >= 30"))
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 350 characters with 70 of overlap."""
    return ch.windows(_docs(spark, sf_dir)).withColumn("content", F.md5(F.col("content").cast("binary")))


@plan("c7_extraction_windows", _WIN.format(step=700, size=800, ov=100, where=""))
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 800 characters with 100 of overlap, short ones kept."""
    return ch.windows(_docs(spark, sf_dir), 800, 100, keep_short=True).withColumn("content", F.md5(F.col("content").cast("binary")))


@plan("c8_sentences", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$')) AS s FROM documents) x WHERE trim(regexp_replace(s, '\s', '', 'g')) <> '' GROUP BY doc_id")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, by Latin delimiters."""
    return _docs(spark, sf_dir).select("doc_id", F.size(ch.sentences(F.col("text"), latin=True)).cast("long").alias("n")).filter("n > 0")


@plan("c9_child_chunks")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to 150 characters."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return ch.child_chunks(d, latin=True).select("chunk_id", "parent_id", "content_hash", F.length("content").alias("n"))


@plan("c1_headings")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading lines with level and offset."""
    return ch.headings(_headed(spark, sf_dir))


@plan("c2_sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section paths and own ranges (C2, C3)."""
    d = _headed(spark, sf_dir)
    return ch.sections(ch.headings(d), d)


@plan("c4_page_of_offset", "SELECT doc_id, least(1 + n_chars // 2 // 3000, greatest(1, ceil(n_chars / 3000.0)))::INT AS page FROM documents")
def page_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page that holds the middle of each document, pages ending every 3,000 characters: the first whose end is not before it."""
    n = F.greatest(F.ceil(F.col("n_chars") / 3000), F.lit(1)).cast("int")
    pages = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("page"), (i * 3000 - 1).alias("end")))
    mid = F.floor(F.col("n_chars") / 2)
    return table(spark, sf_dir, "documents").select("doc_id", F.get(F.filter(pages, lambda p: mid <= p["end"]), F.lit(0))["page"].alias("page"))


@plan("c5_parent_chunks")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent chunks of sections."""
    d = _headed(spark, sf_dir)
    return ch.parents(d, ch.sections(ch.headings(d), d)).select("doc_id", "chunk_id", "section", F.md5(F.col("content").cast("binary")).alias("h"))


@plan("c10_parents_and_children")
def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their children, typed."""
    d = _headed(spark, sf_dir)
    p = ch.parents(d, ch.sections(ch.headings(d), d))
    kids = ch.child_chunks(p, latin=True).select("chunk_id", "parent_id", "chunk_type")
    return p.select("chunk_id", F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("chunk_type")).unionByName(kids)


@plan("c11_indexable", "SELECT doc_id FROM documents WHERE coalesce(CASE doc_id % 3 WHEN 0 THEN 'parent' WHEN 1 THEN 'child' END, '') <> 'parent'")
def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for the index: a missing type is kept."""
    d = table(spark, sf_dir, "documents").withColumn("chunk_type", F.when(F.col("doc_id") % 3 == 0, "parent").when(F.col("doc_id") % 3 == 1, "child"))
    return ch.indexable(d).select("doc_id")


@plan("c13_stable_ids", """SELECT source, doc_id, base || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS chunk_id FROM (
 SELECT source, doc_id, base, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) AS n FROM (SELECT source, doc_id, substring(sha1(coalesce(regexp_extract(text, '^[^ ]*'), '')), 1, 10) AS base FROM documents) x) y""")
def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents by their titles (first words), told apart within a source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("title", F.regexp_extract("text", "^[^ ]*", 0))
    return ch.stable_ids(d, "title", "source", "doc_id").select("source", "doc_id", "chunk_id")


@plan("c14_hashes", "SELECT doc_id, sha256(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) AS content_hash, substring(md5(text), 1, 12) AS raw_hash FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of documents, without white space and as they are."""
    return _docs(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.short_hash(F.col("text")).alias("raw_hash"))


@plan("c15_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(regexp_replace(text, '[ \\t\\n\\r]+', '', 'g')) ORDER BY doc_id) AS n FROM documents) x WHERE n = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content hash."""
    d = _docs(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("h"))
    return ch.keep_first(d, "h", "doc_id").select("doc_id")


@plan("c16_uniform_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents WHERE doc_id % 3 <> 1) d
WHERE n <= 50 OR pos IN (SELECT round_even(i * (SELECT count(*) - 1 FROM documents WHERE doc_id % 3 <> 1) / 49.0, 0)::BIGINT FROM range(50) r(i))""")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty spread evenly over the documents of two thirds of the ids, which have gaps."""
    return ch.uniform_sample(table(spark, sf_dir, "documents").select("doc_id").filter("doc_id % 3 <> 1"), 50, "doc_id")


@plan("c17_min_length", "SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 60")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 60 characters or more between their ends' white space."""
    return ch.long_enough(_docs(spark, sf_dir), 60).select("doc_id")


@plan("c12_recursive_chunks")
def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut anew at paragraphs, lines, sentences and words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", F.lit(1).alias("page"), F.col("text").alias("content"))
    return ch.recursive_chunks(d).select("chunk_id", "source", F.md5(F.col("content").cast("binary")).alias("h"))


@plan("c18_weighted_choice")
def choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event kind for each customer by weight."""
    return ch.weighted_choice(table(spark, sf_dir, "customer").select("c_custkey"), {"view": 5.0, "buy": 2.0, "leave": 1.0}, F.col("c_custkey"))


@plan("s4_markdown_entries")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents read as markdown."""
    d = _headed(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    return ch.markdown_entries(d).select("path", "pos", "title", F.length("body").alias("n"))


@plan("s5_pages_and_sections")
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages split at their article and headings, prefix and text."""
    p = table(spark, sf_dir, "pages")
    body = F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    parts = p.select("page_id", title.alias("title"), F.posexplode(F.split(body, "<p>")).alias("pos", "part"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("part", "<[^>]*>", " "), "\\s+", " "))
    return parts.select("page_id", "pos", F.concat(F.lit("["), "title", F.lit("] "), plain).alias("content")).filter(F.length("content") > 30)


@plan("s3_pages_min_length", "SELECT page_id, length(html) AS n FROM pages WHERE length(trim(html, ' ' || chr(9) || chr(10) || chr(13))) >= 30")
def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 30 characters or more."""
    return ch.long_enough(table(spark, sf_dir, "pages"), 30, "html").select("page_id", F.length("html").alias("n"))
