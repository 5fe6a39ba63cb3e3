"""Lifecycle plans: upserts, versions, audits and state moves over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import lifecycle as lc
from marlstone.plans.registry import plan
from marlstone.session import scratch, table
from marlstone.sources.buckets import BucketTable
from marlstone.streaming import watch


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.sha2("text", 256).alias("content_hash"))


@plan("o1_ingest", """WITH d AS (SELECT doc_id, source AS name, sha256(text) AS h FROM documents), s AS (SELECT name, h, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS version FROM d WHERE doc_id % 4 = 0),
f AS (SELECT name, h FROM d WHERE doc_id % 4 <> 0 AND h NOT IN (SELECT h FROM s) QUALIFY row_number() OVER (PARTITION BY h ORDER BY name) = 1)
SELECT name, h AS content_hash, coalesce((SELECT max(version) FROM s WHERE s.name = f.name), 0) + row_number() OVER (PARTITION BY name ORDER BY h) AS version FROM f""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents with their versions."""
    from pyspark.sql import Window

    d = _hashed(spark, sf_dir)
    store = d.filter("doc_id % 4 = 0").withColumn("version", F.row_number().over(Window.partitionBy("name").orderBy("doc_id")))
    return lc.ingest(d.filter("doc_id % 4 <> 0").drop("doc_id"), store).select("name", "content_hash", "version")


@plan("o2_approve", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'approved' WHEN doc_id % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, 'old' AS origin FROM documents WHERE (doc_id % 2 <> 0 OR doc_id % 5 = 0) AND doc_id NOT IN (SELECT doc_id FROM p WHERE status = 'approved') UNION ALL SELECT doc_id, 'new' FROM p WHERE status = 'approved'""")
def approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after decisions on pending documents."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    pending = d.filter("doc_id % 2 = 0").withColumn("origin", F.lit("new"))
    said = d.filter("doc_id % 3 < 2").withColumn("decision", F.when(F.col("doc_id") % 3 == 0, "approved").otherwise("rejected"))
    return lc.approve(pending, said, d.filter("doc_id % 2 <> 0 or doc_id % 5 = 0").withColumn("origin", F.lit("old")))[1]


@plan("o3_rebuild", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR source = 'src2'")
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuilt store that keeps uploads."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("source") == "src2").alias("is_upload"))
    return lc.rebuild(d.filter("doc_id % 3 = 0"), d, "doc_id").select("doc_id")


@plan("o4_counts_agree", "SELECT true AS agree")
def agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether chunks, vectors and index have as many rows."""
    d = table(spark, sf_dir, "documents")
    return spark.range(1).select(F.lit(lc.counts_agree(d, d.select("doc_id"), d.select("text"))).alias("agree"))


@plan("o5_delete_everywhere", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src4')")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without those of deleted documents."""
    d = table(spark, sf_dir, "documents")
    gone = d.filter("source = 'src4'").select("doc_id")
    return lc.delete_everywhere({"documents": d, "labels": table(spark, sf_dir, "labels")}, gone, "doc_id")["labels"].select("doc_id", "quality")


@plan("o6_ticket_moves", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O') THEN 'closed' WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'P' THEN 'closed'
ELSE CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'taken' ELSE 'closed' END END AS status FROM orders""")
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets after allowed moves."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "taken").otherwise("closed").alias("status"))
    return lc.move_tickets(o, o.filter("id % 2 = 0").select("id", F.lit("closed").alias("to"))).select("id", "status")


@plan("o7_promote", """SELECT trace_id, id FROM (SELECT doc_id AS trace_id, 'bad_' || doc_id AS id FROM documents WHERE doc_id < 20 UNION ALL
SELECT doc_id, 'bad_' || (19 + row_number() OVER (ORDER BY doc_id)) FROM labels WHERE quality = 0 AND doc_id >= 20) x""")
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad cases added to the golden set once."""
    golden = table(spark, sf_dir, "documents").filter("doc_id < 20").select(F.col("doc_id").alias("trace_id"), F.concat(F.lit("bad_"), F.col("doc_id").cast("string")).alias("id"))
    return lc.promote(table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("trace_id")), golden)


@plan("o8_task_upsert", "SELECT o_custkey AS task_id, max(o_orderkey) AS last_order, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks updated field by field."""
    o = table(spark, sf_dir, "orders")
    t = o.groupBy(F.col("o_custkey").alias("task_id")).agg(F.min("o_orderkey").alias("last_order"), F.lit("?").alias("status"))
    new = lc.latest(o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("last_order"), F.col("o_orderstatus").alias("status")).withColumn("seq", F.col("last_order")), "task_id", "seq").select("task_id", "last_order", "status")
    return lc.task_upsert(t, new)


@plan("m7_latest_status", "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return lc.latest(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "event_id"), "user_id", "event_id").select("user_id", "status")


@plan("o9_relabel", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.relabel(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), {"en": "english", "de": "german"}, "lang", ("source",))


@plan("o10_backfill", "SELECT doc_id, md5(text) AS h FROM documents")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing hashes taken from the files."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return lc.backfill(d.withColumn("h", F.when(F.col("doc_id") % 3 > 0, F.col("h"))), d, "doc_id", "h")


@plan("o11_split_triples", "SELECT s_suppkey, s_suppkey % 4 = 0 AS handwritten FROM supplier")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-written and derived rows, the derived ones added only where they are new."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    own = s.filter("s_suppkey % 4 = 0").withColumn("handwritten", F.lit(True))
    return own.unionByName(s.join(own, "s_suppkey", "left_anti").withColumn("handwritten", F.lit(False)))


@plan("o12_fold_sections", "SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows folded into their parent."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.lit("").alias("title"), F.col("l_linenumber").cast("string").alias("body"))
    out = lc.fold_sections(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), li)
    s = F.coalesce("sections", F.array().cast("array<struct<pos:int,title:string,body:string>>"))
    return out.select(F.col("id").alias("o_orderkey"), F.size(s).cast("long").alias("n"), F.array_join(F.transform(s, lambda x: x["body"]), ",").alias("lines"))


@plan("s12_full_rebuild", "SELECT doc_id, length(text) % 7 + 1 AS norm FROM documents")
def encode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by a pluggable encoder (here: a number of its length)."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") % 7 + 1).cast("long").alias("norm"))


@plan("s10_stored_upsert", """SELECT vec_id, label, n FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 1 OR vec_id % 6 = 0 THEN label + 100 ELSE label END AS label, len(embedding)::BIGINT AS n FROM embeddings) x WHERE vec_id % 10 <> 3""")
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of the even vectors, into which the odd ones and some of those it had are put, and from which a tenth is deleted."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("n"))
    held = BucketTable.create(rows.filter("vec_id % 2 = 0"), scratch(spark, "upsert"), "vec_id")
    held = held.upsert(rows.filter("vec_id % 2 = 1 or vec_id % 6 = 0").withColumn("label", F.col("label") + 100))
    return held.delete(rows.filter("vec_id % 10 = 3")).read()


@plan("s21_watched_folder", """SELECT 'doc-' || doc_id AS name, v AS version, source, sha256(regexp_replace(text || CASE v WHEN 2 THEN ' changed' ELSE '' END, '\\s+', '', 'g')) AS content_hash
FROM (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY regexp_replace(text, '\\s+', '', 'g')) d, (VALUES (1), (2)) t(v) WHERE v = 1 OR doc_id % 10 = 0""")
def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of documents after a folder of their first texts was synced twice, and once more with changed ones beside repeated ones."""
    w = Window.partitionBy(tx.content_hash(F.col("text"))).orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").filter("text is not null").withColumn("n", F.row_number().over(w)).filter("n = 1")
    rows = docs.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"), "source", "text", "doc_id")
    folder, path, marks = (scratch(spark, f"watch-{x}") for x in ("in", "table", "marks"))
    rows.drop("doc_id").write.json(folder)
    for _ in range(2):
        watch.sync(spark, folder, path, marks)
    changed = rows.filter("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" changed")))
    changed.unionByName(rows.filter("doc_id % 10 = 1")).drop("doc_id").write.mode("append").json(folder)
    watch.sync(spark, folder, path, marks)
    return watch.store(spark, path).read().select("name", "version", "source", "content_hash")
