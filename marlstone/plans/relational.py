"""Scans, filters, joins, aggregates, windows, top-k and set operations over service and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import lifecycle as lc
from marlstone.plans.registry import plan
from marlstone.session import table
from marlstone.sources import files

# --- sources and sinks over tables -------------------------------------------------------------------------------


@plan("s6_product_chunks", """
SELECT p_partkey || '_0' AS chunk_id, 'overview' AS section, concat('[', p_name, '] ', p_type, ' R', p_size % 5 + 1) AS content FROM part
UNION ALL SELECT p_partkey || '_1', 'brand', concat('[', p_name, '] ', p_brand) FROM part
UNION ALL SELECT p_partkey || '_2', 'size', concat('[', p_name, '] size ', p_size) FROM part""")
def product_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: a head, and a chunk each of brand and size."""
    part = lambda title, body: F.struct(F.lit(title).alias("title"), body.alias("body"))
    sections = F.array(part("brand", F.col("p_brand")), part("size", F.concat(F.lit("size "), F.col("p_size"))))
    risk = F.concat(F.lit("R"), (F.col("p_size") % 5 + 1).cast("string"))
    return files.render_products(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), risk.alias("risk"), sections.alias("sections")))


@plan("s10_vector_upsert", """
WITH incoming AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0)
SELECT e.vec_id, e.label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.vec_id = e.vec_id)
UNION ALL SELECT vec_id, label FROM incoming""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with every seventh replaced and others added."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = e.filter("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).unionByName(e.filter("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return lc.upsert(e, new, "vec_id")


@plan("s11_delete_by_document", "SELECT d.doc_id, d.source FROM documents d ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) x ON d.doc_id = x.doc_id")
def delete_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the toxic ones."""
    return lc.delete(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id")

# --- joins ---------------------------------------------------------------------------------------------------------------


@plan("j8_keep_uploads", """
SELECT doc_id, 'rebuilt' AS origin FROM documents WHERE source <> 'src1' OR quality_seen
UNION ALL SELECT doc_id, 'upload' FROM documents WHERE source = 'src1' AND NOT quality_seen""".replace("FROM documents", "FROM (SELECT d.doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS quality_seen FROM documents d) t"))
def keep_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild of all documents but those of one source without a label, which are kept as its uploads."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = table(spark, sf_dir, "labels").select("doc_id").distinct()
    built = d.filter("source <> 'src1'").unionByName(d.filter("source = 'src1'").join(seen, "doc_id", "left_semi")).select("doc_id", F.lit("rebuilt").alias("origin"), F.lit(False).alias("is_upload"))
    store = d.select("doc_id", F.lit("upload").alias("origin"), (F.col("source") == "src1").alias("is_upload"))
    return lc.rebuild(built, store, "doc_id").select("doc_id", "origin")


@plan("j9_full_outer_diff", """
WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0),
     b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
  WHEN a.h <> b.h THEN 'modified' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two states of the documents; every document is in one or both."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("h"))
    new = d.filter("doc_id % 3 <> 0 OR doc_id % 5 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return lc.diff(old, new, "doc_id", "h")
