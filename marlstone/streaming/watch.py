"""A watched folder: files that arrive are ingested into a stored table, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import lifecycle as lc
from marlstone.sources.buckets import BucketTable

ROW = "name string, source string, text string"
STORE = f"{ROW}, content_hash string, prev_version int, version int, status string"


def store(spark: SparkSession, path: str, buckets: int = 32) -> BucketTable:
    """The table that a watched folder is ingested into: made where there is none."""
    try:
        return BucketTable(spark, path)
    except FileNotFoundError:
        return BucketTable.create(spark.createDataFrame([], f"id string, {STORE}"), path, "id", buckets)


def ingest_batch(rows: DataFrame, path: str, stream: str, batch: int) -> None:
    """One batch of rows (name, source, text) into the table at path: texts that it holds already are skipped, others
    are new versions of their name. A batch that the table has taken changes nothing."""
    held = store(rows.sparkSession, path)
    if held.taken((stream, batch)):
        return
    fresh = lc.ingest(rows.filter("text is not null").withColumn("content_hash", tx.content_hash(F.col("text"))), held.read())
    key = F.concat_ws("#", "name", F.col("version").cast("string")).alias("id")
    held.upsert(fresh.select(key, *[F.col(c.split()[0]).cast(c.split()[1]) for c in STORE.split(", ")]), batch=(stream, batch))


def sync(spark: SparkSession, folder: str, path: str, checkpoint: str, stream: str = "watch", files_per_batch: int = 100) -> int:
    """Takes what has arrived in folder (JSON lines) since the last call into the table at path, and stops: a second
    call takes nothing twice. A file is read once it is there whole; lines that aren't JSON are left out. Returns the
    table's version."""
    lines = spark.readStream.schema(ROW).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(folder)
    query = lines.writeStream.foreachBatch(lambda rows, n: ingest_batch(rows, path, stream, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store(spark, path).manifest["version"]


def documents(spark: SparkSession, path: str, deleted: tuple[str, ...] = ()) -> DataFrame:
    """The latest version of each name in the table at path."""
    rows = store(spark, path).read()
    return lc.latest(rows.filter(~F.col("name").isin(*deleted)) if deleted else rows, "name", "version")
