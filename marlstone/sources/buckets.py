"""A stored table in hash buckets of its key: changes rewrite the buckets they touch, and nothing else.

A manifest says which folder each bucket is in; a change writes the new folders first and the manifest last. Until then,
and after a job that fails, readers see the table as it was. Changes may carry the name and number of a batch: one
that the table has taken already is left out, so a replayed batch changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.sources.manifest import Store


class BucketTable:
    """The table at path, at the version it was opened at."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.manifest = self.store.read(version)
        self.key, self.buckets = self.manifest["key"], self.manifest["buckets"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 32) -> BucketTable:
        """Stores rows at a path without a table, one of each key (see upsert)."""
        store = Store(rows.sparkSession, path)
        store.write({"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {}, "batches": {}})
        return cls(rows.sparkSession, path).upsert(rows)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(self.buckets)).cast("int")

    def _schema(self):
        return StructType.fromJson(json.loads(self.manifest["schema"]))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets only: their files alone are read."""
        want = self.manifest["folders"] if buckets is None else {b: f for b, f in self.manifest["folders"].items() if int(b) in set(buckets)}
        if not want:
            return self.spark.createDataFrame([], self._schema())
        return self.spark.read.schema(self._schema()).parquet(*want.values())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys: of their buckets' files."""
        k = keys.select(self.key).distinct()
        touched = [r.b for r in k.select(self._bucket(self.key).alias("b")).distinct().collect()]  # self.buckets numbers at most
        return self.read(touched).join(k, self.key, "left_semi")

    def upsert(self, rows: DataFrame, newest: str | None = None, batch: tuple[str, int] | None = None) -> BucketTable:
        """Rows in place of those with their keys. Of rows that repeat a key the one with the largest `newest` stays, then
        the largest by a hash of all columns. A null key is a key like any other. Columns are the table's, by name."""
        own = rows.select(*[F.col(f"`{c}`") for c in self._schema().names])
        order = [F.desc(newest)] if newest else []
        w = Window.partitionBy(f"`{self.key}`").orderBy(*order, F.desc(F.xxhash64(*own.columns)))
        return self._write(own.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), True, batch)

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> BucketTable:
        """The table without the rows of keys."""
        return self._write(keys.select(self.key).distinct(), False, batch)

    def taken(self, batch: tuple[str, int]) -> bool:
        """Whether a batch has been taken."""
        return self.manifest["batches"].get(batch[0], -1) >= batch[1]

    def _write(self, new: DataFrame, keep: bool, batch: tuple[str, int] | None) -> BucketTable:
        if batch and self.taken(batch):
            return self
        # What comes in is written beside the table once, so that a job run twice writes what was read once.
        inbox = self.store.folder("inbox")
        new.withColumn("__bucket", self._bucket(self.key)).write.parquet(inbox)
        new = self.spark.read.parquet(inbox)
        touched = [r["__bucket"] for r in new.select("__bucket").distinct().collect()]  # self.buckets numbers at most
        batches = self.manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        folders = dict(self.manifest["folders"])
        if touched:
            old = self.read(touched)
            gone = new.select(F.col(f"`{self.key}`").alias("__key")).withColumn("__gone", F.lit(True))
            left = old.join(gone, F.col(f"`{self.key}`").eqNullSafe(F.col("__key")), "left_anti").withColumn("__bucket", self._bucket(self.key))
            out = left.unionByName(new) if keep else left
            made = self.store.folder("rows")
            out.repartition("__bucket").write.partitionBy("__bucket").parquet(made)
            full = {r["__bucket"] for r in self.spark.read.parquet(made).select("__bucket").distinct().collect()} if not out.isEmpty() else set()
            folders = {b: f for b, f in folders.items() if int(b) not in touched} | {str(b): f"{made}/__bucket={b}" for b in full}
        self.store.remove(inbox)
        self.store.write(self.manifest | {"folders": folders, "batches": batches})
        return BucketTable(self.spark, self.store.path)
