"""A stored inverted index for BM25: built once, searched many times, grown by segments.

A segment holds blocks of postings, split into buckets of terms on disk, and a table of its documents. A block is up to
BLOCK postings of one term, those of the highest impact (most occurrences in the shortest documents) first, with the most
occurrences and the least length among them: these bound the score of every posting in it, whatever the averages are
by then. A search reads the buckets of its terms only, takes a threshold from each term's first blocks, and opens no
block whose bound can't reach it. Documents that are deleted or replaced are told by tombstones until segments are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators.retrieval import ranked
from marlstone.session import cut, scratch
from marlstone.sources.manifest import Store, fingerprint

#: Postings of a block, buckets of terms, documents whose postings of a term are ordered together.
BLOCK, BUCKETS, SHARD = 128, 32, 200_000
#: Query terms and tombstones up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bounds within this of the threshold are opened: sums may round.
SLACK = 1e-6


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_segment(store: Store, chunks: DataFrame, cid: str, text: str, buckets: int) -> dict:
    """One segment of chunks: where its blocks and documents are, and its sums."""
    toks = cut(chunks.select(F.col(cid).alias("cid"), tx.tokens(F.coalesce(text, F.lit(""))).alias("ts")))
    docs = toks.select("cid", F.size("ts").cast("long").alias("dl"), F.size(F.array_distinct("ts")).cast("long").alias("du"))
    folder = {"docs": store.folder("docs"), "blocks": store.folder("blocks")}
    docs.write.parquet(folder["docs"])
    total = store.spark.read.parquet(folder["docs"]).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.coalesce(F.sum("du"), F.lit(0)).alias("du")).first()
    # The postings of a document's terms are counted within its row: no shuffle before they are dealt to blocks.
    counted = toks.select("cid", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("cid", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    shards = max(1, -(-total.n // SHARD))
    placed = counted.select("*", _bucket(F.col("term"), buckets).alias("bucket"), F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"))
    # Dealt by bucket and shard once: ordering, blocks and files need no further shuffle.
    placed = placed.repartition("bucket", "shard")
    w = Window.partitionBy("bucket", "shard", "term").orderBy(F.desc("tf"), "dl", "cid")
    cells = placed.withColumn("block", F.floor((F.row_number().over(w) - 1) / BLOCK).cast("int"))
    blocks = cells.groupBy("bucket", "shard", "term", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.collect_list(F.struct("cid", "tf", "dl")).alias("entries"))
    blocks.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(folder["blocks"])
    return folder | {"n": total.n, "dl": total.dl, "du": total.du}


class TextIndex:
    """The index stored at path. Every change makes a new version; an opened index stays at its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self.manifest = self.store.read()

    @classmethod
    def create(cls, chunks: DataFrame, path: str, cid: str = "cid", text: str = "text", buckets: int = BUCKETS, **about) -> TextIndex:
        """Indexes chunks at a path without an index. Null texts are empty; ids are distinct and not null."""
        store = Store(chunks.sparkSession, path)
        store.write({"buckets": buckets, "segments": [_write_segment(store, chunks, cid, text, buckets)], "dead": [], "about": about})
        return cls(chunks.sparkSession, path)

    def append(self, chunks: DataFrame, cid: str = "cid", text: str = "text") -> TextIndex:
        """A further segment; chunks whose id is there already replace what it had."""
        there = _union([self.spark.read.parquet(s["docs"]).select("cid") for s in self.manifest["segments"]])
        again = chunks.select(F.col(cid).alias("cid")).join(there, "cid", "left_semi")
        segment = _write_segment(self.store, chunks, cid, text, self.manifest["buckets"])
        return self._changed(self.manifest["segments"] + [segment], self._tombstones(again))

    def delete(self, ids: DataFrame) -> TextIndex:
        """Takes documents (cid) out of the index; their postings go when segments are merged."""
        return self._changed(self.manifest["segments"], self._tombstones(ids.select("cid")))

    def merge(self, chunks: DataFrame, cid: str = "cid", text: str = "text") -> TextIndex:
        """One segment of chunks, what the index is to hold, in place of all; no tombstones are left."""
        return self._changed([_write_segment(self.store, chunks, cid, text, self.manifest["buckets"])], [])

    def _tombstones(self, ids: DataFrame) -> list[dict]:
        folder = self.store.folder("dead")
        ids.distinct().write.parquet(folder)
        if self.spark.read.parquet(folder).isEmpty():
            return self.manifest["dead"]
        return [*self.manifest["dead"], {"ids": folder, "below": len(self.manifest["segments"])}]

    def _changed(self, segments: list[dict], dead: list[dict]) -> TextIndex:
        self.store.write(self.manifest | {"segments": segments, "dead": dead})
        return TextIndex(self.spark, self.store.path)

    def _dead(self) -> DataFrame | None:
        """segment, cid of what isn't there any more."""
        rows = [self.spark.read.parquet(d["ids"]).select(F.explode(F.sequence(F.lit(0), F.lit(d["below"] - 1))).alias("segment"), "cid") for d in self.manifest["dead"]]
        return _hint(cut(_union(rows).distinct())) if rows else None

    def _live(self, df: DataFrame, dead: DataFrame | None) -> DataFrame:
        return df if dead is None else df.join(dead, ["segment", "cid"], "left_anti")

    def docs(self) -> DataFrame:
        """segment, cid, dl, du of every document that the index holds."""
        parts = [self.spark.read.parquet(s["docs"]).withColumn("segment", F.lit(i)) for i, s in enumerate(self.manifest["segments"])]
        return self._live(_union(parts), self._dead()).select("segment", "cid", "dl", "du")

    def corpus(self, avgdl: str = "distinct") -> tuple[int, float]:
        """Number of documents, and their average length: of distinct terms, or 'total'. Segments' sums, less the dead."""
        c = "du" if avgdl == "distinct" else "dl"
        if self.manifest["dead"]:
            r = self.docs().agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("s")).first()
            n, total = r.n, r.s
        else:
            n, total = (sum(s[k] for s in self.manifest["segments"]) for k in ("n", c))
        return n, total / n if n else 0.0

    def blocks(self, buckets: list[int] | None = None) -> DataFrame:
        """segment, shard, term, block, n, tf, dl, entries; of some buckets only, whose files alone are read then."""
        parts = [self.spark.read.parquet(s["blocks"]).withColumn("segment", F.lit(i)) for i, s in enumerate(self.manifest["segments"]) if s["n"]]
        parts = [p if buckets is None else p.filter(F.col("bucket").isin(buckets)) for p in parts]
        if not parts:
            return self.spark.createDataFrame([], "segment int, shard int, term string, block int, n int, tf int, dl int, entries array<struct<cid:long,tf:int,dl:int>>")
        return _union(parts)

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, avgdl: str = "distinct") -> DataFrame:
        """qid, cid, score, rank of the k best documents of each query (qid, text), ties by cid; as `retrieval.bm25` ranks.

        Words of a query count once. A query without a known word has no row.
        """
        n, average = self.corpus(avgdl)
        asked = queries.select("qid", F.explode(F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
        # As many rows as there are buckets, at most: which files to read, and how many words are asked for.
        told = asked.groupBy(_bucket(F.col("term"), self.manifest["buckets"]).alias("bucket")).count().collect()
        hint = F.broadcast if sum(r["count"] for r in told) <= BROADCAST_ROWS else (lambda d: d)
        dead = self._dead()
        blocks = self.blocks([r.bucket for r in told])
        narrow = blocks.join(hint(asked.select("term").distinct()), "term", "left_semi")
        weight = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))
        # A term's bound is what its best block can give: of narrow columns, as are counts where nothing was deleted.
        best = narrow.groupBy("term").agg(F.max(weight(F.col("tf"), F.col("dl"))).alias("most"), F.sum("n").alias("df"))
        if dead is not None:
            alive = self._live(narrow.select("segment", "term", F.explode("entries.cid").alias("cid")), dead)
            best = best.drop("df").join(alive.groupBy("term").agg(F.count("*").alias("df")), "term")
        best = best.select("term", "most", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        q = asked.join(best, "term").withColumn("most", F.col("idf") * F.col("most"))
        q = hint(cut(q.select("qid", "term", "idf", (F.sum("most").over(Window.partitionBy("qid")) - F.col("most")).alias("rest"))))

        def scores(which: DataFrame) -> DataFrame:
            each = self._live(which.select("qid", "idf", "segment", F.explode("entries").alias("e")).select("qid", "idf", "segment", "e.*"), dead)
            return each.groupBy("qid", "cid").agg(F.sum(F.col("idf") * weight(F.col("tf"), F.col("dl"))).alias("score"))

        own = blocks.join(q, "term")
        first = ranked(scores(own.filter("block = 0")), k)
        least = hint(cut(first.filter(F.col("rank") == k).select("qid", F.col("score").alias("least"))))
        bound = F.col("idf") * weight(F.col("tf"), F.col("dl")) + F.col("rest")
        opened = own.join(least, "qid", "left").filter(F.col("least").isNull() | (bound >= F.col("least") - SLACK))
        return ranked(scores(opened).filter("score > 0"), k)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored(spark: SparkSession, chunks: DataFrame, cid: str = "cid", text: str = "text") -> TextIndex:
    """The index of a table of files, kept in the shared folder: made where there is none yet in this application, or
    where the table's files have changed since."""
    key = fingerprint(spark, chunks.inputFiles()) + f":{cid}:{text}"
    kept = spark.sparkContext.__dict__.setdefault("_marlstone_indexes", {})
    if key not in kept:
        path = scratch(spark, "text-index")
        TextIndex.create(chunks, path, cid, text, source=key)
        kept[key] = path
    return TextIndex(spark, kept[key])
