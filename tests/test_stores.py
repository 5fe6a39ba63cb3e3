"""Stored structures: the text index, vector collections, bucketed tables and their manifests."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import retrieval as r
from marlstone.operators import textindex as ti
from marlstone.sources.buckets import BucketTable
from marlstone.sources.manifest import Store
from marlstone.streaming import watch

CHUNK, ASK = "cid long, text string", "qid long, text string"


def corpus(n, seed=1, words=60):
    rng = random.Random(seed)
    # A few words are nearly everywhere, most are rare.
    return [(i, " ".join(f"w{min(int(rng.expovariate(0.12)), words)}" for _ in range(rng.randint(1, 60)))) for i in range(n)]


def ranks(rows):
    return sorted((x.qid, x["rank"], x.cid, round(x.score, 9)) for x in rows.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w0 w1 w40"), (2, "w33 w50 w33"), (3, "w0"), (4, "unknown"), (5, None), (6, "w0 w1 w2 w3 w58 w59")], ASK)


@pytest.mark.parametrize("block", [4, 128])
def test_stored_ranks_equal_those_of_an_index_made_anew(spark, tmp_path, asked, monkeypatch, block):
    monkeypatch.setattr(ti, "BLOCK", block)
    monkeypatch.setattr(ti, "SHARD", 100)
    d = spark.createDataFrame(corpus(400) + [(1000, None), (1001, "")], CHUNK)
    idx = ti.TextIndex.create(d, str(tmp_path / "i"))
    for avgdl in ("distinct", "total"):
        for k in (1, 10, 1000):
            assert ranks(idx.search(asked, k, avgdl=avgdl)) == ranks(r.bm25(r.index(d, avgdl=avgdl), asked, k))
    monkeypatch.setattr(ti, "BROADCAST_ROWS", 0)
    assert ranks(idx.search(asked, 5)) == ranks(r.bm25(r.index(d), asked, 5))


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    idx = ti.TextIndex.create(spark.createDataFrame(corpus(300), CHUNK), str(tmp_path / "i"), buckets=16)
    one = spark.createDataFrame([(1, "w5")], ASK)
    bucket = one.select(ti._bucket(F.lit("w5"), 16).alias("b")).first().b
    files = idx.blocks([bucket]).filter(F.col("bucket").isin([bucket])).inputFiles()
    every = idx.blocks().inputFiles()
    read = [f for f in every if f"bucket={bucket}/" in f]
    assert 0 < len(read) < len(every) / 4 and set(files) == set(every)  # files are pruned by the scan, not before
    plan = idx.search(one)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("PartitionFilters: ")[1:]]
    assert scans and all(x.startswith(("[bucket", "[isnotnull(bucket")) and f"= {bucket})" in x[:80] for x in scans)


def test_blocks_that_cannot_reach_the_best_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ti, "BLOCK", 8)
    rows = [(i, "gold " * (1 + (i < 8) * 9) + "dust " * (i % 7)) for i in range(400)]
    idx = ti.TextIndex.create(spark.createDataFrame(rows, CHUNK), str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "gold")], ASK)
    found = idx.search(q, 5).collect()
    assert {x.cid for x in found} <= set(range(8))
    blocks = idx.blocks().filter("term = 'gold'")
    assert blocks.count() == 50
    n, average = idx.corpus()
    best = blocks.select((F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / average))).alias("b")).collect()
    least = min(x.score for x in found) / math.log(1 + 0.5 / (n + 0.5))
    assert sum(x.b >= least for x in best) == 1


def test_segments_replacements_deletions_and_merge(spark, tmp_path, asked):
    rows = corpus(200)
    d = spark.createDataFrame(rows, CHUNK)
    new = spark.createDataFrame([(5, "w0 w40 w40"), (300, "w1 w1 w33")], CHUNK)
    first = ti.TextIndex.create(d, str(tmp_path / "i"))
    before = ranks(first.search(asked, 10))
    grown = first.append(new)
    left = d.filter("cid <> 5").unionByName(new)
    assert ranks(grown.search(asked, 10)) == ranks(r.bm25(r.index(left), asked, 10))
    less = grown.delete(left.filter("cid % 3 = 0").select("cid"))
    left = left.filter("cid % 3 <> 0")
    assert ranks(less.search(asked, 10)) == ranks(r.bm25(r.index(left), asked, 10))
    back = less.append(spark.createDataFrame([(300, "w59"), (3, "w59 w59")], CHUNK))
    left = left.filter("cid <> 300").unionByName(spark.createDataFrame([(300, "w59"), (3, "w59 w59")], CHUNK))
    assert ranks(back.search(asked, 10)) == ranks(r.bm25(r.index(left), asked, 10))
    merged = back.merge(left)
    assert ranks(merged.search(asked, 10)) == ranks(back.search(asked, 10)) and len(merged.manifest["segments"]) == 1
    # What was opened before stays as it was.
    assert ranks(first.search(asked, 10)) == before
    # Writers of one version: the second fails, and what is there stays.
    with pytest.raises(RuntimeError, match="another writer"):
        first.append(new)
    assert ti.TextIndex(spark, str(tmp_path / "i")).manifest == merged.manifest


def test_empty_index_and_missing_one(spark, tmp_path, asked):
    none = spark.createDataFrame([], CHUNK)
    assert ti.TextIndex.create(none, str(tmp_path / "i")).search(asked).count() == 0
    with pytest.raises(FileNotFoundError):
        ti.TextIndex(spark, str(tmp_path / "nothing"))
    assert Store(spark, str(tmp_path / "nothing")).versions() == []


def test_a_table_is_indexed_once_until_its_files_change(spark, tmp_path, asked):
    at = str(tmp_path / "t")
    spark.createDataFrame(corpus(50), CHUNK).write.parquet(at)
    a = ti.stored(spark, spark.read.parquet(at))
    assert ti.stored(spark, spark.read.parquet(at)).store.path == a.store.path
    spark.createDataFrame(corpus(60), CHUNK).write.mode("overwrite").parquet(at)
    assert ti.stored(spark, spark.read.parquet(at)).corpus()[0] == 60


ROWS = "k long, v string, n int"


def kept(t):
    return sorted(((r.k, r.v) for r in t.read().collect()), key=repr)


def test_bucketed_table_touches_the_buckets_of_its_changes_only(spark, tmp_path):
    rows = [(i, f"v{i}", 0) for i in range(400)]
    t = BucketTable.create(spark.createDataFrame(rows, ROWS), str(tmp_path / "t"), "k", 16)
    assert kept(t) == sorted(((k, v) for k, v, _ in rows), key=repr)
    before = dict(t.manifest["folders"])
    new = t.upsert(spark.createDataFrame([(5, "a", 1), (5, "b", 2), (None, "null", 0)], ROWS), newest="n")
    assert dict(kept(new))[5] == "b" and dict(kept(new))[None] == "null"
    again = new.upsert(spark.createDataFrame([(None, "null2", 0)], ROWS))
    assert dict(kept(again))[None] == "null2" and len(kept(again)) == 401
    changed = {b for b, f in again.manifest["folders"].items() if before[b] != f}
    assert 1 <= len(changed) <= 2
    gone = again.delete(spark.createDataFrame([(7,), (None,), (9999,)], "k long"))
    assert len(kept(gone)) == 399 and 7 not in dict(kept(gone))
    assert [r.v for r in gone.lookup(spark.createDataFrame([(9,), (7,)], "k long")).collect()] == ["v9"]
    # What was opened, or is opened at a version, stays.
    assert len(kept(t)) == 400 and len(kept(BucketTable(spark, str(tmp_path / "t"), t.manifest["version"]))) == 400
    assert kept(gone.delete(spark.createDataFrame([(i,) for i in range(400)], "k long"))) == []


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    t = BucketTable.create(spark.createDataFrame([(i, "v", 0) for i in range(50)], ROWS), str(tmp_path / "t"), "k")

    def broken(v):
        raise ValueError("lost")

    bad = spark.createDataFrame([(1, "x", 0)], ROWS).withColumn("v", F.udf(broken)("v"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad)
    now = BucketTable(spark, str(tmp_path / "t"))
    assert now.manifest == t.manifest and len(kept(now)) == 50
    # A job that dies between the files and the manifest.
    write, Store.write = Store.write, lambda self, m: (_ for _ in ()).throw(OSError("gone"))
    try:
        with pytest.raises(OSError, match="gone"):
            t.upsert(spark.createDataFrame([(1, "x", 0)], ROWS))
    finally:
        Store.write = write
    assert kept(BucketTable(spark, str(tmp_path / "t"))) == kept(t)
    assert dict(kept(t.upsert(spark.createDataFrame([(1, "x", 0)], ROWS))))[1] == "x"


def test_a_batch_is_taken_once(spark, tmp_path):
    t = BucketTable.create(spark.createDataFrame([], ROWS), str(tmp_path / "t"), "k")
    one = t.upsert(spark.createDataFrame([(1, "a", 0)], ROWS), batch=("s", 0))
    assert one.taken(("s", 0)) and not one.taken(("s", 1)) and not one.taken(("other", 0))
    assert one.upsert(spark.createDataFrame([(1, "b", 0)], ROWS), batch=("s", 0)).manifest == one.manifest
    assert kept(one.delete(spark.createDataFrame([(1,)], "k long"), batch=("s", 1))) == []


def test_watched_folder_equals_its_batch_twin(spark, tmp_path):
    folder, path, marks = (str(tmp_path / x) for x in ("in", "t", "marks"))
    (tmp_path / "in").mkdir()
    drop = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("name", "source", "text"), r, strict=True))) for r in rows) + "\n{not json\n")
    drop("1.json", [("a", "s", "one"), ("b", "s", "two"), ("c", "s", None)])
    first = watch.sync(spark, folder, path, marks)
    assert watch.sync(spark, folder, path, marks) == first  # nothing is taken twice
    drop("2.json", [("a", "s", "one more"), ("d", "s", "t w o")])
    watch.sync(spark, folder, path, marks)
    got = sorted((r.name, r.version, r.text) for r in watch.store(spark, path).read().collect())
    assert got == [("a", 1, "one"), ("a", 2, "one more"), ("b", 1, "two")]  # d has b's text
    assert sorted((r.name, r.version) for r in watch.documents(spark, path, deleted=("b",)).collect()) == [("a", 2)]
    twin = str(tmp_path / "twin")
    for n, f in enumerate(("1.json", "2.json")):
        watch.ingest_batch(spark.read.schema(watch.ROW).option("mode", "DROPMALFORMED").json(f"{folder}/{f}"), twin, "w", n)
        watch.ingest_batch(spark.read.schema(watch.ROW).option("mode", "DROPMALFORMED").json(f"{folder}/{f}"), twin, "w", n)  # replayed
    assert sorted((r.name, r.version, r.text) for r in watch.store(spark, twin).read().collect()) == got
