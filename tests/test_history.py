"""Sequences over ranges, and the histories made of them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import chunking as ch
from marlstone.operators import history as hi
from marlstone.operators import lifecycle as lc
from marlstone.operators import service as sv
from marlstone.operators.ordering import last_of, numbered, sequence

@pytest.fixture(autouse=True, scope="module")
def split(spark):
    """Small ranges stay apart, so that values are carried from one to the next."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ROW = "k string, o long, v double, t string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    # One key holds most rows: it must be split, and its values carried from range to range.
    keys = ["hot"] * 600 + ["a", "b", None] * 40
    out = [(k, i, r.choice([None, 1.0, 2.5, -3.0]), r.choice(["x", "y", None])) for i, k in enumerate(r.sample(keys, len(keys)))]
    r.shuffle(out)
    return out


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda x: x[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_sequence_equals_loops_and_splits_the_hot_key(spark, rows):
    d = spark.createDataFrame(rows, ROW)
    v = F.col("v")
    got = sequence(d, ["k"], [F.col("o")], s=("sum", F.coalesce(v, F.lit(0.0))), m=("max", v), l=("last", v), p=("lag", v))
    want = {}
    for part in by_key(rows).values():
        s, m, last, prev = 0.0, None, None, None
        for pos, (_, o, x, _) in enumerate(part):
            s += x or 0.0
            m = x if m is None else m if x is None else max(m, x)
            last = last if x is None else x
            want[o] = (pos, s, m, last, prev)
            prev = x
    assert {r.o: (r["pos"], r.s, r.m, r.l, r.p) for r in got.collect()} == want
    hot = d.filter("k = 'hot'").repartitionByRange("k", F.struct("o")).withColumn("p", F.spark_partition_id()).select("p").distinct().count()
    assert hot > 1
    with pytest.raises(ValueError, match="no running value"):
        sequence(d, ["k"], [F.col("o")], x=("mean", v))
    assert sequence(d.limit(0), ["k"], [F.col("o")], s=("sum", v)).count() == 0


def test_numbered(spark):
    d = spark.createDataFrame([(i * 3 % 101,) for i in range(101)], "x long")
    assert sorted((r.x, r["pos"]) for r in numbered(d, "x").collect()) == [(i, i) for i in range(101)]
    assert numbered(d.limit(0), "x").count() == 0


def test_histories_equal_loops(spark, rows):
    d = spark.createDataFrame(rows, ROW)
    versions, streak, topic, carried = {}, {}, {}, {}
    for k, part in by_key(rows).items():
        n, prev, was, run, turns, slot = 0, None, (), 0, 0, None
        for _, o, x, t in part:
            if was != (t,):
                n, turns = n + 1, 0
                versions[o] = (k, n, prev)
                prev = o
            was, turns = (t,), turns + 1
            run = run + 1 if x == 1.0 else 0
            slot = slot if x is None else x
            streak[o], topic[o], carried[o] = run, turns, slot
    assert {r.o: (r.k, r.version, r.prev) for r in hi.version_chain(d, "k", "o", F.col("t")).collect()} == versions
    assert {r.o: r.streak for r in hi.streaks(d, "k", "o", F.col("v") == 1.0).collect()} == streak
    assert {r.o: r.turn_count for r in hi.turns_in_topic(d, "k", "o", "t").collect()} == topic
    assert {r.o: r.slot for r in hi.carried(d, "k", "o", F.col("v"), "slot").collect()} == carried
    assert [r.o for r in last_of(d, ["k"], 1, F.desc("o")).orderBy("o").collect()] == sorted(max(x[1] for x in p) for p in by_key(rows).values())
    assert [r.o for r in hi.newest(d, 3, "o").collect()] == [719, 718, 717]


def test_linear_percentiles_equal_interpolation(spark, rows):
    import numpy as np

    d = spark.createDataFrame(rows, ROW)
    got = {r.k: (r.p10, r.p50, r.p99) for r in sv.linear_percentiles(d, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, cuts=4).collect()}
    for k, part in by_key(rows).items():
        x = [r[2] for r in part if r[2] is not None]
        assert got[k] == pytest.approx(tuple(np.percentile(x, [10, 50, 99])))


def test_samples_titles_and_promotions(spark):
    d = spark.createDataFrame([(i * 7,) for i in range(101)], "i long")  # ids with gaps
    assert sorted(r.i for r in ch.uniform_sample(d, 5, "i").collect()) == [0, 175, 350, 525, 700]
    assert ch.uniform_sample(d.limit(3), 5, "i").count() == 3 and ch.uniform_sample(d.limit(0), 5, "i").count() == 0
    c = spark.createDataFrame([("s", 1, "Gold fund"), ("s", 2, "Gold bond"), ("s", 3, "Gold fund"), ("t", 1, "Gold fund"), ("t", 2, None)], "source string, pos long, title string")
    ids = {(r.source, r["pos"]): r.chunk_id for r in ch.stable_ids(c).collect()}
    assert ids["s", 1] == ids["t", 1] and ids["s", 3] == ids["s", 1] + "_2" and ids["s", 2] != ids["s", 1] and len(set(ids.values())) == 4
    golden = spark.createDataFrame([("t9", "bad_7"), ("t8", "bad_12")], "trace_id string, id string")
    bad = spark.createDataFrame([(f"t{i}",) for i in range(10)], "trace_id string")
    assert {r.trace_id: r.id for r in lc.promote(bad, golden).collect()} == {"t9": "bad_7", "t8": "bad_12"} | {f"t{i}": f"bad_{13 + i}" for i in range(8)}
    h = spark.createDataFrame([(["b", None, "a"],)], "h array<string>").select(tx.evidence_hash(F.col("h")).alias("x"), F.sha2(F.lit("a|b"), 256).alias("y")).first()
    assert h.x == h.y
