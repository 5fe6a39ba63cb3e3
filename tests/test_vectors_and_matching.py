"""Exact vector search and joins, the stored collection, and best matches, against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.operators import matching as ma
from marlstone.operators import retrieval as re
from marlstone.operators import vectors as ve

VEC, ASK, ROW = "cid long, v array<float>", "qid long, qv array<float>", "id long, v array<float>"


def clustered(n, dims=16, centres=12, noise=0.25, seed=3):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims))
    return (c[r.integers(centres, size=n)] + noise * r.normal(size=(n, dims))).astype(np.float32).astype(float)


def cosine(a, b):
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return u(a) @ u(b).T


def best(x, ids, q, k):
    s = np.round(cosine(q, x), 9)
    return [[int(ids[j]) for j in np.lexsort((ids, -row))[:k]] for row in s]


def told(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.qid, []).append(r.cid)
    return out


def frames(spark, x, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], ASK)


def test_search_equals_all_products_whatever_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(ve, "BLOCK", 37)
    monkeypatch.setattr(ve, "QUERIES", 5)
    x = np.vstack([clustered(300), clustered(300)[:20]])  # copies: ties go to the smaller id
    q = x[::29]
    d, a = frames(spark, x, q)
    odd = spark.createDataFrame([(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16)], VEC)
    found = ve.search(d.unionByName(odd), a, 7)
    assert told(found) == dict(enumerate(best(x, np.arange(len(x)), q, 7)))
    assert "Nested" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    near = ve.search(d, a, 1000, least=0.9)
    assert near.count() == int((cosine(q, x) >= 0.9).sum())
    assert ve.search(d.limit(0), a).count() == 0 and ve.search(d, a.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_collection_recall_exactness_inserts_and_deletes(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ve, "BLOCK", block)
    x, ids = clustered(900, noise=0.6), np.arange(900)
    q = x[::20]
    d, a = frames(spark, x, q)
    held = ve.Collection.create(d.filter("cid < 600"), str(tmp_path / "c"), lists=30)
    held = held.insert(d.filter("cid >= 600").unionByName(d.filter("cid < 10")))
    want = best(x, ids, q, 10)
    assert told(held.search(a, 10, probes=2, exact=True)) == dict(enumerate(want))
    near = told(held.search(a, 10, probes=8))
    recall = np.mean([len(set(near[i]) & set(w)) / 10 for i, w in enumerate(want)])
    assert recall > 0.95
    gone = held.delete(d.filter("cid % 3 = 0").select("cid"))
    left = ids[ids % 3 != 0]
    assert told(gone.search(a, 10, exact=True)) == dict(enumerate(best(x[left], left, q, 10)))
    # A list's files are read for its probes only, and an open collection stays at its version.
    assert len(gone.rows([0]).filter("list = 0").select("cid").collect()) <= 900 and told(held.search(a, 10, exact=True)) == dict(enumerate(want))
    again = ve.Collection(spark, str(tmp_path / "c")).insert(d.filter("cid = 0"))
    assert 0 in told(again.search(a, 10, exact=True))[0]


def test_empty_collection(spark, tmp_path):
    d, a = frames(spark, clustered(3), clustered(2))
    held = ve.Collection.create(d.limit(0), str(tmp_path / "c"))
    assert held.search(a).count() == 0
    assert told(held.insert(d).search(a, 2, exact=True)).keys() == {0, 1}


@pytest.mark.parametrize("block", [8, 4096])
def test_pairs_equal_all_pairs_at_a_high_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(ve, "BLOCK", block)
    x = clustered(260)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(60)] + [(2000, None), (2001, [0.0] * 16)]
    got = ve.near_pairs(spark.createDataFrame(rows, ROW), 0.9).collect()
    s = cosine(x, x)
    want = {(i, j) for i in range(260) for j in range(i + 1, 260) if s[i, j] >= 0.9}
    assert len(want) > 500
    pairs = [(r.a, r.b) for r in got if r.a != r.b]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert [(r.a, r.n_a) for r in got if r.a == r.b] == [(7, 61)]
    assert all((r.n_a, r.n_b) == (61 if r.a == 7 else 1, 61 if r.b == 7 else 1) for r in got)
    top = ve.near_pairs(spark.createDataFrame(rows, ROW), 0.9, top=20).collect()
    ranked = sorted(((r.score, r.a, r.b) for r in got), key=lambda t: (-round(t[0], 12), t[1], t[2]))[:20]
    assert {(r.a, r.b) for r in top} == {(a, b) for _, a, b in ranked}


def test_best_match_equals_all_pairs(spark):
    r = random.Random(8)
    # Frequent words are in nearly every text; short texts of frequent words are the hard case.
    say = lambda n: " ".join(r.choice(("the", "of", "in", f"x{r.randint(0, 60)}", f"y{r.randint(0, 400)}")) for _ in range(n))
    docs = [(i, say(r.choice([1, 2, 3, 8, 40, 200]))) for i in range(300)] + [(900, None), (901, "")]
    items = [(i, say(r.randint(1, 25))) for i in range(60)] + [(100, "the of in"), (101, "nowhere"), (102, None), (103, docs[5][1]), (104, "the of zz1 zz2 zz3")]
    d, i = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    want = {}
    for item, text in items:
        a = set((text or "").split())
        scores = [(-len(a & set((t or "").split())) / len(a | set((t or "").split())), doc) for doc, t in docs if a & set((t or "").split())]
        if scores:
            want[item] = (min(scores)[1], round(-min(scores)[0], 9))
    for share in (0.2, 0.5, 1.0):
        assert {x["item"]: (x.doc, round(x.score, 9)) for x in ma.best_match(i, d, tx.tokens, share).collect()} == want
    assert ma.best_match(i.limit(0), d, tx.tokens).count() == 0 and ma.best_match(i, d.limit(0), tx.tokens).count() == 0


def test_nearest_live_entry_of_each_query_against_all_pairs(spark):
    """Blocks of both sides, spans of times, equal vectors, ties, vectors without a cosine and of another length."""
    r = random.Random(5)
    x = clustered(5000, dims=8, centres=40)
    entries = [(i, x[i].tolist(), r.randrange(0, 300)) for i in range(5000)]
    entries += [(9000 + i, x[i % 7].tolist(), 100) for i in range(300)] + [(-1, None, 5), (-2, [0.0] * 8, 5), (-3, [1.0, None] + [0.0] * 6, 5), (-4, [float("nan")] * 8, 5), (-5, [1.0, 2.0], 5), (-6, x[0].tolist(), None)]
    asked = [(i, clustered(1, dims=8, centres=40, seed=i)[0].tolist() if i % 2 else x[i].tolist(), r.randrange(-20, 420)) for i in range(60)]
    asked += [(100, None, 9), (101, [0.0] * 8, 9), (102, [2.0, 4.0], 9), (103, x[3].tolist(), None), (104, [-1.0, 0.0], 9)]
    slot = lambda c, back: re._slots(F.col(c), 100, back).alias("slot")
    e = spark.createDataFrame(entries, "key long, v array<float>, created long").select("*", slot("created", False))
    q = spark.createDataFrame(asked, "qid long, qv array<float>, at long").select("*", slot("at", True))
    got = {g.qid: (g.key, g.score) for g in ve.nearest_live(e, q, 0.9, 100).collect()}
    held = np.array([v for _, v, _ in entries[:5300]])
    ids, made = np.array([k for k, _, _ in entries[:5300]]), np.array([c for _, _, c in entries[:5300]])
    want = {102: (-5, 1.0)}
    for qid, v, at in asked[:60]:
        s = np.where((made <= at) & (at - made <= 100), np.round(cosine(np.array([v], np.float32).astype(float), held)[0], 9), -2)
        if s.max() >= 0.9:
            want[qid] = (int(ids[s == s.max()].min()), s.max())
    assert len(want) > 20
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    assert ve.nearest_live(e.limit(0), q, 0.9, 100).count() == 0 == ve.nearest_live(e, q.limit(0), 0.9, 100).count()


def test_gateway_lookup_of_millions_of_pairs_takes_seconds(spark):
    """400 queries and 4,000 entries of one span: 1.6 million pairs, which took minutes as rows."""
    g = np.random.default_rng(1)
    x = g.normal(size=(4000, 256)).astype(np.float32)
    c = spark.createDataFrame([(i, f"text {i}", v.tolist(), 0) for i, v in enumerate(x)], "key long, text string, v array<float>, created long")
    began = time.time()
    got = re.gateway_lookup(c.filter("key % 10 = 0").selectExpr("key AS qid", "text", "v AS qv", "9 AS at"), c).collect()
    assert sorted((r.qid, r.key, r.score, r.tier) for r in got) == [(i, i, 1.0, "same") for i in range(0, 4000, 10)]
    assert time.time() - began < 60
