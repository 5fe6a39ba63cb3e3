"""Service and evaluation operators against plain Python on small frames."""

import random
from datetime import datetime, timedelta

import pytest

from marlstone.operators import evaluation as ev
from marlstone.operators import service as sv


def floor_at(values, p):
    return sorted(values)[min(len(values) - 1, int(len(values) * p))]


@pytest.mark.parametrize("distinct", [3, 50, 5000])
def test_floor_percentiles_equal_sorting(spark, distinct):
    rnd = random.Random(distinct)
    rows = [(rnd.choice(["a", "b", "b", "b", None]), float(rnd.randrange(distinct))) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    ps = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {x.g: x for x in sv.floor_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ps).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, x in got.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert {n: x[n] for n in ps} == {n: floor_at(values, p) for n, p in ps.items()}


def test_floor_percentiles_rule_and_empty_table(spark):
    four = spark.createDataFrame([(x,) for x in (4, 2, 1, 3)], "v long")
    assert [x.p for x in sv.floor_percentiles(four, [], "v", {"p": 0.5}).collect()] == [3]
    assert sv.floor_percentiles(four.limit(0), [], "v", {"p": 0.5}).collect() == []


REQUEST = "at timestamp, stream boolean, status int, ok boolean, cache_hit boolean, ms double, ttfb_ms double"


def test_streams_stay_out_of_the_request_times(spark):
    now = datetime(2024, 1, 2, 12, 30)
    rows = [(now - timedelta(minutes=1), True, 200, True, False, 9000.0 + i, 100.9 + i) for i in range(100)]
    x = sv.sli_snapshot(spark.createDataFrame(rows, REQUEST), now, 1).first()
    assert (x.total, x.samples, x.stream_samples, x.avg_ms, x.p99_ms) == (100, 0, 100, 0.0, 0)
    assert (x.stream_ttfb_p50_ms, x.stream_total_p50_ms, x.stream_total_p99_ms) == (150, 9050, 9099)


def test_snapshot_windows_and_rates(spark):
    now = datetime(2024, 1, 2, 12, 30)
    at = lambda h: now - timedelta(hours=h)
    rows = [(at(0), False, 200, None, True, 10.7, None), (at(0), False, 504, None, False, 30.0, None), (at(0), None, 500, None, None, 20.0, None),
            (at(0), True, 200, False, False, 50.0, None), (at(2), False, 200, None, False, 99.0, None), (at(24), False, 500, None, False, 1.0, None)]
    df = spark.createDataFrame(rows, REQUEST)
    x = sv.sli_snapshot(df, now, 1).first()
    assert (x.total, x.success_rate, x.error_rate, x.timeout_rate, x.cache_hit_rate) == (4, 0.25, 0.5, 0.25, 0.25)
    assert (x.avg_ms, x.p50_ms, x.samples, x.stream_cnt, x.stream_errors, x.stream_ttfb_p50_ms) == (20.0, 20, 3, 1, 1, 0)
    assert x.qps == pytest.approx(4 / 3600)
    assert sv.sli_snapshot(df, now, 24).first().total == 5
    none = sv.sli_snapshot(df.limit(0), now, 24).first()
    assert (none.total, none.success_rate, none.p50_ms, none.avg_ms) == (0, 0.0, 0, 0.0)


def test_badcases_take_each_condition(spark):
    rows = [("ok", "faq", '["a"]', "pass", 0.9), ("down", "faq", '["a","b"]', "pass", 0.9), ("unknown", "unknown", '["a"]', "pass", 0.9), ("blank", "", '["a"]', "pass", 0.9),
            ("empty", "faq", "[]", "pass", 0.9), ("nosrc", "faq", None, "pass", 0.9), ("reject", "faq", '["a"]', "reject", 0.9), ("unsure", "faq", '["a"]', "pass", 0.49),
            ("null", None, '["a"]', None, None), ("edge", "faq", '["a"]', "pass", 0.5), ("all", None, "null", "reject", 0.1)]
    votes = [("down", 1), ("down", -1), ("ok", 1), ("all", -1), ("gone", -1)]
    got = {x.trace_id: x for x in sv.badcases(spark.createDataFrame(rows, "trace_id string, intent string, sources string, verdict string, confidence double"), spark.createDataFrame(votes, "trace_id string, rating int")).collect()}
    assert {t: x.reasons for t, x in got.items()} == {
        "down": ["downvote"], "unknown": ["unknown_intent"], "blank": ["unknown_intent"], "empty": ["empty_retrieval"], "nosrc": ["empty_retrieval"], "reject": ["reject"], "unsure": ["low_confidence"],
        "all": ["downvote", "unknown_intent", "empty_retrieval", "reject", "low_confidence"]}
    assert (got["down"].rating, got["down"].sources_n, got["nosrc"].sources_n) == (-1, 2, 0)


def test_catalog_search(spark):
    c = spark.createDataFrame([(0, "p1", "Gold 30", "fund", "R2"), (1, "p2", "Gold 90", "fund", "r3"), (2, "p3", "Save", "deposit gold", None)], "pos long, id string, name string, type string, risk string")
    ids = lambda **k: sorted(x.id for x in sv.filter_products(c, **k).collect())
    assert ids() == ["p1", "p2", "p3"] and ids(risk="R3") == ["p2"] and ids(type="fund", keyword=" 30 ") == ["p1"] and ids(keyword="gold") == ["p3"]
    assert {x.wanted: x.id for x in sv.find_products(c, ["Gold", "p3", "90", " ", "absent"]).collect()} == {"Gold": "p1", "p3": "p3", "90": "p2"}
    assert sv.find_products(c, []).collect() == []


def test_subscription_gate_order(spark):
    profiles = spark.createDataFrame([("u1", "R3", "123"), ("u2", "R1", "123"), ("u3", None, "123"), ("u4", "R9", None)], "user_id string, level string, verify_code string")
    catalog = spark.createDataFrame([("p", "R2", 5.0), ("odd", None, None), ("low", "r1", 0.0)], "product_id string, risk string, min_amount double")
    holdings = spark.createDataFrame([("u1", "low"), ("u1", "low")], "user_id string, product_id string")
    rows = [(None, "x", 1.0, "", "login"), ("u1", "x", 1.0, "123", "product"), ("u2", "p", None, "", "suitability"), ("u1", "odd", 9.0, "123", "suitability"), ("u1", "p", None, "123", "amount"),
            ("u1", "p", 4.9, "123", "below_minimum"), ("u1", "p", 5.0, "", "code"), ("u1", "p", 5.0, None, "code"), ("u1", "p", 5.0, "9", "code"), ("u1", "low", 5.0, "123", "held"), ("u1", "p", 5.0, "123", "ok"),
            ("u3", "p", 5.0, "123", "ok"), ("u4", "low", 5.0, "123", "suitability"), ("u9", "p", 5.0, "1", "code")]
    df = spark.createDataFrame(rows, "user_id string, product_id string, amount double, code string, want string")
    got = sv.subscription_gate(df, profiles, catalog, holdings).collect()
    assert len(got) == len(rows) and [x for x in got if x.gate != x.want] == []


def test_recall_and_rewrites(spark):
    golden = spark.createDataFrame([(1, [10, 11]), (2, [20]), (3, [30]), (4, [])], "qid long, keys array<long>")
    hits = spark.createDataFrame([(1, 11, 2), (1, 10, 3), (1, 20, 1), (2, 20, 1), (3, 10, 1)], "qid long, cid long, rank int")
    ranks = ev.hit_ranks(golden, hits)
    assert {x.qid: (x["rank"], x.overlap) for x in ranks.collect()} == {1: (2, 2), 2: (1, 1), 3: (None, 0), 4: (None, 0)}
    got = ev.recall_mrr(ranks, 3).collect()
    assert [(x.k, x.recall) for x in got] == [(1, 0.25), (2, 0.5), (3, 0.5)] and {x.mrr for x in got} == {0.375}
    after = spark.createDataFrame([(1, None), (2, 2), (3, 1)], "qid long, rank int")
    x = ev.rewrite_delta(ranks, after).first()
    assert (x.n, x.improved, x.downgraded, x.mrr_before, x.mrr_after) == (3, 1, 1, 0.5, 0.5)


def test_offline_metrics(spark):
    path = lambda *s: [dict(zip(("head", "relation", "tail"), t)) for t in s]
    golden = spark.createDataFrame([(1, ["a.md"], ["gold"], path("xyz", "xyw")), (2, ["b.md"], ["gold"], path("xyz")), (3, None, ["gold"], None), (4, ["c.md"], [], [])],
                                   "qid long, evidence array<string>, keywords array<string>, path array<struct<head:string,relation:string,tail:string>>")
    found = spark.createDataFrame([(1, " a.md ", "no"), (1, "a.md", "gold bar"), (2, "a.md", "gold"), (3, "a.md", "gold"), (4, "c.md", None)], "qid long, source string, content string")
    triples, hits = spark.createDataFrame([tuple("xyz")], "head string, relation string, tail string"), spark.createDataFrame([(1,), (1,), (9,)], "qid long")
    x = ev.offline_metrics(golden, found, triples, hits).first()
    assert (x.n, x.evidence_coverage, x.chunk_hit_rate, x.path_consistency, x.graph_trigger_ratio) == (4, pytest.approx(2 / 3), pytest.approx(1 / 3), 0.5, 0.25)
    assert ev.offline_metrics(golden.filter("qid = 3"), found, triples, hits).first().evidence_coverage is None


def test_answer_session_and_judge_metrics(spark):
    a = spark.createDataFrame([("x", "x", False, True, True), ("y", "x", False, True, False), (None, "x", True, False, True), ("x", "x", None, None, None)], "intent string, expected string, pii boolean, risk_required boolean, warned boolean")
    assert tuple(ev.online_metrics(a).first()) == (4, 0.5, 0.5)
    t = spark.createDataFrame([("s", "x", "x", False, "about foo", "foo", True), ("s", "y", "x", True, "about it", "foo", True), ("t", "x", "x", None, None, "foo", False), ("t", "x", "x", False, "q", "", None)],
                              "session_id string, intent string, expected string, pii boolean, rewritten string, product string, needs_context boolean")
    assert tuple(ev.session_metrics(t).first()) == (2, 4, 0.75, 0.75, 0.5, 2, pytest.approx(1 / 3), 3)
    assert ev.session_metrics(t.limit(0)).first().intent_accuracy is None
    j = spark.createDataFrame([("a", 60.0, 50.0, True, False), ("a", 59.0, 70.0, False, True), (None, 90.0, 90.0, False, None), ("b", None, None, None, None)], "category string, accuracy double, faithfulness double, hallucinated boolean, refuse_correct boolean")
    got = {x.category: (x.n, x.accuracy, x.pass_rate) for x in ev.judge_summary(j).collect()}
    assert got == {"a": (2, 59.5, 0.5), "none": (1, 90.0, 1.0), None: (3, pytest.approx(209 / 3), pytest.approx(2 / 3))}
    assert {x.c: (x.n, x.correct, x.accuracy) for x in ev.accuracy_by(spark.createDataFrame([("p", True), ("p", None), (None, False)], "c string, correct boolean"), "c").collect()} == {"p": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_sweep_hotspots_and_gaps(spark):
    rows = [(0.9, True, True), (0.7, True, False), (0.5, True, None), (0.95, False, False), (None, True, True)]
    got = [tuple(x) for x in ev.threshold_sweep(spark.createDataFrame(rows, "score double, eligible boolean, correct boolean"), [0.5, 0.8, 1.0]).collect()]
    assert got == [(0.5, 3, 0.6, 2, pytest.approx(2 / 3)), (0.8, 1, 0.2, 0, 0.0), (1.0, 0, 0.0, 0, 0.0)]
    q = spark.createDataFrame([("faq", "is foo or bar safe"), ("faq", "foo foo"), ("faq", None), (None, "x")], "intent string, text string")
    assert {(x.kind, x.name): (x.n, x.gap) for x in ev.hotspots(q, ["foo", "bar", "baz"]).collect()} == {("intent", "faq"): (3, False), ("intent", "unknown"): (1, True), ("product", "foo"): (2, False), ("product", "bar"): (1, False)}
    names = spark.createDataFrame([("goldfund.md",), ("old goldbar.md",), ("ab",), (None,)], "name string")
    asked = spark.createDataFrame([("goldfish",), ("silverbar",), ("ab",), ("ab",), (None,)], "product string")
    assert {x.product: (x.n_docs, x.missing) for x in ev.kb_gap(asked, names).collect()} == {"goldfish": (2, False), "silverbar": (0, True), "ab": (1, False)}
