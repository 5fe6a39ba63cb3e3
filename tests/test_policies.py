"""Queues, reviews, states, themes and lists on literal frames, with the reference's words."""

from pyspark.sql import functions as F

from marlstone.operators import policies as po


def test_task_states_and_nodes(spark):
    said = [" Progress ", "PROCESSING", "completed", "REVOKED", "???", None, "", "retry", "Failed"]
    d = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    assert [r.x for r in d.select("i", po.task_state(F.col("s")).alias("x")).orderBy("i").collect()] == ["processing", "processing", "completed", "failed", "failed", "failed", "failed", "processing", "failed"]
    d = spark.createDataFrame([("complaint",), ("fee_rule",), ("chitchat",), ("unknown",), (None,)], "i string")
    assert [r.x for r in d.select(po.node_of(F.col("i")).alias("x")).collect()] == ["handoff_node", "finance_node", "chitchat_node", "general_node", "general_node"]


def test_queue_is_ordered_by_severity(spark):
    rows = [(1, 0.6, None, None), (2, None, None, None), (3, 0.9, True, False), (4, 0.1, False, False), (5, 0.7, True, True), (6, 0.2, None, True)]
    d = spark.createDataFrame(rows, "id int, confidence double, evidence_covered boolean, chunk_info_hit boolean")
    assert [(r.id, r.reason, r.severity) for r in po.low_confidence_queue(d).collect()] == [(4, "evidence_missing", 0), (3, "chunk_missing", 1), (1, "low_confidence", 2), (6, "low_confidence", 2)]
    assert po.low_confidence_queue(d, limit=1).count() == 1 and po.low_confidence_queue(d.limit(0)).count() == 0


def test_reviews(spark):
    rows = [("pass", "fee_rule", None, 0), ("reject", "fee_rule", "x", 1), ("reject", None, "x", 2), ("flag", "complaint", None, 0), ("flag", "fee_rule", "subscribe_node", None), (None, "buy_process", None, None)]
    d = spark.createDataFrame(rows, "v string, i string, s string, n int")
    got = d.select(po.skips_review(F.col("v"), F.col("i"), F.col("s")).alias("a"), po.after_review(F.col("v"), F.col("n")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, "formatter_node"), (False, "regenerate_node"), (True, "formatter_node"), (True, "formatter_node"), (True, "formatter_node"), (False, "formatter_node")]
    rows = [(0.9, "pass", False, True, 0, 10.0), (0.9, "flag", False, True, 1, 70.0), (0.2, "pass", False, True, 2, 70.0), (0.2, "pass", False, True, 2, 30.0), (0.2, "pass", True, None, None, 5.0), (None, None, None, None, None, 60.0)]
    d = spark.createDataFrame(rows, "c double, q string, b boolean, r boolean, n int, s double")
    got = [tuple(r.x) for r in d.select(po.review_outcome(*[F.col(c) for c in "cqbrns"]).alias("x")).collect()]
    assert got == [("skip", 85.0), ("retry", 70.0), ("exhausted", 40.0), ("exhausted", 30.0), ("skip", 85.0), ("reviewed", 60.0)]
    assert [r.x for r in spark.createDataFrame([(80,), (79,), (50,), (49,), (None,)], "s int").select(po.badge(F.col("s")).alias("x")).collect()] == ["high", "medium", "medium", "low", "low"]


def test_themes_adjust_unsure_intents(spark):
    cases = spark.createDataFrame([(1, "fee_rule", 0.5), (2, "fee_rule", 0.7), (3, "deposit_insurance", 0.1), (4, "fee_rule", 0.1), (5, None, 0.1)], "id long, intent string, confidence double")
    hits = [(i, 1, "存款保险条例", "") for i in (1, 2, 3)] + [(i, 2, "x", "最高偿付 50 万") for i in (1, 2, 3)] + [(1, 3, "REDEEM.md", None), (4, 1, "fee", ""), (4, 2, "hold", ""), (4, 4, "hold", ""), (5, 1, "buy", ""), (5, 2, "", "双录")]
    h = spark.createDataFrame(hits, "id long, rank int, source string, text string")
    assert {r.id: (r.intent, r.adjusted) for r in po.consistent_intent(cases, h).collect()} == {1: ("deposit_insurance", True), 2: ("fee_rule", False), 3: ("deposit_insurance", False), 4: ("fee_rule", False), 5: ("buy_process", True)}
    assert spark.range(1).select(po.theme_of(F.lit("a"), F.lit("x" * 200 + "保本")).alias("x")).first().x is None


def test_evidence_and_lists(spark):
    c = spark.createDataFrame([(1, 2, "b" * 2000, "s2"), (1, 1, "a", None), (1, 3, None, "s2"), (1, 4, "d", "s1")], "k int, o int, content string, source string")
    r = po.evidence_lines(c, "k", "o").first()
    assert r.lines == ["- a [来源: 未知]", f"- {'b' * 1500} [来源: s2]", "-  [来源: s2]", "- d [来源: s1]"] and r.sources == ["s2", "s1"]
    rows = [(1, 1, "a", 0.9, None), (1, 2, "a", 0.8, "n"), (1, 3, "b", 0.1, ""), (1, 4, "c", 0.0, "n"), (1, 5, "d", 0.0, None), (1, 6, "a", 0.7, None)]
    d = spark.createDataFrame(rows, "qid long, id long, intent string, score double, note string")
    assert [(x.id, x.place) for x in po.diverse_top(d, 4).orderBy("place").collect()] == [(1, 1), (3, 2), (2, 3), (4, 4)]
    h = spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.9), (3, 7, 0.9), (1, 8, 0.9)], "qid long, cid long, score double")
    assert [(x.cid, x.score, x.best) for x in po.merged(h).collect()] == [(7, 0.9, 2), (8, 0.9, 1)]


def test_reports_and_evidence_states(spark):
    kind = "id int, m double, n int"
    base, new = spark.createDataFrame([(1, 0.5, 1), (2, None, 2), (3, 1.0, None), (4, 1.0, 1)], kind), spark.createDataFrame([(1, 0.6, 0), (2, 0.1, 2), (3, None, None)], kind)
    assert {(r.id, r.metric): r.verdict for r in po.compared(base, new, ("m", "n")).collect()} == {(1, "m"): "better", (1, "n"): "worse", (2, "m"): "better", (2, "n"): "same", (3, "m"): "worse", (3, "n"): "same"}
    golden = spark.createDataFrame([(1, {"a": "h1", "b": "h2", "c": None, "d": None})], "id int, hashes map<string,string>")
    now = spark.createDataFrame([("a", "h1"), ("b", "x"), ("c", None)], "chunk string, hash string")
    assert [tuple(r) for r in po.evidence_states(golden, now).collect()] == [(1, 1, 1, 2)]
