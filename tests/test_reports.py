"""Reports, lists, keys and strategies on nulls, ties, empty tables and the rules they stand for."""

import datetime as dt

from pyspark.sql import functions as F

from marlstone.functions import ids
from marlstone.functions import rules as ru
from marlstone.operators import listing as li
from marlstone.operators import reports as re_
from marlstone.operators import strategies as st
from marlstone.sources import files


def col(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_keys_and_formats(spark):
    rows = [("prod_p002_c3", None), ("x_c1_c2", ""), ("plain", None), (None, None), ("x_c1", "told")]
    assert col(spark, ids.parent_id(F.col("c"), F.col("p")), rows, "c string, p string") == ["prod_p002", "x_c1", None, None, "told"]
    assert col(spark, ids.file_of(F.col("c")), [("prod_p002.md_0114",), ("a_b",), ("7",), (None,)], "c string") == ["prod_p002.md", "a_b", "7", None]
    assert col(spark, ids.document_key(F.col("c"), F.col("t")), [("d_c12", "x"), (None, "a b　c\n" * 40), ("", None)], "c string, t string") == ["d", ("abc" * 40)[:60], ""]
    import hashlib

    want = [hashlib.md5(x.encode()).hexdigest()[:12] for x in ("理财|属于|产品", "a||")]
    assert col(spark, ids.triple_id(F.col("h"), F.col("r"), F.col("t")), [("理财", "属于", "产品"), ("a", None, None)], "h string, r string, t string") == want


def test_the_first_json_value_of_a_reply(spark):
    replies = ['{"a": 1}', '```json\n[1, 2]\n```', 'Sure: {not json} then {"b": [2, {"c": 3}]} and more', '{"a": 1}{"a": 2}', "nothing", "", None, '"text"', "[" * 500]
    got = col(spark, ids.lenient_json(F.col("t")), [(r,) for r in replies], "t string")
    assert got == ['{"a":1}', "[1,2]", '{"b":[2,{"c":3}]}', '{"a":1}', None, None, None, '"text"', None]


def test_times_of_c_and_next_ids(spark):
    got = col(spark, ids.ctime(F.col("t")), [("Thu Sep 18 23:53:00 2026",), ("Mon Jan  5 01:02:03 2026",), ("2026-01-05",), (None,), ("Mon Foo 50 01:02:03 2026",)], "t string")
    assert got == [dt.datetime(2026, 9, 18, 23, 53), dt.datetime(2026, 1, 5, 1, 2, 3), None, None, None]
    for names, want in ((["bc001", "bc041", "g900", "bc", None, "bc7x"], "bc042"), ([], "bc001"), (["bc999"], "bc1000")):
        assert spark.createDataFrame([(n,) for n in names], "id string").agg(ids.next_id(F.col("id"), "bc")).first()[0] == want


def test_who_enters_a_subscription(spark):
    s = F.struct(F.col("a").alias("amount"), F.col("p").alias("product"))
    rows = [("buy_process", "买", 1.0, "P"), ("buy_process", "买", None, "P"), ("product_consult", "验证码 123456", None, "P"), ("product_consult", "1234567", None, "P"), ("complaint", "123456", 1.0, "P"), ("buy_process", "x", 1.0, None), (None, None, 1.0, "P")]
    assert col(spark, ru.enters_subscription(F.col("i"), F.col("t"), s), rows, "i string, t string, a double, p string") == [True, False, True, False, False, False, False]


def test_what_a_cache_may_keep(spark):
    rows = [("order", "ok"), ("product", "分析引擎出错了"), ("product", "⚠️ 稍后"), ("product", "注意 ⚠️"), (None, None)]
    assert col(spark, li.cacheable(F.col("i"), F.col("a")), rows, "i string, a string") == [False, False, False, True, True]


def test_samples_of_a_log(spark):
    line = '{{"timestamp": "2026-01-02", "message": "{}", "latency_ms": {}{}}}'
    lines = [
        line.format("GET /a -> 200", 12.7, ""), line.format("GET /a -> 404", 1, ""), line.format("GET /a/stream -> 200", 5, ""), line.format("GET /a/stream -> 200", 5, ', "ttfb_ms": 2'),
        line.format("GET /a -> 500", 99999999999, ""), line.format("hello", 3, ""), "broken {", '{"message": "GET /a -> 200"}', line.format("GET /b -> 200", 9, ', "path": "/c", "status": 503'), line.format("GET /s -> 200", 4, ', "stream": true').replace("01-02", "01-01"),
    ]
    logs = files.parse_logs(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = lambda *a: sorted((x.path, x.ms, x.kind) for x in re_.latency_samples(logs, *a).collect())
    assert got() == [("/a", 1, "http"), ("/a", 12, "http"), ("/a", 99999999999, "suspect"), ("/a/stream", 5, "ignored"), ("/a/stream", 5, "stream"), ("/c", 9, "http"), ("/s", 4, "stream")]
    assert got("2026-01-02", ("a",), True) == [("/a", 12, "http"), ("/a", 99999999999, "suspect"), ("/a/stream", 5, "ignored"), ("/a/stream", 5, "stream")]
    assert re_.latency_samples(logs.limit(0)).count() == 0


def test_figures_of_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "tier int, x string, seconds double, outcome string, created timestamp, taken timestamp, resolved timestamp")
    assert re_.rate(none, none).first()["rate"] == 0.0 and re_.cache_stats(none).first().hit_ratio == 0.0
    assert re_.ticket_sla(none, 60).first().asDict() == {"tickets": 0, "mean_take": None, "mean_close": None, "within": None}
    assert re_.distribution(none, "x").count() == 0 and re_.worker_stats(none).first().mean == 0.0
    d = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "x string")
    assert [(r.x, r.n, r.share) for r in re_.distribution(d, "x").collect()] == [("a", 2, 50.0), (None, 1, 25.0), ("b", 1, 25.0)]
    t = dt.datetime
    tick = spark.createDataFrame([(t(2026, 1, 1), t(2026, 1, 1, 0, 0, 30), t(2026, 1, 1, 0, 2)), (t(2026, 1, 2), t(2026, 1, 1), t(2026, 1, 2, 0, 1)), (t(2026, 1, 2), None, t(2026, 1, 3)), (t(2026, 1, 1), t(2026, 1, 1, 0, 2), t(2026, 1, 1, 0, 3))], "created timestamp, taken timestamp, resolved timestamp")
    assert re_.ticket_sla(tick, 60).first().asDict() == {"tickets": 3, "mean_take": 75.0, "mean_close": 120.0, "within": 0.5}
    hits = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "tier int")
    s = re_.cache_stats(hits).first()
    assert (s.l1_hits, s.l1_misses, s.l2_hits, s.l2_misses, s.l3_hits, s.l3_misses, s.hits, s.misses, s.hit_ratio, s.l1_hit_ratio, s.l2_hit_ratio, s.l3_hit_ratio) == (2, 3, 1, 2, 1, 1, 4, 1, 80.0, 40.0, 33.3, 50.0)


def test_profiles_of_clusters_and_assets(spark):
    rows = [(1, 5, "b", "q5", ["r", "s"]), (1, 2, "a", "q2", ["s"]), (2, 9, "z", "q9", None)]
    got = re_.cluster_profiles(spark.createDataFrame(rows, "cluster int, id int, type string, query string, reasons array<string>")).orderBy("cluster").collect()
    assert [(x.cluster, x["size"], x.share, x.dominant_type, x.representative, x.reasons and [tuple(r) for r in x.reasons]) for x in got] == [(1, 2, 66.7, "a", "q2", [("s", 2), ("r", 1)]), (2, 1, 33.3, "z", "q9", None)]
    of = lambda rows, c: spark.createDataFrame(rows, f"id string, {c} double")
    out = re_.asset_overview(spark.createDataFrame([("u", "Li"), ("v", "Wu")], "id string, name string"), of([("u", 100.0)], "total_deposit"), of([("u", 2.0), ("u", 1.5)], "amount"), of([("u", 50.0)], "remaining"))
    assert sorted((x.id, x.total_investment, x.total_assets, x.net_assets) for x in out.collect()) == [("u", 35000.0, 35100.0, 35050.0), ("v", 0.0, 0.0, 0.0)]


def test_lists_keep_what_comes_first(spark):
    known = spark.createDataFrame([("a", None, "x")], "head string, relation string, tail string")
    cand = spark.createDataFrame([("a", None, "x", 1), ("b", "r", "y", 3), ("b", "r", "y", 2), ("b", "r", None, 4)], "head string, relation string, tail string, pos int")
    assert sorted((x.head, x.tail or "", x.pos) for x in li.unknown(cand, known, ["head", "relation", "tail"], "pos").collect()) == [("b", "", 4), ("b", "y", 2)]
    lists = spark.createDataFrame([(1, 1, 0, "c", "late"), (1, 0, 3, "c", "early"), (1, 0, 1, None, "t" * 60), (1, 1, 2, None, "t" * 50 + "other"), (2, 0, 0, "c", "own")], "qid int, list int, pos int, cid string, content string")
    assert sorted((x.qid, x.cid or "", x.content[:5]) for x in li.merge_distinct(lists).collect()) == [(1, "", "ttttt"), (1, "c", "early"), (2, "c", "own")]
    d = spark.createDataFrame([(i, "s", "body", None if i % 2 else "h") for i in range(9)], "id int, source string, content string, section string")
    page = li.browse(d, "id", 2, 2, "s", section="h", content="od").collect()
    assert [(x.id, x.total) for x in page] == [(4, 5), (6, 5)] and li.browse(d, "id", 9, 2).count() == 0
    once = li.migrate(d, {"new": ("int", 3), "id": ("string", "no")})
    assert once.schema == li.migrate(once, {"new": ("int", 3)}).schema and once.first().new == 3 and dict(once.dtypes)["id"] == "int"


def test_candidates_need_their_entity_in_the_chunk(spark):
    chunks = spark.createDataFrame([(1, "x" * 40 + " fund"), (2, "short fund"), (3, "y" * 50)], "chunk_id int, content string")
    e = [(1, 5, "q1", [("fund", "P")]), (3, 1, "q1", [("fund", "P")]), (2, 0, "q2", []), (3, 2, "q3", [("fund", "Q")]), (1, 3, "q3", None), (9, 0, "q9", []), (3, 0, "", [])]
    ent = spark.createDataFrame(e, "chunk_id int, at int, question string, entities array<struct<name:string,type:string>>")
    assert sorted(tuple(x) for x in li.question_candidates(ent, chunks, ("P",)).collect()) == [("q1", 1), ("q3", 3)]


def test_context_of_tickets_and_access(spark):
    turns = spark.createDataFrame([("s", i, f"q{i}") for i in range(9)], "session string, at int, query string")
    got = {x.id: [r.query for r in x.context] for x in li.ticket_context(spark.createDataFrame([(1, "s"), (2, "t")], "id int, session string"), turns, "session", "at").collect()}
    assert got == {1: ["q3", "q4", "q5", "q6", "q7", "q8"], 2: []}
    asked = spark.createDataFrame([("o1", "u"), ("o1", "v"), ("o1", None), ("o9", "u")], "oid string, me string")
    assert sorted((x.oid, x.me or "", x.access) for x in li.owned(asked, spark.createDataFrame([("o1", "u")], "oid string, user string"), "oid", "user").collect()) == [("o1", "", "ok"), ("o1", "u", "ok"), ("o1", "v", "denied"), ("o9", "u", "missing")]


def test_uploads_of_one_batch_are_told_apart(spark):
    f = spark.createDataFrame([("b", "h1", 5), ("a", "h1", 5), ("c", "h2", 99), ("d", "h3", 5), ("e", "h2", 5)], "path string, content_hash string, size long")
    got = {x.path: x.outcome for x in files.check_uploads(f, spark.createDataFrame([("h3",)], "content_hash string"), 50).collect()}
    assert got == {"a": "accepted", "b": "duplicate", "c": "too_large", "d": "duplicate", "e": "accepted"}


def test_strategies_tell_their_contexts(spark):
    triples = [(0, "理财产品", "不属于", "存款"), (1, "存款保险", "只保障", "存款"), (2, "稳盈添利30天", "属于", "理财产品"), (3, "大额存单3年期", "属于", "存款")]
    q = spark.createDataFrame([(1, "稳盈添利30天的风险等级和收益是多少？理财受存款保险保护吗？"), (2, "你好"), (3, None)], "qid long, text string")
    known = spark.createDataFrame(triples, "pos int, head string, relation string, tail string")
    told = st.evidence(q, known)
    assert [tuple(x) for x in told.collect()] == [(1, "【关系推理】理财产品 不属于 存款；存款保险 只保障 存款；稳盈添利30天 属于 理财产品；大额存单3年期 属于 存款")]
    lst = lambda rows: spark.createDataFrame([(1, c, 1.0 / r, r) for c, r in rows], "qid long, cid long, score double, rank int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "cid long, v array<double>")
    asked = spark.createDataFrame([(1, [0.8, 0.6])], "qid long, qv array<double>")
    out = st.contexts(lst([(1, 1), (2, 2), (3, 3)]), lst([(2, 1), (9, 2)]), v, asked, told)
    got = {}
    for x in out.orderBy("rank").collect():
        got.setdefault(x.strategy, []).append(x.cid if x.cid is not None else x.sentence[:6])
    # 2 is in both lists; 9 has no vector; of 1, 2 and 3 the first and the one unlike it are diverse.
    assert got == {"vector": [1, 2], "audited": [1, 2], "hybrid": [2, 1], "agentic": [2, 1, 9], "hybrid_mmr": [2, 3], "graph": [2, 3, "【关系推理】"]}


def test_answers_are_audited_by_their_numbers(spark):
    a = [(1, 0, "收益3.5%"), (1, 1, "收益3.00%"), (1, 2, "30天"), (2, 0, "99"), (2, 1, "98"), (2, 2, "97"), (2, 3, "30"), (3, 0, "第1条"), (4, 0, None), (5, 0, "30")]
    attempts = spark.createDataFrame(a, "qid long, attempt int, answer string")
    ctx = spark.createDataFrame([(i, "业绩比较基准3.00%，封闭30天。") for i in range(1, 5)], "qid long, text string")
    assert sorted(tuple(x) for x in st.audited(attempts, ctx).collect()) == [(1, 1, "收益3.00%", True, None), (2, 2, "97", False, "97"), (3, 0, "第1条", True, None), (4, 0, None, True, None), (5, 0, "30", False, "30")]
    assert st.audited(attempts.limit(0), ctx).count() == 0


def test_lengths_sets_and_orders(spark):
    from marlstone.functions import text as tx
    from marlstone.operators import chunking as ch

    d = spark.createDataFrame([("　 abc \n",), ("ab",), (None,), ("",)], "text string")
    assert [x.text for x in ch.long_enough(d, 3).collect()] == ["　 abc \n"]
    rows = [(["a", "b"], ["b", "c", "c"]), ([], ["x"]), ([], [])]
    got = col(spark, tx.set_sizes(F.col("a"), F.col("b")), rows, "a array<string>, b array<string>")
    assert [tuple(x) for x in got] == [(1, 3), (0, 1), (0, 0)]
    seen = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0), (2, "z", 5)], "k int, v string, at int")
    assert sorted((x.k, x["values"]) for x in li.ordered_distinct(seen, "k", "v", "at").collect()) == [(1, ["b", "a"]), (2, ["z"])]
    assert sorted(tuple(x) for x in li.union_distinct(seen.select("k"), seen.select("k")).collect()) == [(1,), (2,)]
