"""Answer checks, question terms, routes, redaction, alias resolution and graph evidence, on the languages they are for."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import checks as ck
from marlstone.functions import rules as ru
from marlstone.functions import terms as te
from marlstone.operators import graph as g


def each(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, t {kind}").select("i", expr.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


ROUTES = {
    "日日盈怎么样": "product_consult", "现金管理类介绍": "product_consult", "稳盈添利如何": "product_consult", "安心固收": "product_consult",
    "费用大概\n谁出": "fee_rule", "费用是多少": "fee_rule", "管理费": "fee_rule", "费用": "unknown",
    "这个高收益产品可靠吗": "fraud_report", "陌生的渠道": "fraud_report", "陌生的\n渠道": "unknown", "我被骗了": "fraud_report",
    "A和B哪个": "product_compare", "推荐一下": "product_compare", "我要投诉": "complaint", "转人工": "service_policy",
    "50万都赔吗": "deposit_insurance", "存50万": "unknown", "是不是存款": "deposit_insurance",
    "我是 r3 吗": "risk_suitability", "R3级": "unknown", "保守的人能买吗": "risk_suitability", "能买吗": "unknown", "R 能买吗": "unknown",
    "什么时候到期": "hold_redeem", "怎么买": "buy_process", "年化": "income_question", "你好呀": "chitchat", "HELLO": "chitchat", "天气": "unknown",
}


def test_routes_with_the_reference_words(spark):
    got = each(spark, [*ROUTES, None], ru.fallback_intent(F.col("t"), ru.REFERENCE))
    assert dict(zip(ROUTES, [x.intent for x in got], strict=False)) == ROUTES
    assert got[-1].intent == "unknown" and {x.confidence for x in got} == {0.30, 0.55}


def test_trend_in_the_order_of_the_list(spark):
    texts = ["先下降后增长", "下滑", "持平", "波动上升", "没有", None, "x" * 200 + "增长"]
    assert each(spark, texts, ru.trend(F.col("t"))) == ["up", "down", "stable", "up", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"password": "hunter2", "token": "abc"}', '{"password": "***REDACTED***", "token": "***REDACTED***"}'),
        ("{'API_KEY': 'sk-1', 'n': 1}", "{'API_KEY': '***REDACTED***', 'n': 1}"),
        ("token=abc, next", "token=***REDACTED***, next"),
        ("{token: abc}", "{token: ***REDACTED***}"),
        ("Password : x y", "Password : ***REDACTED*** y"),
        ("passwords are kept; tokens too", "passwords are kept; tokens too"),
        (None, None),
    ],
)
def test_redaction(spark, line, want):
    assert each(spark, [line], ru.redact(F.col("t"))) == [want]


def test_terms_of_questions(spark):
    v = te.Vocabulary(names=("稳盈添利30天", "稳盈添利", "大额存单"))
    texts = ["稳盈添利30天2024年的收益率是多少", "大额存单3年期与定期存款的区别", "R3 中高风险的 QDII fund 费率 T+0？", "", None]
    got = each(spark, texts, te.asked(F.col("t"), v))
    assert [x.strong for x in got] == [["2024年", "30天", "稳盈添利30天"], ["3年", "大额存单"], ["0", "3", "R3", "中高风险"], [], []]
    # A piece ends at digits and stop words; 期 is one of them.
    assert [x.terms for x in got] == [["收益率", "稳盈添利"], ["区别", "大额存单", "存款", "定期"], ["T+0", "qdii fund", "r3", "中高风险", "费率"], [], []]


def test_the_four_checks_of_an_answer(spark):
    rows = [
        ("共 3,000 元, 7 天", "价格 3,000 元", ["a"], 1, [("number", "7天")]),
        ("见 [来源: a] 和 [来源：b ]", "", [" a"], 2, [("source", "b")]),
        ("未找到", "", ["a"], 3, [("not_found", "")]),
        ("未找到", "", ["a"], 2, []),
        ("长" * 81, "", ["a"], 1, [("uncited", "")]),
        ("长" * 81, "", [], 0, []),
        ("长" * 81 + "[来源: a]", "", ["a"], 1, []),
        (None, None, None, 0, []),
        ("5 年 5 年", "", [], 0, [("number", "5年"), ("number", "5年")]),
    ]
    d = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, a string, c string, s array<string>, n int")
    got = d.select("i", ck.answer_issues(F.col("a"), F.col("c"), F.col("s"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [[tuple(x) for x in r.x] for r in got] == [r[4] for r in rows]


def test_support_and_leaks(spark):
    d = spark.createDataFrame([("赎回到账时间，一般两天。请问", "赎回到账时间是一般两天"), ("完全不同的内容，另一个", "无"), ("", "x"), (None, None)], "a string, c string")
    got = [r.x for r in d.select(ck.support(ck.answer_terms(F.col("a")), F.col("c")).alias("x")).collect()]
    assert [x.supported for x in got] == [True, False, True, True]
    assert got[1].missing == ["完全不同的内容", "另一个"]
    q = spark.createDataFrame([("买 1,0 00 件", "共 1,000 件, 5 个"), ("几件", "5 件")], "q string, a string")
    assert [r.x for r in q.select(ck.leaked_numbers(F.col("q"), F.col("a")).alias("x")).collect()] == [["1,000"], []]


def test_aliases_are_found_anywhere_in_any_script(spark):
    names = [("大额存单3年期", "大额存单3年期"), ("大额存单", "大额存单3年期"), ("国债", "储蓄国债"), ("存", "存款"), ("QDII", "全球精选"), ("🙂金", "emoji"), ("", "none")]
    n = spark.createDataFrame(names, "alias string, entity string")
    t = spark.createDataFrame([(1, "大额存单和国债哪个好"), (2, "我的QDII大额存单3年期和国债"), (3, "x🙂金y"), (4, None), (5, "")], "id long, text string")
    for most in (1000, 0):
        got = {}
        for r in g.resolve(t, n, broadcast_rows=most).collect():
            got.setdefault(r.id, {})[r.place] = (r.entity, r.alias)
        assert got[1] == {1: ("大额存单3年期", "大额存单"), 2: ("储蓄国债", "国债"), 3: ("存款", "存")}
        assert got[2] == {1: ("大额存单3年期", "大额存单3年期"), 2: ("全球精选", "QDII"), 3: ("储蓄国债", "国债")}
        assert got[3] == {1: ("emoji", "🙂金")} and set(got) == {1, 2, 3}
    assert g.resolve(t, n.limit(0)).count() == 0 and g.resolve(t.limit(0), n).count() == 0


def test_a_thousand_aliases_equal_a_join_by_contains(spark, sf):
    con = duckdb.connect()
    words = [r[0] for r in con.execute(f"SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{{4,7}}')) AS w FROM '{sf}/documents.parquet' ORDER BY 1 LIMIT 1000").fetchall()]
    con.execute("create table n as select w as alias, length(w) || substr(w, 1, 2) as entity from (select unnest($1) as w)", [words])
    want = con.execute(f"""SELECT id, entity, place FROM (SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY -len, alias, entity) AS place FROM (
        SELECT doc_id AS id, entity, max(length(alias)) AS len, arg_min(alias, (-length(alias), alias)) AS alias FROM '{sf}/documents.parquet' JOIN n ON contains(text, alias) GROUP BY 1, 2)) WHERE place <= 3""").fetchall()
    n = spark.createDataFrame([(w, f"{len(w)}{w[:2]}") for w in words], "alias string, entity string")
    got = g.resolve(spark.read.parquet(f"{sf}/documents.parquet"), n, id_col="doc_id").select("doc_id", "entity", "place").collect()
    assert len(words) == 1000 and sorted(map(tuple, got)) == sorted(want)


def test_graph_evidence(spark):
    kind = "head string, relation string, tail string, doc string, note string"
    edges = [("a", "r", "b", "d1", None), ("b", "r", "c", "d2", "n"), ("a", "q", "c2", "d", None), ("x", "owns", "a", "d", None), ("hub", "r", "b", None, None), ("c", "r", "hub", "d", None)]
    e = spark.createDataFrame(edges, kind)
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (2, 1, "c"), (2, 2, "a"), (3, 1, "hub"), (4, 1, "x"), (4, 2, "zz")], "id long, place int, entity string")
    hubs = spark.createDataFrame([("hub",)], "node string")
    rows = g.retrieve(found, e, hubs, labels={"owns": "owns all of"}).orderBy("id", "pos").collect()
    told = {}
    for r in rows:
        told.setdefault(r.id, []).append((r.head, r.relation, r.tail, r.doc, r.origin))
    # The path first, then around both entities; triples of the path aren't given again; inward edges keep their direction.
    assert told[1] == [("a", "r", "b", "d1", "path"), ("b", "r", "c", "d2", "path"), ("a", "q", "c2", "d", "near"), ("x", "owns", "a", "d", "near"), ("c", "r", "hub", "d", "near")]
    assert told[2][:2] == told[1][:2]
    assert 3 not in told and told[4] == [("x", "owns", "a", "d", "near")]
    assert [r.sentence for r in rows if r.id == 4] == ["x owns all of a"]
    many = spark.createDataFrame([("m", f"r{i:02d}", f"t{i}", None, None) for i in range(30)], kind)
    assert g.retrieve(spark.createDataFrame([(1, 1, "m")], "id long, place int, entity string"), many, hubs).count() == 8


def test_shortest_paths_keep_edges_and_enter_no_node_twice(spark):
    grid = [(f"{i},{j}", "r", f"{i + di},{j + dj}") for i in range(6) for j in range(6) for di, dj in ((0, 1), (1, 0), (1, 1))]
    e = spark.createDataFrame([*grid, ("0,0", "a", "0,1"), ("0,1", "back", "0,0")], "head string, relation string, tail string")
    p = spark.createDataFrame([("0,0", "3,3"), ("0,0", "2,1"), ("0,0", "4,4"), ("0,0", "0,0"), (None, "a")], "a string, b string")
    got = {r.b: r for r in g.shortest_paths(e, p, 3).collect()}
    assert {k: r.hops for k, r in got.items()} == {"3,3": 3, "2,1": 2}
    assert got["2,1"].path == ["0,0", "1,0", "2,1"] and [x.relation for x in got["2,1"].edges] == ["r", "r"]


def test_verbalised_neighbours_keep_their_direction(spark):
    e = spark.createDataFrame([("A", "owns", "B")], "head string, relation string, tail string")
    n = spark.createDataFrame([("A",), ("B",)], "node string")
    assert {r.node: r.sentence for r in g.verbalise(g.neighbours(e, n), {}).collect()} == {"A": "A owns B", "B": "A owns B"}
