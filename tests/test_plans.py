"""Every plan with SQL of its own against DuckDB, and the shape of all others."""

import datetime
import math

import duckdb
import pytest

from marlstone import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(v):
    """A value as comparable text; floats by six significant digits."""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(told, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{told(x)}" for k, x in v.items()) + "}"
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_plan_equals_its_sql(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted("|".join(told(r[i]) for i in at) for r in cur.fetchall())
    assert sorted("|".join(told(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_plan_without_sql_runs_and_agrees_with_itself(spark, sf, name):
    a, b = (sorted("|".join(told(r[c]) for c in r.asDict()) for r in plans.QUERIES[name](spark, sf).collect()) for _ in range(2))
    assert a == b


def test_ten_last_interests_of_each_user_are_kept(spark, tmp_path):
    """One user has twelve kinds of events, two of them seen again at the end; the other has four."""
    seen = [(1, f"k{i}") for i in range(12)] + [(2, f"k{i}") for i in range(4)] + [(1, "k0"), (1, "k5")]
    rows = [(i, u, k) for i, (u, k) in enumerate(seen)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = [(1, f"k{i}", i) for i in range(2, 12)] + [(2, f"k{i}", 12 + i) for i in range(4)]
    got = plans.QUERIES["w4_distinct_interests"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(plans.ORACLES["w4_distinct_interests"]).fetchall()) == sorted(want)


def test_every_customer_gets_their_own_orders(spark, tmp_path):
    """Customers of three segments, one null, one customer twice and one without orders; orders of nobody and of others."""
    users = [(1, "BUILDING"), (2, "MACHINERY"), (3, None), (4, "BUILDING"), (2, "MACHINERY"), (None, "BUILDING")]
    orders = [(10, 1, 1.5), (11, 2, 2.5), (12, 3, 3.5), (13, 9, 4.5), (14, None, 5.5), (15, 1, None)]
    spark.createDataFrame(users, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(1, 10, 1.5), (1, 15, None), (2, 11, 2.5), (2, 11, 2.5), (3, 12, 3.5)]
    got = plans.QUERIES["j14_user_scope"](spark, str(tmp_path))
    assert got.columns == ["c_custkey", "o_orderkey", "o_totalprice"]
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(plans.ORACLES["j14_user_scope"]).fetchall()) == want


def test_words_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Null and blank texts, no ASCII word, runs of CJK characters between words, and capitals that lose or keep a dot."""
    texts = [None, "", " ", "!!", "中文 text", "中", "中文中 abc中文", "ΑΣ", "İstanbul x", "K", "a_b-C9", "é1éx"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [None, None, None, None, "text", None, "abc", None, "istanbul x", "k", "a_b c9", "1 x"]
    want = [(i, None if t is None else len((w or "").split()), w) for i, (t, w) in enumerate(zip(texts, want, strict=True))]
    got = plans.QUERIES["f1_tokens"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "tokens"]
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(plans.ORACLES["f1_tokens"]).fetchall()) == want


def test_service_levels_of_events_without_a_time_are_those_of_the_sql(spark, tmp_path):
    """An hour with values, one without any, and events without a time, type or value."""
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [(at(1, 5), "view", 1.25), (at(1, 59), "error", 2.5), (at(1, 0), None, None), (at(2, 0), "view", None), (None, "view", 4.0), (None, "error", 8.0), (None, None, 6.0)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {(None, 3, 1, 6.0, 6.0, 8.0, 8.0), (at(1, 0), 3, 1, 1.875, 2.5, 2.5, 2.5), (at(2, 0), 1, 1, None, None, None, None)}
    cols = ["hour", "total", "ok", "mean", "p50", "p90", "p99"]
    got = plans.QUERIES["a5_sli_by_hour"](spark, str(tmp_path))
    assert got.columns == cols
    assert set(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select ts::timestamp AS ts, event_type, value from '{tmp_path}/events.parquet/*.parquet'")
    assert set(con.execute(f"SELECT {', '.join(cols)} FROM ({plans.ORACLES['a5_sli_by_hour']})").fetchall()) == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "cid", "score"]
