"""Queues, reviews, states, themes and lists over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import policies as po
from marlstone.operators.ordering import last_of
from marlstone.operators.retrieval import expand_parents, ranked
from marlstone.plans.registry import plan
from marlstone.session import table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@plan("p11_low_confidence_queue", """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'evidence_missing' WHEN event_type = 'signup' THEN 'chunk_missing' ELSE 'low_confidence' END AS reason,
CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END AS severity FROM events WHERE event_type IN ('error', 'signup') OR value / 100 < 0.3""")
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases that need a look, gravest first."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("confidence"), (F.col("event_type") != "error").alias("evidence_covered"), (F.col("event_type") != "signup").alias("chunk_info_hit"))
    return po.low_confidence_queue(e, 0.3).select("id", "reason", "severity")


@plan("p14_review_policy", """WITH x AS (SELECT event_id, ['pass', 'flag', 'reject'][1 + event_id % 3] AS v, ['chitchat', 'fee_rule', 'complaint', 'income_question'][1 + user_id % 4] AS i, CASE WHEN event_id % 7 = 0 THEN 'subscribe_node' ELSE event_type END AS s, event_id % 4 AS n FROM events)
SELECT event_id, v = 'pass' OR i IN ('chitchat', 'complaint') OR s = 'subscribe_node' AS skips, CASE WHEN v = 'reject' AND n < 2 THEN 'regenerate_node' ELSE 'formatter_node' END AS next_node FROM x""")
def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers are reviewed, and what follows."""
    e = _t(spark, sf_dir, "events")
    pick = lambda values, k: F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    v, i = pick(("pass", "flag", "reject"), F.col("event_id") % 3), pick(("chitchat", "fee_rule", "complaint", "income_question"), F.col("user_id") % 4)
    s = F.when(F.col("event_id") % 7 == 0, "subscribe_node").otherwise(F.col("event_type"))
    return e.select("event_id", po.skips_review(v, i, s).alias("skips"), po.after_review(v, F.col("event_id") % 4).alias("next_node"))


@plan("p15_agent_dispatch", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'finance_node' WHEN 'error' THEN 'handoff_node' WHEN 'click' THEN 'chitchat_node' ELSE 'general_node' END AS node FROM events")
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that answers each event's intent."""
    intent = F.when(F.col("event_type") == "purchase", "buy_process").when(F.col("event_type") == "error", "complaint").when(F.col("event_type") == "click", "chitchat")
    return _t(spark, sf_dir, "events").select("event_id", po.node_of(intent).alias("node"))


@plan("p16_task_state", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'failed' ELSE 'failed' END AS state FROM events""")
def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of tasks from what their workers say."""
    said = F.get(F.array(*[F.lit(s) for s in (" Progress ", "COMPLETED", "revoked", "received", "view", None)]), (F.col("event_id") % 6).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", po.task_state(said).alias("state"))


@plan("p18_evidence_format", """SELECT l_orderkey, string_agg('- ' || substr('part ' || l_partkey || ' of ' || l_quantity::BIGINT, 1, 9) || ' [来源: ' || CASE WHEN l_suppkey % 4 = 0 THEN '未知' ELSE 'S' || l_suppkey % 4 END || ']', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines,
count(DISTINCT CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey % 4 END) AS n_sources FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) x GROUP BY l_orderkey""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as evidence with their sources; lines that share a number are left out."""
    i = _t(spark, sf_dir, "lineitem")
    once = i.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first(F.struct("l_partkey", "l_quantity", "l_suppkey")).alias("x")).filter("n = 1")
    content = F.concat(F.lit("part "), F.col("x.l_partkey").cast("string"), F.lit(" of "), F.col("x.l_quantity").cast("long").cast("string"))
    source = F.when(F.col("x.l_suppkey") % 4 != 0, F.concat(F.lit("S"), (F.col("x.l_suppkey") % 4).cast("string")))
    out = po.evidence_lines(once.select("l_orderkey", "l_linenumber", content.alias("content"), source.alias("source")), "l_orderkey", "l_linenumber", chars=9)
    return out.select("l_orderkey", F.array_join("lines", "\n").alias("lines"), F.size("sources").cast("long").alias("n_sources"))


@plan("p19_trust_badge", "SELECT event_id, ['low', 'medium', 'high'][1 + (value >= 50)::INT + (value >= 80)::INT] AS badge FROM events")
def badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badges of events by value."""
    return _t(spark, sf_dir, "events").select("event_id", po.badge(F.col("value")).alias("badge"))


@plan("p21_legacy_review", """SELECT event_id, CASE WHEN event_type = 'purchase' OR (value >= 85 AND event_id % 2 = 0) THEN 'skip' WHEN event_type <> 'error' THEN 'reviewed' WHEN event_id % 4 < 2 THEN 'retry' ELSE 'exhausted' END AS outcome,
CASE WHEN event_type = 'purchase' OR (value >= 85 AND event_id % 2 = 0) THEN 85.0 WHEN event_type = 'error' AND event_id % 4 >= 2 THEN least(value, 40.0) ELSE value END::DOUBLE AS score FROM events""")
def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and scores of the older review policy."""
    t = F.col("event_type")
    quick = F.when(F.col("event_id") % 2 == 0, "pass").otherwise("flag")
    x = po.review_outcome(F.col("value") / 100, quick, t == "purchase", t == "error", F.col("event_id") % 4, F.col("value"))
    return _t(spark, sf_dir, "events").select("event_id", x.alias("x")).select("event_id", "x.outcome", "x.score")


_HITS = "h AS (SELECT conv_id AS id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, role, lower(substr(text, 1, 200)) AS t FROM conversations)"


@plan("a25_theme_vote", f"""WITH {_HITS}, m AS (SELECT id, rank, CASE WHEN role = 'system' OR contains(t, 'in ') THEN 'one' WHEN contains(t, 'er') THEN 'two' END AS theme FROM h WHERE rank <= 3),
v AS (SELECT id, theme, count(*) AS n FROM m WHERE theme IS NOT NULL GROUP BY id, theme QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(rank)) = 1)
SELECT c.id, coalesce(v.n >= 2 AND c.id % 2 = 0 AND theme <> 'two', false) AS adjusted, CASE WHEN coalesce(v.n >= 2 AND c.id % 2 = 0 AND theme <> 'two', false) THEN theme ELSE 'two' END AS intent FROM (SELECT DISTINCT conv_id AS id FROM conversations) c LEFT JOIN v ON v.id = c.id""")
def theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of conversations, where the first three turns agree on another theme replaced by it."""
    c = _t(spark, sf_dir, "conversations")
    cases = c.select(F.col("conv_id").alias("id")).distinct().withColumn("intent", F.lit("two")).withColumn("confidence", F.when(F.col("id") % 2 == 0, 0.5).otherwise(0.9))
    hits = last_of(c, ["conv_id"], 3, F.col("turn"))
    rank = c.select("conv_id", "turn").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ts"))
    hits = hits.join(rank, "conv_id").select(F.col("conv_id").alias("id"), F.array_position("ts", F.col("turn")).alias("rank"), F.col("role").alias("source"), "text")
    return po.consistent_intent(cases, hits, (("one", ("system", "in ")), ("two", ("er",)))).select("id", "intent", "adjusted")


@plan("j4_child_parent", """SELECT l_suppkey AS qid, l_orderkey // 4 AS cid, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(rank)) AS rank FROM (
SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_orderkey) AS rank FROM lineitem GROUP BY l_suppkey, l_orderkey QUALIFY rank <= 20) x GROUP BY l_suppkey, l_orderkey // 4""")
def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders of each supplier, given way to by groups of four, once each."""
    i = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("cid")).agg(F.max("l_extendedprice").alias("score"))
    up = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cid"), F.floor(F.col("l_orderkey") / 4).cast("long").alias("parent")).distinct()
    return expand_parents(ranked(i, 20), up).select("qid", "cid", "rank")


@plan("j11_evidence_hashes", """SELECT l_orderkey AS id, count(*) FILTER (WHERE p % 5 = 0) AS missing, count(*) FILTER (WHERE p % 5 <> 0 AND p % 3 = 0) AS stale, count(*) FILTER (WHERE p % 5 <> 0 AND p % 3 <> 0) AS ok
FROM (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) x GROUP BY l_orderkey""")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's parts as evidence, how many are gone, changed, or as they were."""
    part = F.col("l_partkey")
    golden = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(part, F.md5(part.cast("string").cast("binary"))))).alias("hashes"))
    p = F.col("p_partkey")
    now = _t(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(p.alias("chunk"), F.md5(F.when(p % 3 == 0, F.concat(p.cast("string"), F.lit("!"))).otherwise(p.cast("string")).cast("binary")).alias("hash"))
    return po.evidence_states(golden, now)


@plan("j12_report_compare", """WITH r AS (SELECT o_custkey AS id, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS b,
 count(*) FILTER (WHERE o_orderkey % 2 = 0) AS c, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS d FROM orders GROUP BY o_custkey HAVING c > 0 AND d > 0)
SELECT id, 'price' AS metric, CASE WHEN a = b THEN 'same' WHEN b > a THEN 'better' ELSE 'worse' END AS verdict FROM r UNION ALL SELECT id, 'orders', CASE WHEN c = d THEN 'same' WHEN d > c THEN 'better' ELSE 'worse' END FROM r""")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports on customers compared metric by metric."""
    o = _t(spark, sf_dir, "orders")
    half = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("price"), F.count("*").alias("orders"))
    return po.compared(half(0), half(1), ("price", "orders"))


@plan("l5_diverse_top_k", """WITH c AS (SELECT user_id, event_id, event_type, value, event_id % 3 = 0 AS noted, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1 AND value > 0 AS first FROM events)
SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY first DESC, value DESC, event_id) AS place FROM c WHERE first OR noted QUALIFY place <= 8""")
def diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events of each user, the best of each kind first, then noted ones."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.col("event_type").alias("intent"), F.col("value").alias("score"), F.when(F.col("event_id") % 3 == 0, "noted").alias("note"))
    return po.diverse_top(e, 8)


@plan("l6_first_per_group", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 4")
def first_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four events of each kind."""
    return last_of(_t(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], 4, F.col("event_id"))


@plan("l7_multi_query_merge", "SELECT user_id AS cid, max(value) AS score, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 8")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight users by their best event over all events."""
    return po.merged(_t(spark, sf_dir, "events").select(F.col("event_id").alias("qid"), F.col("user_id").alias("cid"), F.col("value").alias("score")), 8)
