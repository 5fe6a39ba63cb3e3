"""Service data: percentiles, service levels, bad cases, catalog and subscription checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import service as sv
from marlstone.plans.registry import plan
from marlstone.session import table

_AT = "list_sort(list({v}) FILTER ({v} IS NOT NULL))[1 + CAST(least(count({v}) - 1, floor(count({v}) * {p}::DOUBLE)) AS INT)]"


def _at(v: str, **ps: float) -> str:
    return ", ".join(f"{_AT.format(v=v, p=p)} AS {n}" for n, p in ps.items())


@plan("a5_sli_by_hour", f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(avg(value), 6) AS mean,
{_at('value', p50=0.5, p90=0.9, p99=0.99)} FROM events GROUP BY 1""")
def sli_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and percentiles of every hour."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("HOUR", "ts").alias("hour"), "event_type", "value")
    sums = e.groupBy("hour").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("ok"), F.round(F.avg("value"), 6).alias("mean"))
    found = sv.floor_percentiles(e, ["hour"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).withColumnRenamed("hour", "of")
    return sums.join(found, sums["hour"].eqNullSafe(found["of"]), "left").drop("of")  # events without a time are an hour of their own


@plan("a6_percentile_floor_index", f"SELECT event_type, {_at('value', p95=0.95)} FROM events GROUP BY event_type")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by floor index of every event type."""
    return sv.floor_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p95": 0.95})


@plan("a23_endpoint_latency", f"SELECT event_type, count(*) AS n, {_at('value', p50=0.5, p90=0.9, p95=0.95, p99=0.99)}, max(value) AS hi FROM events GROUP BY event_type HAVING count(*) >= 5")
def endpoint_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency table of the event types with five events or more."""
    e = table(spark, sf_dir, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("hi")).filter("n >= 5")
    return n.join(sv.floor_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}), "event_type")


def _sli_oracle() -> str:
    kinds = {"": ("ms", "NOT stream"), "stream_ttfb_": ("ttfb", "stream"), "stream_total_": ("ms", "stream")}
    cols = [f"trunc(CASE WHEN {when} THEN {v} END)::BIGINT AS {k or 'plain_'}v" for k, (v, when) in kinds.items()]
    names = ", ".join(_at(f"{k or 'plain_'}v", **{f"{k}{p}_ms": x for p, x in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))}) for k in kinds)
    return f"""
WITH e AS (SELECT *, event_type = 'view' AS stream, event_type = 'error' AND event_id % 3 = 0 AS late, (event_type = 'error' AND event_id % 3 <> 0) OR (event_type = 'view' AND value < 5) AS bad,
  value * 10 AS ms, CASE WHEN value > 1 THEN value * 2.5 END AS ttfb FROM events WHERE ts <= TIMESTAMP '2024-01-30 23:59:00'),
r AS (SELECT *, {', '.join(cols)} FROM e)
SELECT 720 AS buckets, count(*) AS total, round(count(*) / (719 * 3600.0 + 59 * 60)::DOUBLE, 9) AS qps, round(count(*) FILTER (WHERE NOT late AND NOT bad) / count(*)::DOUBLE, 9) AS success_rate,
  round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 9) AS error_rate, round(count(*) FILTER (WHERE late) / count(*)::DOUBLE, 9) AS timeout_rate,
  round(count(*) FILTER (WHERE event_type = 'click') / count(*)::DOUBLE, 9) AS cache_hit_rate, round(avg(plain_v), 6) AS avg_ms, count(plain_v) AS samples, count(*) FILTER (WHERE stream) AS stream_cnt,
  count(*) FILTER (WHERE stream AND bad) AS stream_errors, count(stream_total_v) AS stream_samples, {names} FROM r"""


@plan("a5_sli_snapshot", _sli_oracle())
def sli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service levels over all hours of the events: views are streams, errors time out or fail, clicks hit the cache."""
    kind = F.col("event_type")
    status = F.when(kind != "error", 200).when(F.col("event_id") % 3 == 0, 504).otherwise(500)
    e = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("at"), (kind == "view").alias("stream"), status.alias("status"), (F.col("value") >= 5).alias("ok"), (kind == "click").alias("cache_hit"),
        (F.col("value") * 10).alias("ms"), F.when(F.col("value") > 1, F.col("value") * 2.5).alias("ttfb_ms"),
    )
    s = sv.sli_snapshot(e, datetime(2024, 1, 30, 23, 59), 720)
    return s.withColumns({c: F.round(c, 9) for c in s.columns if c.endswith("_rate") or c == "qps"}).withColumn("avg_ms", F.round("avg_ms", 6))


_VIEW = """
WITH t AS (SELECT doc_id AS trace_id, m.rating, CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END AS intent, n_chars < 200 AS bare, source = 'src1' AND lang = 'de' AS reject, n_chars % 100 < 50 AS unsure
  FROM documents LEFT JOIN (SELECT doc_id, min(2 * quality - 1) AS rating FROM labels GROUP BY doc_id) m USING (doc_id)),
v AS (SELECT trace_id, rating, concat_ws(',', CASE WHEN rating = -1 THEN 'downvote' END, CASE WHEN coalesce(intent, '') IN ('unknown', '') THEN 'unknown_intent' END, CASE WHEN bare THEN 'empty_retrieval' END,
  CASE WHEN reject THEN 'reject' END, CASE WHEN unsure THEN 'low_confidence' END) AS reasons, CASE WHEN bare THEN 0 ELSE 1 END AS sources_n FROM t
  WHERE coalesce(rating = -1, false) OR coalesce(intent IN ('unknown', ''), false) OR coalesce(bare, false) OR coalesce(reject, false) OR coalesce(unsure, false))"""


def _badcases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as traces, labels as feedback."""
    d = table(spark, sf_dir, "documents")
    traces = d.select(
        F.col("doc_id").alias("trace_id"), F.when(F.col("lang") == "es", "unknown").otherwise(F.col("lang")).alias("intent"),
        F.when(F.col("n_chars") < 200, "[]").otherwise(F.to_json(F.array("source"))).alias("sources"),
        F.when((F.col("source") == "src1") & (F.col("lang") == "de"), "reject").otherwise("pass").alias("verdict"), (F.col("n_chars") % 100 / 100).alias("confidence"),
    )
    votes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("trace_id"), (2 * F.col("quality") - 1).alias("rating"))
    return sv.badcases(traces, votes)


@plan("a8_badcase_view", _VIEW + " SELECT * FROM v")
def badcase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad cases with rating, reasons and number of sources."""
    return _badcases(spark, sf_dir).select("trace_id", "rating", F.array_join("reasons", ",").alias("reasons"), "sources_n")


@plan("p7_badcase_predicate", _VIEW + " SELECT trace_id FROM v")
def badcase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that any of the five conditions marks."""
    return _badcases(spark, sf_dir).select("trace_id")


@plan("a9_reason_counts", _VIEW + " SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM v) x GROUP BY reason")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bad cases each reason has."""
    return _badcases(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: risk by size, none for sizes divisible by 7."""
    risk = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("r"), (F.col("p_size") % 5 + 1).cast("string")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), risk.alias("risk"), (F.col("p_retailprice") * 30).alias("min_amount"))


_RISK = "CASE WHEN p_size % 7 <> 0 THEN p_size % 5 + 1 ELSE 5 END"


@plan("p2_product_filter", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_type AS type FROM part WHERE p_type LIKE '%A%' AND p_size % 7 <> 0 AND p_size % 5 = 2 AND (p_name LIKE '%ring%' OR p_type LIKE '%ring%')")
def product_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose type holds A, of class R3, with ring in name or type."""
    return sv.filter_products(_catalog(spark, sf_dir), "A", "R3", "ring").select("id", "name", "type")


_WANTED = ("17", "ring", "blue bolt", "small", "nothing")


@plan("p3_product_lookup", f"""SELECT w AS wanted, p_partkey::VARCHAR AS id, p_name AS name FROM (SELECT unnest({list(_WANTED)}) AS w) x JOIN part ON p_partkey::VARCHAR = w OR contains(p_name, w)
QUALIFY row_number() OVER (PARTITION BY w ORDER BY p_partkey) = 1""")
def product_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first product of each text by id or part of the name."""
    return sv.find_products(_catalog(spark, sf_dir), _WANTED)


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return line.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("R"), (F.col("c_custkey") % 5 + 1).cast("string")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), level.alias("level"), (F.col("c_custkey") % 4 + 1).cast("string").alias("verify_code"))


_LEVEL = "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey % 5 + 1 END"


@plan("p4_suitability", f"""SELECT DISTINCT c_custkey AS user_id, p_partkey::VARCHAR AS product_id, CASE WHEN {_LEVEL} IS NULL THEN 'no_level' WHEN {_LEVEL} >= {_RISK} THEN 'ok' ELSE 'handoff' END AS verdict
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey""")
def suitable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's level allows each product bought."""
    pairs = _bought(spark, sf_dir).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").cast("string").alias("id")).distinct()
    j = pairs.join(_profiles(spark, sf_dir), "user_id").join(_catalog(spark, sf_dir), "id")
    return j.select("user_id", F.col("id").alias("product_id"), sv.suitability(F.col("level"), F.col("risk"), F.lit(True)).alias("verdict"))


@plan("p5_subscription_gate", f"""
WITH h AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, CASE WHEN o.o_orderstatus = 'P' THEN 'login' WHEN p_partkey IS NULL THEN 'product' WHEN {_LEVEL} < {_RISK} THEN 'suitability' WHEN l_tax < 0.01 THEN 'amount'
  WHEN l_extendedprice < p_retailprice * 30 THEN 'below_minimum' WHEN c_custkey IS NULL OR l_linenumber <> c_custkey % 4 + 1 THEN 'code' WHEN h.l_partkey IS NOT NULL THEN 'held' ELSE 'ok' END AS gate
FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l.l_partkey AND p_partkey % 10 <> 0
LEFT JOIN h ON h.o_custkey = o.o_custkey AND h.l_partkey = l.l_partkey""")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of every order line as a subscription; returned lines are what the customer holds."""
    b = _bought(spark, sf_dir)
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    product = F.col("l_partkey").cast("string").alias("product_id")
    asked = b.join(status, "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("user_id"), product,
        F.when(F.col("l_tax") >= 0.01, F.col("l_extendedprice")).alias("amount"), F.col("l_linenumber").cast("string").alias("code"))
    catalog = _catalog(spark, sf_dir).filter("pos % 10 <> 0").withColumnRenamed("id", "product_id")
    held = b.filter("l_returnflag = 'R'").select(F.col("o_custkey").alias("user_id"), product)
    return sv.subscription_gate(asked, _profiles(spark, sf_dir), catalog, held).select("l_orderkey", "l_linenumber", "gate")


@plan("a7_percentile_linear", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile, interpolated, with mean and extremes of each event type."""
    e = table(spark, sf_dir, "events")
    ps = sv.linear_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    rest = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return rest.join(ps, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean", "lo", "hi")
