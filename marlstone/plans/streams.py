"""Batch twins of the streaming operators over events and conversations, so that SQL can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.rules import FIXTURE as LEX
from marlstone.functions.rules import fallback_intent, slots
from marlstone.functions.text import any_of
from marlstone.plans.registry import plan
from marlstone.session import table
from marlstone.streaming import service as st


@plan("m1_hourly_metrics", "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean, max(value) AS hi FROM events GROUP BY 1")
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counters and latency."""
    return st.windowed(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 6))


@plan("m2_sliding_day", """SELECT s::TIMESTAMP AS start, count(*) AS total, round(avg(value), 6) AS mean FROM (
SELECT value, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events) x GROUP BY 1""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 hours, every hour."""
    return st.windowed(table(spark, sf_dir, "events"), "24 hours", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "total", F.round("mean", 6).alias("mean"))


@plan("m3_dialog_state")
def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialog state after each turn; turns come ever more slowly, and a session that was silent for half an hour begins anew."""
    t = table(spark, sf_dir, "conversations").withColumn("at", F.timestamp_seconds(F.col("turn") * F.col("turn") * 300))
    x = F.col("text")
    return st.dialog_state(t.select("conv_id", "at", "turn", fallback_intent(x, LEX)["intent"].alias("intent"), slots(x, LEX)["product"].alias("product"), any_of(x, LEX.complaint + LEX.anxiety).alias("negative")))


@plan("m4_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS stop, count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with a gap of 30 minutes."""
    return st.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


@plan("m5_ttl", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 01:00:00'")
def ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are an hour old at most."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").cast("double").alias("created"))
    return st.live_entries(e, F.lit("2024-01-15 01:00:00").cast("timestamp").cast("double")).select("event_id")


@plan("m6_version_invalidation", "SELECT doc_id FROM documents WHERE doc_id % 3 = 2")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the current version; the other two thirds are stale."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).cast("string").alias("version"), F.lit(0).alias("created"))
    return st.live_entries(d, F.lit(0), version="2").select("doc_id")


@plan("m8_stream_split", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) FILTER (WHERE event_type <> 'view') AS n, round(avg(value) FILTER (WHERE event_type <> 'view'), 6) AS mean, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS first_mean FROM events GROUP BY 1")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed requests apart from the rest."""
    return st.stream_split(table(spark, sf_dir, "events"), F.col("event_type") == "view").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("mean", 6).alias("mean"), F.round("first_mean", 6).alias("first_mean"))


@plan("m9_circuit_breaker")
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker of each user after each event."""
    e = table(spark, sf_dir, "events")
    return st.circuit_breaker(e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (F.col("event_type") == "error").alias("failed")).withColumn("at", F.col("us") / 1e6), 2, 3600.0, 1)


@plan("x1_tool_audit", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'allow' ELSE 'deny' END AS decision FROM events")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a tool registry."""
    return st.audited(table(spark, sf_dir, "events"), ("view", "click")).select("event_id", "decision")
