"""Histories of documents, turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import history as hi
from marlstone.operators import lifecycle as lc
from marlstone.operators.ordering import last_of
from marlstone.plans.registry import plan
from marlstone.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@plan("w1_latest_version", "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each source."""
    return lc.latest(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@plan("w2_version_chain", """SELECT source, doc_id, row_number() OVER w AS version, lag(doc_id) OVER w AS prev_id FROM (
SELECT source, doc_id, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS ph FROM documents) x WHERE ph IS NULL OR h <> ph WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each source: documents whose text isn't that of the one before."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return hi.version_chain(d, "source", "doc_id", F.col("h")).withColumnRenamed("prev", "prev_id")


@plan("w3_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five turns of each conversation."""
    return last_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], 5, F.desc("turn"))


@plan("w4_distinct_interests", """SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY min(event_id) DESC) <= 10""")
def interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten kinds of events of each user that came up last for the first time."""
    return hi.first_seen(_events(spark, sf_dir), "user_id", "event_type", "event_id", 10)


@plan("w5_negative_streak", """WITH f AS (SELECT user_id, event_id, (event_type = 'error')::INT AS bad FROM events), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM f)
SELECT user_id, event_id, sum(bad) OVER (PARTITION BY user_id, grp ORDER BY event_id)::BIGINT AS negative_turns FROM g""")
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in a row of each user."""
    out = hi.streaks(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")
    return out.select("user_id", "event_id", F.col("streak").alias("negative_turns"))


@plan("w6_turns_in_topic", """WITH f AS (SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), true)::INT AS switched FROM events),
g AS (SELECT *, sum(switched) OVER (PARTITION BY user_id ORDER BY event_id) AS topic FROM f) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, topic ORDER BY event_id) AS turn_count FROM g""")
def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one kind in a row of each user."""
    return hi.turns_in_topic(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", "turn_count")


@plan("w7_slot_carry", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS slot FROM events")
def carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each user's last purchase."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    return hi.carried(e, "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "slot").select("user_id", "event_id", "slot")


@plan("w8_list_position", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS position FROM events")
def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of events by value among those of their kind."""
    return hi.positions(_events(spark, sf_dir).select("event_type", "event_id", "value"), "event_type", -F.col("value"), F.col("event_id")).select("event_type", "event_id", "position")


@plan("w9_lru", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest events: what a bounded cache keeps."""
    return hi.newest(_events(spark, sf_dir), 500, "ts", "event_id").select("event_id")


@plan("w10_hour_buckets", """WITH f AS (SELECT min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events),
h AS (SELECT unnest(range(lo, hi + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM f)
SELECT h.hour::TIMESTAMP AS hour, count(e.event_id) AS n FROM h LEFT JOIN events e ON date_trunc('hour', e.ts) = h.hour GROUP BY h.hour""")
def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every hour from the first to the last, hours without any included."""
    e = _events(spark, sf_dir)
    r = e.agg(F.date_trunc("hour", F.min("ts")).cast("string").alias("lo"), (F.timestamp_diff("HOUR", F.date_trunc("hour", F.min("ts")), F.date_trunc("hour", F.max("ts"))) + 1).alias("n")).first()
    return hi.hour_buckets(e, "ts", r.lo, r.n)


@plan("w11_sample_cap", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) <= 200")
def cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest samples of each day: the rest of a bucket goes."""
    e = _events(spark, sf_dir).select("event_id", "ts", F.date_trunc("day", "ts").alias("day"))
    return last_of(e, ["day"], 200, F.desc("ts"), F.desc("event_id")).select("event_id")


@plan("w12_ring_buffer", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 500")
def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 errors."""
    return hi.newest(_events(spark, sf_dir).filter("event_type = 'error'").select("event_id", "event_type"), 500, "event_id")
