"""Histories of keys: versions, streaks, topics, carried values and buffers, none of which needs a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordering import last_of, sequence


def version_chain(rows: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    """group, order, version (from 1), prev (the order of the version before): rows whose content differs from the one before.

    A null content is a content like any other.
    """
    seen = sequence(rows.select(group, order, content.alias("__h")), [group], [F.col(order)], __was=("lag", F.struct(F.col("__h").alias("h"))))
    new = seen.filter(F.col("__was").isNull() | ~F.col("__h").eqNullSafe(F.col("__was.h"))).select(group, order)
    return sequence(new, [group], [F.col(order)], prev=("lag", F.col(order))).select(group, order, (F.col("pos") + 1).alias("version"), "prev")


def streaks(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """rows with streak: hits in a row up to here, 0 where this is none (or null)."""
    bad = F.coalesce(hit, F.lit(False))
    first = sequence(rows.withColumn("__hit", bad), [key], [F.col(order)]).withColumnRenamed("pos", "__p")
    out = sequence(first, [key], [F.col(order)], __reset=("max", F.when(~F.col("__hit"), F.col("__p"))))
    return out.withColumn("streak", F.col("__p") - F.coalesce("__reset", F.lit(-1))).select(*rows.columns, "streak")


def turns_in_topic(rows: DataFrame, key: str, order: str, topic: str) -> DataFrame:
    """rows with turn_count: turns of the topic in a row up to here, from 1 at every change; null is a topic of its own."""
    first = sequence(rows, [key], [F.col(order)], __was=("lag", F.struct(F.col(topic).alias("t")))).withColumnRenamed("pos", "__p")
    new = F.col("__was").isNull() | ~F.col(topic).eqNullSafe(F.col("__was.t"))
    out = sequence(first, [key], [F.col(order)], __start=("max", F.when(new, F.col("__p"))))
    return out.withColumn("turn_count", F.col("__p") - F.col("__start") + 1).select(*rows.columns, "turn_count")


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with name: the last value that wasn't null up to here."""
    return sequence(rows, [key], [F.col(order)], **{name: ("last", value)}).drop("pos")


def positions(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with position, from 1, in their list, in ascending order."""
    return sequence(rows, [group], list(order)).withColumn("position", F.col("pos") + 1).drop("pos")


def first_seen(rows: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """key, value, first_seen: the n values of each key that came up last for the first time."""
    each = rows.groupBy(key, value).agg(F.min(order).alias("first_seen"))
    return last_of(each, [key], n, F.desc("first_seen"), F.col(value))


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows that come last in the order given."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def hour_buckets(rows: DataFrame, at: str, first: str, hours: int) -> DataFrame:
    """hour, n of each of `hours` hours from first on, hours without rows included."""
    slots = rows.sparkSession.range(hours).select(F.expr(f"TIMESTAMP_NTZ '{first}' + make_dt_interval(0, CAST(id AS INT))").alias("hour"))
    per = rows.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return slots.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))
