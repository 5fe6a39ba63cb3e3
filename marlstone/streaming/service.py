"""Structured Streaming over service events: windowed metrics, sessions, per-key state machines.

Every function takes and returns DataFrames, streaming or not; the caller starts the query. State is keyed, and
event time bounds it by a watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import ship

#: Turns and topics that a session's state holds at most.
HISTORY, TOPICS = 10, 5


def stamped(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """events with ts as a timestamp and, on a stream, a watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late) if e.isStreaming else e


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, failed: Column | None = None, ts: str = "ts") -> DataFrame:
    """start, total, errors, mean, hi of each tumbling or sliding window."""
    bad = failed if failed is not None else F.col("event_type") == "error"
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stamped(events, ts).groupBy(w.alias("w")).agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"), F.avg("value").alias("mean"), F.max("value").alias("hi"))
    return g.select(F.col("w.start").alias("start"), "total", "errors", "mean", "hi")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """key, start, stop, n of sessions that end after a gap."""
    g = stamped(events, ts).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def stream_split(events: DataFrame, streamed: Column, ts: str = "ts") -> DataFrame:
    """hour, n, mean, first_mean: streamed requests count apart, so they don't blur overall latency."""
    g = stamped(events, ts).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count_if(~streamed).alias("n"), F.avg(F.when(~streamed, F.col("value"))).alias("mean"), F.avg(F.when(streamed, F.col("value"))).alias("first_mean"))
    return g.select(F.col("w.start").alias("hour"), "n", "mean", "first_mean")


def breaker_steps(state: tuple, rows: Iterable[tuple[float, bool]], threshold: int, timeout: float, probes: int) -> tuple[tuple, list[str]]:
    """A circuit breaker over (seconds, failed) in order: closed, open after `threshold` failures in a row, half open
    after `timeout` seconds, closed again after `probes` successes. state: (mode, failures, since, good)."""
    mode, failures, since, good = state
    seen = []
    for at, failed in rows:
        if mode == "open" and at - since >= timeout:
            mode, good = "half_open", 0
        if mode != "open":
            if failed:
                failures += 1
                if mode == "half_open" or failures >= threshold:
                    mode, since, failures = "open", at, 0
            elif mode == "half_open":
                good += 1
                if good >= probes:
                    mode, failures = "closed", 0
            else:
                failures = 0
        seen.append(mode)
    return (mode, failures, since, good), seen


def circuit_breaker(events: DataFrame, threshold: int = 5, timeout: float = 30.0, probes: int = 2, key: str = "user_id") -> DataFrame:
    """key, event_id, mode after each event (key, event_id, at seconds, failed).

    On a stream the state of each key is kept across batches; in batch each key's events are one ordered group.
    """
    ship(events.sparkSession)
    rows = events.select(F.col(key).cast("long").alias("key"), "event_id", "at", "failed")
    out = "key long, event_id long, mode string"

    def frame(k: int, f: pd.DataFrame, seen: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"key": k, "event_id": f["event_id"].to_numpy(), "mode": seen})

    if events.isStreaming:

        def on(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            f = pd.concat(list(frames)).sort_values(["at", "event_id"])
            new, seen = breaker_steps(state.get if state.exists else ("closed", 0, 0.0, 0), zip(f["at"], f["failed"], strict=True), threshold, timeout, probes)
            state.update(new)
            yield frame(k[0], f, seen)

        done = rows.groupBy("key").applyInPandasWithState(on, out, "mode string, failures int, since double, good int", "append", "NoTimeout")
    else:

        def whole(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["at", "event_id"])
            return frame(f["key"].iloc[0], f, breaker_steps(("closed", 0, 0.0, 0), zip(f["at"], f["failed"], strict=True), threshold, timeout, probes)[1])

        done = rows.groupBy("key").applyInPandas(whole, out)
    return done.withColumnRenamed("key", key)


#: The state of a session before its first turn; last, when its last turn was.
FRESH = ("", "", 0, 0, "", "", -1)


def dialog_steps(state: tuple, turns: Iterable[tuple[int, str, str, bool]]) -> tuple[tuple, list[tuple]]:
    """Dialog state over (turn, intent, product, negative): the intent stack, carried product, counts.

    state: (last_intent, product, negative_turns, turn_count, topics, history), the last two '|'-joined.
    """
    last, product, negative, count, topics, history = state
    stack, hist = [t for t in topics.split("|") if t], [h for h in history.split("|") if h]
    out = []
    for turn, intent, named, bad in turns:
        if intent != last:
            count = 0
            if intent in stack:
                stack = stack[: stack.index(intent)]
            elif last:
                stack = [*stack, last][-TOPICS:]
        count += 1
        negative = negative + 1 if bad else 0
        product = named or product
        last = intent
        hist = [*hist, str(turn)][-HISTORY:]
        out.append((turn, intent, product, negative, count, "|".join(stack)))
    return (last, product, negative, count, "|".join(stack), "|".join(hist)), out


def _sessions_of(state: tuple, turns: Iterable[tuple], ttl_ms: int) -> tuple[tuple, list[tuple]]:
    """Dialog states over turns (at in ms, turn, intent, product, negative) in order: a gap of more than ttl_ms begins anew.

    state: that of dialog_steps and, last, when the last turn was (-1: never).
    """
    out: list[tuple] = []
    for at, *turn in turns:
        if 0 <= state[-1] < at - ttl_ms:
            state = FRESH
        new, seen = dialog_steps(state[:-1], [tuple(turn)])
        state = (*new, int(at))
        out += seen
    return state, out


def dialog_state(turns: DataFrame, key: str = "conv_id", ttl: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, turn, intent, product, negative_turns, turn_count, topics after each turn (key, at timestamp, turn, intent,
    product, negative), in the order of at, then turn. A session that is silent for longer than ttl begins anew; turns
    without a time are left out.

    On a stream, turns may come out of order by `late`: each waits in its session's state until the watermark has passed
    it, then is taken in order; what comes later than that is left out. A timer wakes a session for its waiting turns, and
    removes its state once it has been silent for ttl: state doesn't grow with the sessions there have been.
    """
    spark = turns.sparkSession
    ship(spark)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = turns.filter("at is not null").select(F.col(key).cast("long").alias("key"), "at", F.col("turn").cast("int").alias("turn"), "intent", F.coalesce("product", F.lit("")).alias("product"), F.coalesce("negative", F.lit(False)).alias("negative"))
    cols = ["turn", "intent", "product", "negative_turns", "turn_count", "topics"]
    out = "key long, turn int, intent string, product string, negative_turns int, turn_count int, topics string"
    ms = F.unix_millis("at").alias("ms")

    def frame(k: int, seen: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(seen, columns=cols).assign(key=k)[["key", *cols]]

    if turns.isStreaming:

        def on(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            *held, waiting = state.get if state.exists else (*FRESH, "[]")
            turns = [tuple(x) for x in json.loads(waiting)]
            for f in () if state.hasTimedOut else frames:
                turns += list(zip(f["ms"].tolist(), f["turn"].tolist(), f["intent"].tolist(), f["product"].tolist(), f["negative"].tolist(), strict=True))
            mark = state.getCurrentWatermarkMs()
            turns.sort()
            ready = [t for t in turns if t[0] <= mark]
            rest = turns[len(ready) :]
            new, seen = _sessions_of(tuple(held), ready, ttl_ms)
            if not rest and new[-1] + ttl_ms < mark:
                state.remove()
            else:
                state.update((*new, json.dumps(rest)))
                # The next waiting turn's time, or when the session will have been silent for too long.
                state.setTimeoutTimestamp(max(rest[0][0] if rest else new[-1] + ttl_ms, mark) + 1)
            if seen:
                yield frame(k[0], seen)

        st = "last string, product string, negative int, count int, topics string, history string, at long, waiting string"
        done = rows.withWatermark("at", late).select("key", "at", ms, "turn", "intent", "product", "negative").groupBy("key").applyInPandasWithState(on, out, st, "append", "EventTimeTimeout")
    else:

        def whole(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["ms", "turn", "intent", "product"])
            return frame(f["key"].iloc[0], _sessions_of(FRESH, zip(f["ms"], f["turn"], f["intent"], f["product"], f["negative"], strict=True), ttl_ms)[1])

        done = rows.select("key", ms, "turn", "intent", "product", "negative").groupBy("key").applyInPandas(whole, out)
    return done.withColumnRenamed("key", key)


def live_entries(cache: DataFrame, now: Column, ttl: int = 3600, version: str | None = None) -> DataFrame:
    """Cache entries that are young enough and, if version is given, of that knowledge base version."""
    out = cache.filter((now - F.col("created")).between(0, ttl))
    return out.filter(F.col("version") == version) if version is not None else out


def audited(events: DataFrame, allowed: tuple[str, ...], tool: str = "event_type") -> DataFrame:
    """events with decision: allow for tools of the list, deny for the rest; the audit log of a tool registry."""
    return events.withColumn("decision", F.when(F.col(tool).isin(*allowed), "allow").otherwise("deny"))


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Drains a stream into a memory table and stops: for tests and backfills of bounded folders."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
