"""Figures of a service's reports: shares, ratios, totals, profiles and samples of its logs.

Groups are counted in tasks before anything is shuffled; no group's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ordering import sequence

# The longest time in milliseconds that a request may claim, and the form of a request's message.
PLAUSIBLE_MS = 24 * 3600 * 1000
REQUEST = r"^(\w+) (\S+) -> (\d+)"


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n, share of all rows in per cent (one digit), most frequent first, then by keys. Null is a value."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.count("*").alias("__total")))  # one row
    return counts.crossJoin(total).select(*keys, "n", F.round(F.col("n") * 100.0 / F.col("__total"), 1).alias("share")).orderBy(F.desc("n"), *keys)


def totals(rows: DataFrame, **sums: Column) -> DataFrame:
    """n, and for each name the sum of its column: 0 where there is nothing to add."""
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])


def rate(part: DataFrame, whole: DataFrame, digits: int = 1) -> DataFrame:
    """part, whole, rate: rows of part for a hundred of whole; an empty whole counts as one row."""
    p, w = part.agg(F.count("*").alias("part")), whole.agg(F.count("*").alias("whole"))
    return p.crossJoin(F.broadcast(w)).withColumn("rate", F.round(F.col("part") * 100.0 / F.greatest("whole", F.lit(1)), digits))  # one row each


def ticket_sla(tickets: DataFrame, limit: float, digits: int = 6) -> DataFrame:
    """tickets, mean_take, mean_close, within: seconds from created to taken and to resolved, and the share taken in at most
    `limit` seconds.

    Of tickets (created, taken, resolved) only those taken and resolved count, and of their times only those that
    aren't negative; a time without any is null.
    """
    done = tickets.filter("created is not null and taken is not null and resolved is not null")
    span = lambda to: F.timestamp_diff("MICROSECOND", F.col("created").cast("timestamp"), F.col(to).cast("timestamp")) / 1e6
    real = lambda s: F.when(s >= 0, s)
    take = real(span("taken"))
    return done.agg(F.count("*").alias("tickets"), F.round(F.avg(take), digits).alias("mean_take"), F.round(F.avg(real(span("resolved"))), digits).alias("mean_close"), F.round(F.avg((take <= limit).cast("double")), digits).alias("within"))


def duplicate_groups(rows: DataFrame, value: str, order: str) -> DataFrame:
    """value, n, first: values that more than one row has, and the least order of theirs. Null is no value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")


def asset_overview(profiles: DataFrame, accounts: DataFrame, holdings: DataFrame, loans: DataFrame, key: str = "id", unit: float = 10_000) -> DataFrame:
    """profiles with total_deposit, total_investment, total_assets, total_liabilities and net_assets.

    accounts: key, total_deposit; holdings: key, amount (in `unit`s); loans: key, remaining. Several rows of a key add
    up; without any a sum is 0.
    """
    each = lambda d, c, by, name: d.groupBy(key).agg(F.sum(F.col(c) * by).alias(name))
    out = profiles
    for d, c, by, name in ((accounts, "total_deposit", 1, "total_deposit"), (holdings, "amount", unit, "total_investment"), (loans, "remaining", 1, "total_liabilities")):
        out = out.join(each(d, c, by, name), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out.withColumn("total_assets", F.col("total_deposit") + F.col("total_investment")).withColumn("net_assets", F.col("total_assets") - F.col("total_liabilities"))


def cluster_profiles(cases: DataFrame, cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """cluster, size, share, dominant_type, representative and reasons (array of reason and n, most frequent first).

    cases: cluster, id, type, query, reasons. The most frequent type is dominant, ties go to the name that sorts first;
    the case with the least id represents. share: of all cases, in per cent.
    """
    size = cases.groupBy(cluster).agg(F.count("*").alias("size"), F.min_by("query", id_col).alias("representative"))
    kinds = cases.groupBy(cluster, "type").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("k"))
    told = cases.select(cluster, F.explode("reasons").alias("reason")).groupBy(cluster, "reason").agg(F.count("*").alias("n"))
    # One entry for each reason, of which there is a fixed handful.
    told = told.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "reason"))).alias("r"))
    told = told.select(cluster, F.transform("r", lambda x: F.struct(x["reason"].alias("reason"), (-x["neg"]).alias("n"))).alias("reasons"))
    total = F.broadcast(cases.agg(F.count("*").alias("__total")))  # one row
    out = size.join(kinds, cluster).join(told, cluster, "left").crossJoin(total)
    return out.select(cluster, "size", F.round(F.col("size") * 100.0 / F.col("__total"), 1).alias("share"), F.col("k.type").alias("dominant_type"), "representative", "reasons")


def cache_stats(lookups: DataFrame, tier: str = "tier", tiers: int = 3) -> DataFrame:
    """Of lookups with the tier that answered them (from 1; null: none), for every tier its hits, misses and hit_ratio among the
    lookups that came to it, and hits, misses and hit_ratio of all, in per cent with one digit (0 without lookups)."""
    hit = [F.count(F.when(F.col(tier) == t, 1)).alias(f"l{t}_hits") for t in range(1, tiers + 1)]
    n = lookups.agg(F.count("*").alias("lookups"), *hit)
    ratio = lambda a, b: F.when(b > 0, F.round(a * 100.0 / b, 1)).otherwise(0.0)
    came, cols = F.col("lookups"), []
    for t in range(1, tiers + 1):
        h = F.col(f"l{t}_hits")
        cols += [h, (came - h).alias(f"l{t}_misses"), ratio(h, came).alias(f"l{t}_hit_ratio")]
        came = came - h
    return n.select("lookups", *cols, (F.col("lookups") - came).alias("hits"), came.alias("misses"), ratio(F.col("lookups") - came, F.col("lookups")).alias("hit_ratio"))


def worker_stats(tasks: DataFrame, *keys: str) -> DataFrame:
    """keys, submitted, completed, active, mean, longest, timeouts, errors of tasks (seconds, outcome): a task without an
    outcome is active; 'timeout' and 'error' are outcomes of completed ones, each counted as itself only."""
    done = F.col("outcome").isNotNull()
    of = lambda x: F.count(F.when(F.col("outcome") == x, 1))
    took = F.when(done, F.col("seconds"))
    return tasks.groupBy(*keys).agg(F.count("*").alias("submitted"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(~done, 1)).alias("active"), F.coalesce(F.avg(took), F.lit(0.0)).alias("mean"), F.coalesce(F.max(took), F.lit(0.0)).alias("longest"), of("timeout").alias("timeouts"), of("error").alias("errors"))


def cumulative(rows: DataFrame, by: Column, name: str = "day") -> DataFrame:
    """name, n, total: rows of each value of by, and of all up to it. Rows where by is null are left out."""
    per = rows.select(by.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return sequence(per.withColumn("__all", F.lit(0)), ["__all"], [F.col(name)], total=("sum", F.col("n"))).select(name, "n", "total")


def outcomes(rows: DataFrame, status: str, wanted: Sequence[str]) -> DataFrame:
    """total, and for each wanted status its number of rows; other statuses count in the total only."""
    return rows.agg(F.count("*").alias("total"), *[F.count(F.when(F.col(status) == w, 1)).alias(w) for w in wanted])


def uncovered(asked: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """total, uncovered: rows of asked, and those whose key covered doesn't have (null keys are uncovered)."""
    c = covered.select(key).distinct().withColumn("__there", F.lit(True))
    return asked.join(c, key, "left").agg(F.count("*").alias("total"), F.count(F.when(F.col("__there").isNull(), 1)).alias("uncovered"))


def family_sizes(chunks: DataFrame, parent: Column, content: Column) -> DataFrame:
    """parent_id, children, chars: chunks of each parent and their characters; chunks without one are left out."""
    return chunks.select(parent.alias("parent_id"), F.length(content).alias("__n")).filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"), F.coalesce(F.sum("__n"), F.lit(0)).alias("chars"))


def latency_samples(logs: DataFrame, since: str = "", paths: Sequence[str] = (), only_ok: bool = False, most_ms: int = PLAUSIBLE_MS) -> DataFrame:
    """logs (timestamp, message, path, status, latency_ms, ttfb_ms, stream) of requests with path, ms and kind.

    kind: suspect (longer than most_ms: a fault of a clock), stream (with a time to the first byte, or told to be one),
    ignored (a path that ends in /stream, timed as if it weren't one) or http. Lines without a latency, of other messages,
    before `since` (as text) and on paths without any of `paths` are left out; with only_ok, so are statuses outside 2xx,
    unless suspect. Path and status come from the message where the line has none.
    """
    part = lambda n: F.regexp_extract("message", REQUEST, n)
    x = logs.filter(F.col("latency_ms").isNotNull() & F.rlike("message", F.lit(REQUEST)))
    x = x.withColumn("path", F.coalesce(F.when(F.col("path") != "", F.col("path")), part(2))).withColumn("ms", F.floor("latency_ms").cast("long"))
    if since:
        x = x.filter(F.coalesce("timestamp", F.lit("")) >= since)
    for i, p in enumerate(paths):
        any_path = F.contains("path", F.lit(p)) if i == 0 else any_path | F.contains("path", F.lit(p))
    x = x.filter(any_path) if paths else x
    suspect = F.col("ms") > most_ms
    if only_ok:
        x = x.filter(suspect | F.coalesce(F.nullif("status", F.lit(0)), part(3).try_cast("int")).between(200, 299))
    kind = F.when(suspect, "suspect").when(F.col("ttfb_ms").isNotNull() | F.coalesce("stream", F.lit(False)), "stream").when(F.endswith("path", F.lit("/stream")), "ignored").otherwise("http")
    return x.withColumn("kind", kind)


def mean_latency(samples: DataFrame) -> DataFrame:
    """kind, n, mean of samples (kind, ms), suspect ones left out."""
    return samples.filter("kind <> 'suspect'").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean"))
