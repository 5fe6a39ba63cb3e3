"""Service data: exact percentiles, service levels, bad cases, product catalog and subscription checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut

# Risk classes of products and investors, lowest first.
RISK_CLASSES = ("R1", "R2", "R3", "R4", "R5")


def _at_places(rows: DataFrame, groups: Sequence[str], value: str, places: dict[str, Column], cuts: int) -> DataFrame:
    """__g, __total and for each name the value at its place, from 0 (an expression over __total, the group's values).

    No group's values meet in one task: equal values are counted first, cut points split each group into ranges, and only
    the ranges that hold a wanted place are put in order.
    """
    key = F.struct(F.lit(0).alias("__all"), *groups)
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(key.alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    # Cut points depend on the order in which rows come: they are read twice, so they are computed once.
    points = cut(counts.groupBy("__g").agg(F.percentile_approx("__v", [i / cuts for i in range(1, cuts)], 1000).alias("__cuts")))
    at = counts.join(points, "__g").withColumn("__b", F.size(F.filter("__cuts", lambda x: x < F.col("__v")))).drop("__cuts")
    ranges = at.groupBy("__g", "__b").agg(F.sum("__n").alias("__m"))
    whole = Window.partitionBy("__g")
    ranges = ranges.withColumn("__end", F.sum("__m").over(whole.orderBy("__b"))).withColumn("__total", F.sum("__m").over(whole))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), k.cast("long").alias("__k")) for n, k in places.items()]))
    wanted = ranges.select("__g", "__b", "__m", "__end", "__total", names.alias("__x")).select("__g", "__b", "__m", "__end", "__total", "__x.*")
    wanted = wanted.filter((F.col("__end") - F.col("__m") <= F.col("__k")) & (F.col("__k") < F.col("__end")))
    wanted = wanted.select("__g", "__b", "__total", "__name", (F.col("__k") - F.col("__end") + F.col("__m")).alias("__rest"))
    run = Window.partitionBy("__g", "__b").orderBy("__v")
    near = at.join(wanted.select("__g", "__b").distinct(), ["__g", "__b"], "left_semi").withColumn("__to", F.sum("__n").over(run))
    hit = near.join(wanted, ["__g", "__b"]).filter((F.col("__to") - F.col("__n") <= F.col("__rest")) & (F.col("__rest") < F.col("__to")))
    return hit.groupBy("__g", "__total").pivot("__name", list(places)).agg(F.first("__v"))


def floor_percentiles(rows: DataFrame, groups: Sequence[str], value: str, ps: dict[str, float], cuts: int = 64) -> DataFrame:
    """groups and one column per entry of ps (name -> p): the value at place min(n - 1, floor(n * p)), counted from 0.

    Exact (see _at_places). Nulls don't count; a group without values has no row. A null is a group like any other.
    """
    place = lambda p: F.least(F.col("__total") - 1, F.floor(F.col("__total") * F.lit(float(p))))
    found = _at_places(rows, groups, value, {n: place(p) for n, p in ps.items()}, cuts)
    return found.select(*[F.col("__g")[g].alias(g) for g in groups], *ps)


def linear_percentiles(rows: DataFrame, groups: Sequence[str], value: str, ps: dict[str, float], cuts: int = 64) -> DataFrame:
    """groups and one column per entry of ps (name -> p): between the two values around place (n - 1) * p, in proportion.

    Exact (see _at_places). Nulls don't count; a group without values has no row. A null is a group like any other.
    """
    at = lambda p: (F.col("__total") - 1) * F.lit(float(p))
    places = {f"{n}{side}": f(at(p)) for n, p in ps.items() for side, f in (("<", F.floor), (">", F.ceil))}
    found = _at_places(rows, groups, value, places, cuts)
    low = lambda n: F.col(f"`{n}<`").cast("double")
    mixed = [(low(n) + (F.col(f"`{n}>`").cast("double") - low(n)) * (at(p) - F.floor(at(p)))).alias(n) for n, p in ps.items()]
    return found.select(*[F.col("__g")[g].alias(g) for g in groups], *mixed)


def sli_snapshot(requests: DataFrame, now: datetime, hours: int = 24) -> DataFrame:
    """One row of service levels over the last `hours` hour buckets up to now.

    requests: at timestamp, stream boolean, status int, ok boolean (of streams), cache_hit boolean, ms and ttfb_ms double.
    Streams count as requests but their times only enter the stream columns. Status 504 is a timeout, 500 and more an
    error; a stream that is not ok is an error. Times are cut to whole milliseconds. No samples: percentiles and means
    are 0. Every sample of the window counts.
    """
    first = F.date_trunc("hour", F.lit(now)) - F.expr(f"INTERVAL {hours - 1} HOURS")
    span = 3600.0 if hours == 1 else min(hours * 3600.0, (hours - 1) * 3600.0 + now.minute * 60 + now.second + now.microsecond / 1e6)
    r = requests.filter((F.col("at") >= first) & (F.col("at") <= F.lit(now))).withColumn("stream", F.coalesce("stream", F.lit(False)))
    plain = ~F.col("stream")
    bad_stream = F.col("stream") & ~F.coalesce("ok", F.lit(True))
    ms = F.col("ms").cast("long")
    n = F.count("*")
    sums = r.agg(
        n.alias("total"),
        F.count_if(plain & (F.col("status") == 504)).alias("timeouts"),
        (F.count_if(plain & (F.col("status") >= 500) & (F.col("status") != 504)) + F.count_if(bad_stream)).alias("errors"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.coalesce(F.avg(F.when(plain, ms)), F.lit(0.0)).alias("avg_ms"),
        F.count(F.when(plain, ms)).alias("samples"),
        F.count_if("stream").alias("stream_cnt"),
        F.count_if(bad_stream).alias("stream_errors"),
        F.count(F.when(F.col("stream"), ms)).alias("stream_samples"),
    )
    kinds = F.array(
        F.struct(F.lit("").alias("kind"), F.when(plain, ms).alias("v")),
        F.struct(F.lit("stream_ttfb_").alias("kind"), F.when(F.col("stream"), F.col("ttfb_ms").cast("long")).alias("v")),
        F.struct(F.lit("stream_total_").alias("kind"), F.when(F.col("stream"), ms).alias("v")),
    )
    places = floor_percentiles(r.select(F.inline(kinds)), ["kind"], "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    names = [f"{k}{p}_ms" for k in ("", "stream_ttfb_", "stream_total_") for p in ("p50", "p90", "p99")]
    wide = places.agg(*[F.max(F.when(F.col("kind") == x[: -len("p50_ms")], F.col(x[-len("p50_ms") : -len("_ms")]))).alias(x) for x in names])
    least = F.greatest("total", F.lit(1))
    rates = {"success_rate": F.col("total") - F.col("errors") - F.col("timeouts"), "error_rate": F.col("errors"), "timeout_rate": F.col("timeouts"), "cache_hit_rate": F.col("cache_hits")}
    return sums.crossJoin(wide).select(  # one row each
        F.lit(hours).alias("buckets"), "total", (F.col("total") / max(span, 1.0)).alias("qps"),
        *[(c / least).alias(x) for x, c in rates.items()], "avg_ms", "samples", "stream_cnt", "stream_errors", "stream_samples",
        *[F.coalesce(x, F.lit(0)).alias(x) for x in names],
    )


def badcases(traces: DataFrame, feedback: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """traces that any of five conditions marks, with rating (lowest), reasons and sources_n.

    traces: trace_id, intent, sources (JSON array), verdict, confidence and any others; feedback: trace_id, rating.
    Reasons in order: downvote (a rating of -1), unknown_intent, empty_retrieval, reject, low_confidence. A null intent
    doesn't mark a trace but is told among the reasons of one that is marked; a null confidence is neither.
    """
    votes = feedback.groupBy("trace_id").agg(F.min("rating").alias("rating"), F.max(F.col("rating") == -1).alias("__down"))
    unknown, empty = F.col("intent").isin("unknown", ""), F.col("sources").isNull() | F.col("sources").isin("[]", "", "null")
    reject, unsure, down = F.col("verdict") == "reject", F.col("confidence") < least_confidence, F.col("__down")
    told = [("downvote", F.col("rating") == -1), ("unknown_intent", unknown | F.col("intent").isNull()), ("empty_retrieval", empty), ("reject", reject), ("low_confidence", unsure)]
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in told]), lambda x: x.isNotNull())
    marked = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (unknown, empty, reject, unsure, down)])
    out = traces.join(votes, "trace_id", "left").filter(marked)
    return out.withColumns({"reasons": reasons, "sources_n": F.coalesce(F.json_array_length("sources"), F.lit(0))}).drop("__down")


def filter_products(catalog: DataFrame, type: str = "", risk: str = "", keyword: str = "") -> DataFrame:
    """Rows of catalog (name, type, risk): type contains, risk equals whatever the case, keyword in name or type; blanks don't filter."""
    out = catalog
    if type:
        out = out.filter(F.col("type").contains(type))
    if risk:
        out = out.filter(F.upper("risk") == risk.upper())
    if keyword:
        k = keyword.strip()
        out = out.filter(F.col("name").contains(k) | F.col("type").contains(k))
    return out


def find_products(catalog: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """wanted, id, name: for each wanted text the first product (by pos) whose id it is or whose name holds it.

    catalog: pos, id, name. The stated texts meet every row in one pass; blank ones and those without a product have no row.
    """
    texts = F.array(*[F.lit(w.strip()) for w in dict.fromkeys(wanted) if w.strip()]).cast("array<string>")
    hits = catalog.select("pos", "id", "name", F.explode(F.filter(texts, lambda w: (F.col("id") == w) | F.col("name").contains(w))).alias("wanted"))
    return hits.groupBy("wanted").agg(F.min(F.struct("pos", "id", "name")).alias("x")).select("wanted", "x.id", "x.name")


def _rank(level: Column, otherwise: int) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RISK_CLASSES)), F.upper(level)), F.lit(0)), F.lit(otherwise))


def suitability(level: Column, risk: Column, found: Column) -> Column:
    """'no_product', 'no_level', 'ok' or 'handoff': whether an investor of this level may buy a product of this risk.

    An unknown risk counts as the highest class, an unknown level as below the lowest; a null or blank level is none.
    """
    ok = _rank(level, 0) >= _rank(F.coalesce(risk, F.lit("")), len(RISK_CLASSES))
    return F.when(~F.coalesce(found, F.lit(False)), "no_product").when(F.coalesce(level, F.lit("")) == "", "no_level").when(ok, "ok").otherwise("handoff")


def subscription_gate(requests: DataFrame, profiles: DataFrame, catalog: DataFrame, holdings: DataFrame) -> DataFrame:
    """requests with gate, the first check that fails: login, product, suitability, amount, below_minimum, code, held; or ok.

    requests: user_id, product_id, amount, code; profiles: user_id, level, verify_code; catalog: product_id, risk,
    min_amount; holdings: user_id, product_id. Profiles and catalog have unique keys. A user without a level passes the
    check of suitability. A null minimum is 0.
    """
    known = catalog.select("product_id", "risk", "min_amount", F.lit(True).alias("__found"))
    held = holdings.select("user_id", "product_id").distinct().withColumn("__held", F.lit(True))
    r = requests.join(profiles.select("user_id", "level", "verify_code"), "user_id", "left").join(known, "product_id", "left").join(held, ["user_id", "product_id"], "left")
    code = F.coalesce("code", F.lit(""))
    gate = (
        F.when(F.col("user_id").isNull(), "login")
        .when(F.col("__found").isNull(), "product")
        .when(suitability(F.col("level"), F.col("risk"), F.col("__found")) == "handoff", "suitability")
        .when(F.col("amount").isNull(), "amount")
        .when(F.col("amount") < F.coalesce("min_amount", F.lit(0.0)), "below_minimum")
        .when((code == "") | ~F.coalesce(code == F.col("verify_code"), F.lit(False)), "code")
        .when(F.col("__held"), "held")
        .otherwise("ok")
    )
    return r.withColumn("gate", gate).select(*requests.columns, "gate")
