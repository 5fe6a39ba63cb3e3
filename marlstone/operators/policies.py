"""What happens to a case: review queues, review and retry, task states, themes of what was retrieved, badges, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import any_of
from marlstone.operators.ordering import last_of

# Task states by what workers report; nodes by intent; reasons of the queue, gravest first; badges from scores.
TASK_STATES = ("pending", "processing", "completed", "failed")
WORKER_STATES = {"PENDING": "pending", "RECEIVED": "pending", "STARTED": "processing", "PROGRESS": "processing", "PROCESSING": "processing", "RETRY": "processing", "SUCCESS": "completed", "FAILURE": "failed", "REVOKED": "failed"}
NODES = {
    "product_consult": "finance_node", "product_compare": "finance_node", "risk_suitability": "finance_node", "income_question": "finance_node", "deposit_insurance": "finance_node", "buy_process": "finance_node",
    "hold_redeem": "finance_node", "fee_rule": "finance_node", "fraud_report": "handoff_node", "complaint": "handoff_node", "service_policy": "finance_node", "chitchat": "chitchat_node",
}
REASONS = ("evidence_missing", "chunk_missing", "low_confidence")
BADGES = ((80, "high"), (50, "medium"))
LOW_RISK = ("chitchat", "service_policy", "unknown")
HANDOFF = ("fraud_report", "complaint")
GATED = ("subscribe_node", "handoff_node")
THEMES = (
    ("deposit_insurance", ("存款保险", "deposit_insurance", "偿付", "保障范围")),
    ("risk_suitability", ("适当性", "风险等级", "risk_level", "测评")),
    ("fee_rule", ("费用", "费率", "fee", "手续费")),
    ("hold_redeem", ("赎回", "持有", "到期", "redeem", "hold")),
    ("buy_process", ("购买", "申购", "流程", "buy", "冷静期", "双录")),
    ("income_question", ("收益", "利息", "业绩比较基准", "income", "保本")),
)


def _mapped(col: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col)


def low_confidence_queue(cases: DataFrame, threshold: float = 0.7, limit: int | None = None, order: str = "id") -> DataFrame:
    """cases with reason and severity (0 is gravest) that need a look, gravest first, then in order: their evidence isn't covered, their chunk
    wasn't hit, or their confidence is under threshold. Nulls are covered, hit and sure."""
    conf, covered, hit = F.coalesce("confidence", F.lit(1.0)), F.coalesce("evidence_covered", F.lit(True)), F.coalesce("chunk_info_hit", F.lit(True))
    reason = F.when(~covered, REASONS[0]).when(~hit, REASONS[1]).when(conf < threshold, REASONS[2])
    severity = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason")).cast("int") - 1
    queue = cases.withColumn("reason", reason).filter("reason is not null").withColumn("severity", severity).orderBy("severity", order)
    return queue if limit is None else queue.limit(limit)


def task_state(state: Column, known: tuple[str, ...] = TASK_STATES, workers: dict[str, str] | None = None) -> Column:
    """A task's state from what any worker reports: known states in any case, workers' names, or failed."""
    raw = F.trim(F.coalesce(state, F.lit("")))
    return F.when(F.lower(raw).isin(*known), F.lower(raw)).otherwise(F.coalesce(_mapped(F.upper(raw), workers or WORKER_STATES), F.lit("failed")))


def node_of(intent: Column, nodes: dict[str, str] | None = None, other: str = "general_node") -> Column:
    """The node that answers an intent."""
    return F.coalesce(_mapped(intent, nodes or NODES), F.lit(other))


def skips_review(verdict: Column, intent: Column, stage: Column) -> Column:
    """Whether no model reviews an answer: the quick check passed, its stage is fixed text, or its intent is handed over or of low risk."""
    i = F.coalesce(intent, F.lit("unknown"))
    return F.coalesce((verdict == "pass"), F.lit(False)) | i.isin(*HANDOFF, *LOW_RISK) | F.coalesce(stage.isin(*GATED), F.lit(False))


def after_review(verdict: Column, retries: Column, most: int = 2) -> Column:
    """What follows a review: a rejected answer is made again, up to `most` times."""
    return F.when((verdict == "reject") & (F.coalesce(retries, F.lit(0)) < most), "regenerate_node").otherwise("formatter_node")


def review_outcome(confidence: Column, quick: Column, business: Column, rejected: Column, retries: Column, score: Column, sure: float = 0.85, most: int = 2, cap: float = 40.0, passed: float = 85.0) -> Column:
    """struct<outcome, score> of the older policy: business intents and sure ones whose quick check passed skip the review
    (score `passed`); a rejected answer is retried, and once retries are exhausted its score is `cap` at most."""
    skip = F.coalesce(business, F.lit(False)) | ((confidence >= sure) & (quick == "pass"))
    out = lambda o, s: F.struct(F.lit(o).alias("outcome"), s.cast("double").alias("score"))
    return F.when(F.coalesce(skip, F.lit(False)), out("skip", F.lit(passed))).when(~F.coalesce(rejected, F.lit(False)), out("reviewed", score)).when(F.coalesce(retries, F.lit(0)) < most, out("retry", score)).otherwise(out("exhausted", F.least(score, F.lit(cap))))


def badge(score: Column, badges: tuple[tuple[int, str], ...] = BADGES, other: str = "low") -> Column:
    """The first badge whose score is reached."""
    out = None
    for least, name in badges:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(other)


def theme_of(source: Column, text: Column, themes: tuple = THEMES, chars: int = 200) -> Column:
    """The first theme with a word in a chunk's source or beginning, ignoring case; null without one."""
    s, t = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, chars))
    return F.coalesce(*[F.when(any_of(s, [w.lower() for w in ws]) | any_of(t, [w.lower() for w in ws]), F.lit(n)) for n, ws in themes], F.lit(None).cast("string"))


def consistent_intent(cases: DataFrame, hits: DataFrame, themes: tuple = THEMES, top: int = 3, least: int = 2, sure: float = 0.7) -> DataFrame:
    """id, intent, adjusted: intents of cases (id, intent, confidence), where they are unsure and `least` of the first `top` hits
    (id, rank, source, text) are of another theme replaced by that. Of equal themes the one seen first wins."""
    seen = hits.filter(F.col("rank") <= top).select("id", "rank", theme_of(F.col("source"), F.col("text"), themes).alias("theme")).filter("theme is not null")
    votes = seen.groupBy("id", "theme").agg(F.count("*").alias("n"), F.min("rank").alias("at"))
    best = votes.groupBy("id").agg(F.max_by(F.struct("theme", "n"), F.struct("n", (-F.col("at")).alias("less"))).alias("v")).select("id", "v.theme", "v.n")
    turn = (F.col("confidence") < sure) & (F.col("n") >= least) & (F.col("theme") != F.coalesce("intent", F.lit("")))
    out = cases.join(best, "id", "left").withColumn("adjusted", F.coalesce(turn, F.lit(False)))
    return out.select("id", F.when(F.col("adjusted"), F.col("theme")).otherwise(F.col("intent")).alias("intent"), "adjusted")


def evidence_lines(chunks: DataFrame, key: str, order: str, chars: int = 1500, unknown: str = "未知") -> DataFrame:
    """key, lines, sources: a line with its source for each chunk (content, source), in order, and the distinct known sources as
    they come up."""
    src = F.coalesce("source", F.lit(unknown))
    line = F.concat(F.lit("- "), F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit(" [来源: "), src, F.lit("]"))
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"), src.alias("source")))).alias("x"))
    known = F.array_distinct(F.filter(F.transform("x", lambda r: r["source"]), lambda s: (s != unknown) & (s != "")))
    return rows.select(key, F.transform("x", lambda r: r["line"]).alias("lines"), known.alias("sources"))


def diverse_top(cases: DataFrame, k: int = 4) -> DataFrame:
    """qid, id, place: k of each query's cases (qid, id, intent, score, note), the best of each intent first, by score, as long
    as it is positive; then the best others that have a note. Ties by id."""
    w = Window.partitionBy("qid", "intent").orderBy(F.desc("score"), "id")
    c = cases.withColumn("first", (F.row_number().over(w) == 1) & (F.col("score") > 0)).filter(F.col("first") | (F.coalesce("note", F.lit("")) != ""))
    order = [F.desc("first"), F.desc("score"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return last_of(c, ["qid"], k, *order).select("qid", "id", place.alias("place"))


def merged(hits: DataFrame, k: int = 8) -> DataFrame:
    """cid, score, best: chunks found by several sub-queries (qid, cid, score), each by its best score and the sub-query that gave it, k best first."""
    best = hits.groupBy("cid").agg(F.max("score").alias("score"), F.max_by("qid", F.struct("score", (-F.col("qid")).alias("less"))).alias("best"))
    return best.orderBy(F.desc("score"), "cid").limit(k)


def compared(base: DataFrame, new: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """id, metric, verdict of cases that both reports have: worse, better or same; nulls are the same as nulls only."""
    both = base.join(new.select("id", *[F.col(m).alias(f"__{m}") for m in metrics]), "id")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("was"), F.col(f"__{m}").cast("double").alias("now")) for m in metrics]))
    verdict = F.when(F.col("x.was").eqNullSafe(F.col("x.now")), "same").when(F.col("x.was").isNull() | (F.col("x.now") > F.col("x.was")), "better").otherwise("worse")
    return both.select("id", each.alias("x")).select("id", "x.metric", verdict.alias("verdict"))


def evidence_states(golden: DataFrame, now: DataFrame) -> DataFrame:
    """id, missing, stale, ok: of cases with the hashes of their evidence (id, hashes map<chunk, hash>), how many chunks aren't
    there any more (now: chunk, hash), have another hash, or are as they were."""
    each = golden.select("id", F.explode("hashes").alias("chunk", "was")).join(now.select("chunk", "hash", F.lit(True).alias("there")), "chunk", "left")
    same = F.col("was").eqNullSafe(F.col("hash"))
    gone = F.col("there").isNull()
    return each.groupBy("id").agg(F.count_if(gone).alias("missing"), F.count_if(~gone & ~same).alias("stale"), F.count_if(~gone & same).alias("ok"))
