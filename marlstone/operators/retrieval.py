"""Retrieval for many queries per job: lexical, dense, fused, diverse and reranked lists as long-form rows.

Ranked rows are (qid, cid, score, rank); every list ends with a unique tie key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as tx
from marlstone.session import ship

#: Query terms and query vectors up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _hint(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small: its size is counted first."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def index(chunks: DataFrame, cid: str = "cid", text: str = "text", avgdl: str = "distinct", only: DataFrame | None = None) -> dict[str, DataFrame]:
    """BM25 statistics: postings(term, cid, tf), terms(term, df, idf), docs(cid, dl, du), corpus(n, avgdl).

    avgdl: 'distinct' averages numbers of distinct terms, 'total' lengths. only: queries (text) whose terms are all that
    the index is asked for; no other token is counted or shuffled then.
    """
    toks = chunks.select(F.col(cid).alias("cid"), tx.tokens(F.coalesce(text, F.lit(""))).alias("ts"))
    found = toks.select("cid", F.explode("ts").alias("term"))
    if only is not None:
        found = found.join(_hint(only.select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()), "term", "left_semi")
    postings = found.groupBy("term", "cid").agg(F.count("*").alias("tf"))
    docs = toks.select("cid", F.size("ts").cast("long").alias("dl"), F.size(F.array_distinct("ts")).cast("long").alias("du"))
    corpus = docs.agg(F.count("*").alias("n"), F.avg("du" if avgdl == "distinct" else "dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(corpus.select("n"))).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # corpus is one row
    return {"postings": postings, "terms": terms, "docs": docs, "corpus": corpus}


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties by cid."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "cid")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(idx: dict[str, DataFrame], queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, cid, score, rank of the k best chunks of each query (qid, text): only postings of query terms are read on."""
    q = _hint(queries.select("qid", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")))
    hits = idx["postings"].join(q, "term").join(idx["terms"].select("term", "idf"), "term").join(idx["docs"].select("cid", "dl"), "cid").crossJoin(F.broadcast(idx["corpus"]))  # one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return ranked(hits.groupBy("qid", "cid").agg(F.sum(part).alias("score")).filter("score > 0"), k)


def canary(index, probe: str) -> None:
    """Raises RuntimeError where a TextIndex is empty or its probe, a text that it must answer, finds nothing."""
    if not index.corpus()[0]:
        raise RuntimeError("the index holds no chunk")
    if index.search(index.spark.range(1).select(F.col("id").alias("qid"), F.lit(probe).alias("text")), 1).isEmpty():
        raise RuntimeError(f"the index finds nothing for its probe {probe!r}")


def rrf(lists: list[DataFrame], k: int = 5, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ties go to the earlier list, then to the better rank in it, then to cid."""
    rows = None
    for i, x in enumerate(lists):
        one = x.select("qid", "cid", "rank", F.lit(i).alias("path"))
        rows = one if rows is None else rows.unionByName(one)
    g = rows.groupBy("qid", "cid").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score"), F.min(F.struct("path", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "seen", "cid")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "cid", "score", "rank")


def provenance(dense_list: DataFrame, sparse_list: DataFrame) -> DataFrame:
    """qid, cid, dense_rank, sparse_rank, found_by."""
    d = dense_list.select("qid", "cid", F.col("rank").alias("dense_rank"))
    s = sparse_list.select("qid", "cid", F.col("rank").alias("sparse_rank"))
    by = F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("both")
    return d.join(s, ["qid", "cid"], "full_outer").withColumn("found_by", by)


def rerank(candidates: DataFrame, k: int = 5, weight: float = 0.6) -> DataFrame:
    """Lexical rerank of (qid, cid, score, rank, terms, content): share of terms found, and the score over the best one.

    Lists of at most k stay as they are.
    """
    w = Window.partitionBy("qid")
    c = candidates.withColumn("n", F.count("*").over(w)).withColumn("top", F.max("score").over(w))
    new = weight * tx.overlap_ratio(F.col("terms"), F.col("content")) + (1 - weight) * F.when(F.col("top") > 0, F.least(F.col("score") / F.col("top"), F.lit(1.0))).otherwise(0.0)
    c = c.withColumn("new", F.when(F.col("n") <= k, F.col("score")).otherwise(new))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("new", 12)), "rank")
    return c.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("qid", "cid", F.col("new").alias("score"), F.col("place").alias("rank"))


def mmr(candidates: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance of (qid, cid, rank, v, qv): qid, cid, score, rank in order of selection.

    Greedy, so per query; candidates of a query are a ranked list of bounded length.
    """
    ship(candidates.sparkSession)

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        v = np.stack(f["v"].to_numpy()).astype(np.float64)
        rel = v @ np.asarray(f["qv"].iloc[0], dtype=np.float64)
        sim = v @ v.T
        chosen: list[int] = []
        scores = []
        left = list(range(len(f)))
        while left and len(chosen) < k:
            near = sim[np.ix_(left, chosen)].max(axis=1) if chosen else np.zeros(len(left))
            s = weight * rel[left] - (1 - weight) * near
            at = int(np.argmax(s))
            scores.append(float(s[at]))
            chosen.append(left.pop(at))
        return pd.DataFrame({"qid": f["qid"].iloc[0], "cid": f["cid"].to_numpy()[chosen], "score": scores, "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("qid").applyInPandas(pick, "qid long, cid long, score double, rank int")


def hybrid(dense_list: DataFrame, sparse_list: DataFrame, chunks: DataFrame, questions: DataFrame, entries: DataFrame, parents: DataFrame | None = None, k: int = 5, pool: int = 20, c: int = 60, inject: int = 3) -> DataFrame:
    """qid, rank, cid, source, origin, sparse_empty: both lists fused to a pool, reranked to k, graph evidence behind.

    chunks: cid, source, content; questions: qid, terms, relational; entries: qid, pos, source of graph paths; parents:
    cid, parent. Relational questions get up to `inject` entries, by pos, whose source isn't among their k chunks; those
    have no cid. Chunks give way to their parents, once each. sparse_empty tells a question without lexical hits from
    one that has them; whether the index answers at all is for `canary`. A question that nothing answers has no row.
    """
    fused = rrf([dense_list, sparse_list], pool, c)
    best = rerank(fused.join(chunks.select("cid", "content"), "cid").join(questions.select("qid", "terms"), "qid"), k)
    sources = chunks.select("cid", "source")
    seen = best.join(sources, "cid").select("qid", "source").distinct()
    asked = entries.join(questions.filter("relational").select("qid"), "qid", "left_semi").join(seen, ["qid", "source"], "left_anti")
    extra = asked.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "source"))).filter(F.col("n") <= inject)
    local = best if parents is None else expand_parents(best, parents)
    rows = local.join(sources, "cid", "left").select("qid", F.col("rank").alias("at"), "cid", "source", F.lit("text").alias("origin"))
    rows = rows.unionByName(extra.select("qid", (F.col("n") + k).alias("at"), F.lit(None).cast(dict(chunks.dtypes)["cid"]).alias("cid"), "source", F.lit("graph").alias("origin")))
    found = sparse_list.select("qid").distinct().withColumn("has", F.lit(True))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    return rows.withColumn("rank", place).join(found, "qid", "left").select("qid", "rank", "cid", "source", "origin", F.col("has").isNull().alias("sparse_empty"))


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (qid, cid, score, rank) with each child replaced by its parent, first place kept; parents: cid, parent."""
    up = hits.join(parents, "cid", "left").withColumn("pid", F.coalesce("parent", "cid"))
    w = Window.partitionBy("qid", "pid").orderBy("rank")
    again = Window.partitionBy("qid").orderBy("rank")
    return up.withColumn("n", F.row_number().over(w)).filter("n = 1").withColumn("place", F.row_number().over(again)).select("qid", F.col("pid").alias("cid"), "score", F.col("place").alias("rank"))


def merge_subqueries(hits: DataFrame, k: int = 8) -> DataFrame:
    """cid, score: best score over all sub-queries, top k."""
    return hits.groupBy("cid").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "cid").limit(k)


def centroid_clusters(rows: DataFrame, least: float = 0.75) -> DataFrame:
    """Greedy centroid clustering of (part, id, v) in id order within each part: part, id, cluster.

    Order-dependent: each part is one sequence. Parts bound the work of a task; callers choose them.
    """
    ship(rows.sparkSession)

    def go(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        sums: list[np.ndarray] = []
        unit = np.zeros((0, 0))
        out = []
        for v in np.stack(f["v"].to_numpy()).astype(np.float64):
            v = v / (np.linalg.norm(v) or 1.0)
            at = -1
            if sums:
                s = unit @ v
                at = int(np.argmax(s)) if s.max() >= least else -1
            if at < 0:
                sums.append(v.copy())
                unit = np.vstack([unit.reshape(-1, len(v)), v])
                at = len(sums) - 1
            else:
                sums[at] += v
                unit[at] = sums[at] / (np.linalg.norm(sums[at]) or 1.0)
            out.append(at)
        return pd.DataFrame({"part": f["part"].to_numpy(), "id": f["id"].to_numpy(), "cluster": out})

    return rows.groupBy("part").applyInPandas(go, "part long, id long, cluster int")


def _slots(at: Column, ttl: int, back: bool) -> Column:
    """Spans of ttl seconds: that of an entry's creation, or (back) the two that a query's live entries were created in."""
    slot = F.floor(at / max(ttl, 1)).cast("long")
    return F.explode(F.array(slot - 1, slot)) if back else slot


def cache_lookup(queries: DataFrame, cache: DataFrame, features, similarity, l2_least: float = 0.5, l3_least: float = 0.9, ttl: int = 3600) -> DataFrame:
    """qid, hit, tier, score of (qid, text, qv, at) against (key, text, v, created): exact key, then similarity, then cosine.

    Each tier only sees what the ones before missed; entries older than ttl seconds don't count. Best match, ties
    to the smaller key. features: of a text, computed once per row; similarity: of two of them. Queries meet the
    entries of their two spans of ttl seconds by equality, whatever the cache's size; entries outside can't be live.
    """
    live = cache.withColumn("ckey", tx.cache_key(F.col("text")))
    q = queries.withColumn("qkey", tx.cache_key(F.col("text"))).withColumn("qf", features(F.col("text")))
    fresh = (F.col("at") - F.col("created")).between(0, ttl)
    best = lambda d, t: d.groupBy("qid").agg(F.max_by(F.struct(F.col("key").alias("hit"), F.col("score")), F.struct("score", (-F.col("key")).alias("neg"))).alias("b")).select("qid", "b.hit", F.lit(t).alias("tier"), "b.score")
    c = live.select("key", features(F.col("text")).alias("cf"), "v", "created", "ckey")
    l1 = best(q.join(c, q["qkey"] == c["ckey"]).filter(fresh).withColumn("score", F.lit(1.0)), 1)
    c = c.withColumn("slot", _slots(F.col("created"), ttl, False))
    asked = lambda d: d.withColumn("slot", _slots(F.col("at"), ttl, True)).join(c, "slot")
    rest = q.join(l1, "qid", "left_anti")
    l2 = best(asked(rest).filter(fresh).withColumn("score", similarity(F.col("qf"), F.col("cf"))).filter(F.col("score") >= l2_least), 2)
    rest = rest.join(l2, "qid", "left_anti")
    l3 = best(asked(rest).filter(fresh).withColumn("score", tx.cosine(F.col("qv"), F.col("v"))).filter(F.col("score") >= l3_least), 3)
    return l1.unionByName(l2).unionByName(l3)


def gateway_lookup(queries: DataFrame, cache: DataFrame, high: float = 0.93, low: float = 0.82, share: float = 0.4, ttl: int = 86_400) -> DataFrame:
    """qid, key, score, tier of the queries that the nearest live entry answers; ties go to the smaller key.

    queries: qid, text, qv, at; cache: key, text, v, created; times in seconds. An entry lives for ttl seconds from
    its creation. Years and order numbers must agree; below high (tier 'near'; 'same' from high on) so must a share of
    the two-character sequences. Only the nearest entry is asked. Blank queries and zero vectors find nothing.
    """
    from marlstone.operators.vectors import nearest_live  # it needs ranked() of this module

    q = queries.filter(F.trim("text") != "").select("qid", "qv", "at", _slots(F.col("at"), ttl, True).alias("slot"))
    best = nearest_live(cache.select("key", "v", "created", _slots(F.col("created"), ttl, False).alias("slot")), q, low, ttl)
    both = best.join(queries.select("qid", F.col("text").alias("asked")), "qid").join(cache.select("key", "text"), "key")
    x, y = tx.ngrams(F.col("asked"), 2), tx.ngrams(F.col("text"), 2)
    tier = F.when(F.col("score") >= high, "same").when(tx.contained(x, y, share), "near")
    agree = tx.signature(F.col("asked")) == tx.signature(F.col("text"))
    return both.filter(agree).select("qid", "key", "score", tier.alias("tier")).filter("tier is not null")
