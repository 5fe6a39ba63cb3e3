"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimension sampling.

One more component makes every vector as long as the longest, so that the largest inner product is the smallest
distance. Vectors are dealt to lists by k-means. A query probes its nearest lists; within one, vectors are rotated
at random and read in blocks of columns, and after each block a hypothesis test on the partial distance
abandons vectors that can hardly be among the nearest. What is left is scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut
from marlstone.session import ship


@dataclass(frozen=True)
class Search:
    """k: neighbours; fit_rows: vectors that centroids are fitted on, the first by a hash of their id; lists: of the
    index (None: the root of the number of vectors, 4,096 at most); probes: share of lists that a query probes
    (None: as many as hold the share recall of the sample's own neighbours, tried with trial_queries of its rows);
    lead: nearest lists that are scanned first; columns: of a block; epsilon: of the test (larger: fewer wrong abandonments); chunk: vectors, and queries, of a
    task's group."""

    k: int = 20
    fit_rows: int = 20_000
    lists: int | None = None
    probes: float | None = None
    recall: float = 0.97
    trial_queries: int = 500
    lead: int = 3
    columns: int = 16
    epsilon: float = 2.1
    chunk: int = 4096
    queries: int = 1024
    seed: int = 7


def usable(v: Column) -> Column:
    """Whether a vector has components, all of them finite and one of them not zero."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _longer(x: np.ndarray, longest: float) -> np.ndarray:
    """x with the component that makes every row as long as longest."""
    rest = np.sqrt(np.maximum(longest * longest - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]])


def fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample, by k-means."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)
        n = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(c)
        sums[n > 0] = np.add.reduceat(sample[order], (np.cumsum(n) - n)[n > 0])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[rng.integers(0, len(sample), lists)])
    return c


def calibrated(sample: np.ndarray, centroids: np.ndarray, longest: float, s: Search) -> int:
    """Lists to probe so that the share s.recall of neighbours within the sample is reached."""
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
    home = np.argmax(_longer(sample, longest) @ centroids.T - half, axis=1)
    q = sample[: s.trial_queries]
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(s.k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(half - np.hstack([q, np.zeros((len(q), 1))]) @ centroids.T, axis=1)
    place = np.argsort(order, axis=1)
    need = np.take_along_axis(place, home[near], axis=1)
    return int(np.quantile(need, s.recall)) + 1


def _stacked(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def scan(vec_ids: np.ndarray, vecs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, rotation: np.ndarray, longest: float, s: Search) -> pd.DataFrame:
    """Of each query the k nearest of the vectors (but its own) that are no worse than its known bound: query_id, vec_id, score."""
    v = _longer(vecs, longest) @ rotation
    q = np.hstack([queries, np.zeros((len(queries), 1))]) @ rotation
    dims = v.shape[1]
    square = np.einsum("ij,ij->i", queries, queries) + longest * longest
    tau = square - 2 * known  # squared distance of the k-th nearest so far
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for at in range(0, len(v), 256):
        part = v[at : at + 256]
        own = query_ids[:, None] == vec_ids[None, at : at + 256]
        seen = min(s.columns, dims)
        head = part[:, :seen]
        partial = np.einsum("ij,ij->i", q[:, :seen], q[:, :seen])[:, None] + np.einsum("ij,ij->i", head, head)[None] - 2 * (q[:, :seen] @ head.T)
        # Random rotation makes partial * dims / seen an estimate of the distance; this far beyond tau it hardly errs.
        limit = lambda n: tau * (n / dims) * (1 + s.epsilon / math.sqrt(n)) ** 2 + 1e-9 if n < dims else tau + 1e-9
        qi, vi = np.nonzero((partial <= limit(seen)[:, None]) & ~own)
        d = partial[qi, vi]
        while seen < dims and len(qi):
            to = min(seen + s.columns, dims)
            gap = q[qi, seen:to] - part[vi, seen:to]
            d = d + np.einsum("ij,ij->i", gap, gap)
            seen = to
            stay = d <= limit(seen)[qi]
            qi, vi, d = qi[stay], vi[stay], d[stay]
        if not len(qi):
            continue
        score = (queries[qi] * vecs[at + vi]).sum(axis=1)
        best = [np.concatenate(x) for x in zip(best, (qi, vec_ids[at + vi], score), strict=True)]
        order = np.lexsort((best[1], -best[2], best[0]))
        best = [x[order] for x in best]
        rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[rank < s.k] for x in best]
        last = np.flatnonzero(rank[rank < s.k] == s.k - 1)
        tau[best[0][last]] = np.minimum(tau[best[0][last]], square[best[0][last]] - 2 * best[2][last])
    return pd.DataFrame({"query_id": query_ids[best[0]], "vec_id": best[1], "score": best[2]})


def nearest(base: DataFrame, is_query: Column, id_col: str = "vec_id", vec: str = "embedding", search: Search | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among all usable rows of base.

    Ties go to the smaller id. Null, empty or zero vectors, vectors with null or non-finite components, vectors
    of another length than most, and rows with a null id take no part. A row never finds rows of its own id;
    other rows that repeat an id stay candidates of their own. Extra columns are not read. No usable row, no rows.
    """
    s = search or Search()
    spark = base.sparkSession
    ship(spark)
    rows = base.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    shape = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).orderBy(F.desc("n"), "dims").first()
    none = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], none)
    dims, n, longest = shape["dims"], shape["n"], shape["longest"] * (1 + 1e-12)
    rows = rows.filter(F.size("v") == dims)
    lists = s.lists or int(min(4096, max(1, math.isqrt(n))))
    sample = np.array([r["v"] for r in rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(s.fit_rows).collect()])  # fit_rows at most
    centroids = fit(_longer(sample, longest), lists, s.seed)
    lists = len(centroids)
    probes = calibrated(sample, centroids, longest, s) if s.probes is None else max(1, math.ceil(s.probes * lists))
    rotation = np.linalg.qr(np.random.default_rng(s.seed).normal(size=(dims + 1, dims + 1)))[0]
    half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = np.argmax(_longer(_stacked(f["v"]), longest) @ centroids.T - half, axis=1)
                yield f.assign(list=near.astype(np.int32))

    def probing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = _stacked(f["v"])
                away = half - np.hstack([q, np.zeros((len(q), 1))]) @ centroids.T
                near = np.argsort(away, axis=1, kind="stable")[:, :probes]
                yield f.assign(list=list(near.astype(np.int32)))

    kept = cut(rows.mapInPandas(dealt, "vec_id long, v array<double>, q boolean, list int"))
    asked = kept.filter("q").select("vec_id", "v").mapInPandas(probing, "vec_id long, v array<double>, list array<int>")
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.posexplode("list").alias("place", "list")))
    counts = cut(kept.groupBy("list").agg(F.count("*").alias("n")))  # at most 4,096 rows
    key = ["list", "x", "y"]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.array([], "int64"), "vec_id": pd.array([], "int64"), "score": pd.array([], "float64")})
        return scan(a["vec_id"].to_numpy(), _stacked(a["v"]), b["query_id"].to_numpy(), _stacked(b["qv"]), b["known"].to_numpy(), rotation, longest, s)

    def search_lists(some: DataFrame) -> DataFrame:
        """Hits of (query_id, qv, list, known): chunks of a list's vectors meet chunks of the queries that probe it."""
        sizes = counts.join(some.groupBy("list").agg(F.count("*").alias("m")), "list")
        sizes = F.broadcast(cut(sizes.select("list", F.ceil(F.col("n") / s.chunk).cast("int").alias("vs"), F.ceil(F.col("m") / s.queries).cast("int").alias("qs"))))
        left = kept.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), "vs").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("y"), "vec_id", "v")
        right = some.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("x"), F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("y"), "query_id", "qv", "known")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(group, "query_id long, vec_id long, score double")

    # The nearest lists first, in full: what they hold bounds what the others need to be looked at for.
    lead = search_lists(asked.filter(F.col("place") < s.lead).withColumn("known", F.lit(float("-inf"))))
    lead = cut(lead.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= s.k).drop("rank"))
    known = lead.groupBy("query_id").agg(F.when(F.count("*") >= s.k, F.min("score")).otherwise(float("-inf")).alias("known"))
    rest = asked.filter(F.col("place") >= s.lead).join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    found = lead.unionByName(search_lists(cut(rest)))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
