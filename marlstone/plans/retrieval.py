"""Ranked retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import terms as te
from marlstone.functions import text as tx
from marlstone.operators import matching as ma
from marlstone.operators import models as mo
from marlstone.operators import retrieval as r
from marlstone.operators import textindex as ti
from marlstone.operators import vectors as ve
from marlstone.plans.registry import ORACLES, plan, sql
from marlstone.plans.rules import VOCABULARY, strong_sql, terms_sql
from marlstone.session import cut, scratch, table

QUESTIONS = ("the thing of threads", "ouble edout whhe", "and is nded be enhe", "der die das ungen", "que les aux entre")
_Q = " UNION ALL ".join(f"SELECT {i} AS qid, '{t}' AS text" for i, t in enumerate(QUESTIONS))
_TOK = "regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')"
_BM = f"""
WITH q AS (SELECT DISTINCT qid, unnest({_TOK}) AS term FROM ({_Q}) x),
t AS (SELECT doc_id AS cid, {_TOK} AS ts FROM documents),
d AS (SELECT cid, len(ts) AS dl, len(list_distinct(ts)) AS du FROM t),
c AS (SELECT count(*) AS n, avg(du) AS avgdl FROM d),
p AS (SELECT term, cid, count(*) AS tf FROM (SELECT cid, unnest(ts) AS term FROM t) z WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY term, n),
s AS (SELECT qid, cid, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN q USING (term) JOIN i USING (term) JOIN d USING (cid), c GROUP BY qid, cid)"""


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(QUESTIONS)], "qid long, text string")


def _index(spark: SparkSession, sf_dir: str) -> ti.TextIndex:
    """The stored index of the documents: made by the first query that asks for it."""
    return ti.stored(spark, table(spark, sf_dir, "documents"), "doc_id")


def _search(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _index(spark, sf_dir).search(_queries(spark), k)


def _top(df: DataFrame) -> DataFrame:
    return df.select("qid", "cid", F.round("score", 6).alias("score"))


@plan("r1_bm25_search", _BM + " SELECT qid::BIGINT AS qid, cid, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) <= 10")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each question by BM25."""
    return _top(_search(spark, sf_dir, 10))


@plan("r10_canary", _BM + " SELECT (SELECT n FROM c) AS chunks, EXISTS (SELECT 1 FROM s WHERE qid = 0) AS answered")
def canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of an index that answers its probe; an empty or silent index is an error."""
    idx = _index(spark, sf_dir)
    r.canary(idx, QUESTIONS[0])
    return spark.range(1).select(F.lit(idx.corpus()[0]).cast("long").alias("chunks"), F.lit(True).alias("answered"))


@plan("s14_index_round_trip", _BM.replace("FROM documents", "FROM documents WHERE doc_id % 10 <> 3") + " SELECT qid::BIGINT AS qid, cid, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) <= 10")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index stored from the even documents, opened again, grown by the odd ones and some of those it had, and with a
    tenth taken out: it answers as one made of what is left."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text")
    path = scratch(spark, "round-trip")
    ti.TextIndex.create(docs.filter("cid % 2 = 0"), path)
    grown = ti.TextIndex(spark, path).append(docs.filter("cid % 2 = 1 or cid % 6 = 0"))
    return _top(grown.delete(docs.filter("cid % 10 = 3")).search(_queries(spark), 10))


@plan("a11_bm25_statistics", f"""WITH t AS (SELECT doc_id, {_TOK} AS ts FROM documents), n AS (SELECT count(*) AS n FROM t)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6)::DOUBLE AS idf FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS term FROM t) x GROUP BY term) y, n""")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies and weights of all terms."""
    return r.index(table(spark, sf_dir, "documents"), "doc_id")["terms"].select("term", "df", F.round("idf", 6).alias("idf"))
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_DENSE = f"""SELECT a.vec_id AS qid, b.vec_id AS cid, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= {{k}}"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return ve.search(e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v")), q, k)


@plan("r2_dense_search", _DENSE.format(k=10))
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by cosine of the vectors whose id is divisible by 20."""
    return _top(_dense(spark, sf_dir, 10))


@plan("s9_vector_collection", _DENSE.replace("a.vec_id % 20 = 0", "a.vec_id % 20 = 0 AND b.vec_id % 7 <> 5").format(k=10))
def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection stored from two thirds of the vectors, opened again, grown by the others and some of those it had, with
    some taken out, and searched exactly: lists that can't hold a near vector stay closed."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v"))
    path = scratch(spark, "collection")
    ve.Collection.create(e.filter("cid % 3 <> 1"), path)
    held = ve.Collection(spark, path).insert(e.filter("cid % 3 = 1 or cid % 11 = 0")).delete(e.filter("cid % 7 = 5"))
    return _top(held.search(e.filter("cid % 20 = 0").select(F.col("cid").alias("qid"), F.col("v").alias("qv")), 10, exact=True))


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    hits = _dense(spark, sf_dir, k)
    return hits.join(e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v")), "cid").join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), "qid")


@plan("r3_dense_mmr")
def dense_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen nearest, of which five diverse ones."""
    return r.mmr(_candidates(spark, sf_dir, 15), 5)


@plan("r4_mmr")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance that minds relevance more than diversity."""
    return r.mmr(_candidates(spark, sf_dir, 30), 10, 0.7)


def _two(spark: SparkSession, sf_dir: str, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists per question: the vectors nearest to the question's (that of id 20 times its own), and BM25."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id").isin([20 * i for i in range(len(QUESTIONS))])).select((F.col("vec_id") / 20).cast("long").alias("qid"), F.col("embedding").alias("qv"))
    near = ve.search(e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v")), asked, k)
    return near, _search(spark, sf_dir, k)


def _lists(k: int) -> str:
    return f""",
l AS (SELECT qid::BIGINT AS qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank FROM s QUALIFY rank <= {k}),
o AS (SELECT a.vec_id // 20 AS qid, b.vec_id AS cid, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b
  WHERE a.vec_id % 20 = 0 AND a.vec_id < {20 * len(QUESTIONS)} QUALIFY rank <= {k}),
x AS (SELECT qid, cid, rank, 1 AS path FROM l UNION ALL SELECT qid, cid, rank, 0 FROM o),
f AS (SELECT qid, cid, sum(1.0::DOUBLE / (60 + rank)) AS score, min({{'path': path, 'rank': rank}}) AS seen FROM x GROUP BY qid, cid)"""


@plan("r5_rrf", _BM + _lists(15) + " SELECT qid, cid, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen, cid) <= 5")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of two lists."""
    return _top(r.rrf(list(_two(spark, sf_dir)), 5))


@plan("r7_provenance", _BM + _lists(15) + """ SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.cid, b.cid) AS cid, a.rank AS dense_rank, b.rank AS sparse_rank,
CASE WHEN a.rank IS NULL THEN 'sparse' WHEN b.rank IS NULL THEN 'dense' ELSE 'both' END AS found_by
FROM o a FULL OUTER JOIN l b ON a.qid = b.qid AND a.cid = b.cid""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which list found what, at which rank."""
    return r.provenance(*_two(spark, sf_dir))


def _reranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("content"))
    q = _queries(spark).select("qid", te.asked(F.col("text"), VOCABULARY).alias("x")).select("qid", F.concat("x.strong", "x.terms").alias("terms"))
    return r.rerank(_search(spark, sf_dir, 20).join(docs, "cid").join(q, "qid"), k)


_ASKED = f"list_concat({strong_sql('x.text')}, {terms_sql('x.text')})"


@plan("r8_lexical_rerank", _BM + f""",
l AS (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM s QUALIFY rank <= 20),
n AS (SELECT l.qid, cid, rank, 0.6 * len(list_filter({_ASKED}, lambda t: contains(lower(documents.text), lower(t)))) / greatest(len({_ASKED}), 1) + 0.4 * least(score / top, 1.0) AS score
  FROM l JOIN ({_Q}) x ON x.qid = l.qid JOIN documents ON doc_id = cid)
SELECT qid::BIGINT AS qid, cid, round(score, 6)::DOUBLE AS score FROM n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, rank) <= 5""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical rerank of twenty candidates."""
    return _top(_reranked(spark, sf_dir, 5))


_XTOK = _TOK.replace("text", "y.text")


@plan("r6_hybrid", _BM + _lists(60) + f""",
pool AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen, cid) AS rank FROM f QUALIFY rank <= 20),
n AS (SELECT pool.qid, cid, source, rank, count(*) OVER (PARTITION BY pool.qid) AS n, score AS old,
  0.6 * len(list_filter({_XTOK}, lambda t: contains(lower(documents.text), t))) / len({_XTOK}) + 0.4 * least(score / max(score) OVER (PARTITION BY pool.qid), 1.0) AS new FROM pool JOIN ({_Q}) y ON y.qid = pool.qid JOIN documents ON doc_id = cid),
b AS (SELECT qid, cid, source, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN n <= 5 THEN old ELSE new END, 12) DESC, rank) AS at_rank FROM n QUALIFY at_rank <= 5),
e AS (SELECT n_nationkey % 5 AS qid, n_nationkey AS pos, 'src' || n_nationkey AS source FROM nation WHERE n_nationkey % 2 = 0),
g AS (SELECT qid, source, 5 + row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM e WHERE qid <> 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.qid = e.qid AND b.source = e.source)),
u AS (SELECT qid, cid - cid % 3 AS cid, min(at_rank) AS place FROM b GROUP BY 1, 2),
z AS (SELECT u.qid, place, u.cid, source, 'text' AS origin FROM u LEFT JOIN documents ON doc_id = u.cid UNION ALL SELECT qid, place, NULL, source, 'graph' FROM g WHERE place <= 8)
SELECT qid::BIGINT AS qid, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank, cid, source, origin, qid NOT IN (SELECT qid FROM l) AS sparse_empty FROM z""")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and lexical lists, fused, reranked, graph entries added, children replaced by parents."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("cid"), "source", F.col("text").alias("content"))
    parents = docs.select(F.col("doc_id").alias("cid"), (F.col("doc_id") - F.col("doc_id") % 3).alias("parent"))
    entries = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select((F.col("n_nationkey") % 5).cast("long").alias("qid"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("src"), F.col("n_nationkey")).alias("source"))
    q = _queries(spark).select("qid", tx.tokens(F.col("text")).alias("terms"), (F.col("qid") != 3).alias("relational"))
    return r.hybrid(*_two(spark, sf_dir, 60), chunks, q, entries, parents)


@plan("r11_cache_tiers")
def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, user turns whose id is divisible by 20, looked up among all user turns: exact, similar, near."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", "turn")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = c.join(e, F.col("id") % max(1, e.count()) == F.col("vec_id")).withColumn("at", F.col("turn") * 60)
    q = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "text", F.col("embedding").alias("qv"), (F.col("at") + 600).alias("at"))
    entries = rows.select(F.col("id").alias("key"), "text", F.col("embedding").alias("v"), F.col("at").alias("created"))
    return r.cache_lookup(q, entries, lambda t: tx.cache_features(t, [["the", "les"]], [], {"buy": ("buy",), "sell": ("sell",)}), tx.feature_similarity)


@plan("r13_memory_recall", f"""SELECT a.vec_id AS qid, b.vec_id AS cid, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 2""")
def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest memories of the same user (label)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")
    pairs = e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("v"), "label").join(q, "label").filter("qid <> cid")
    return _top(r.ranked(pairs.select("qid", "cid", tx.cosine(F.col("v"), F.col("qv")).alias("score")), 2))


@plan("r14_centroid_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy centroid clusters within each label."""
    return r.centroid_clusters(table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("part"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 0.3)


_ONE = "e AS (SELECT min(vec_id) AS vec_id, count(*) AS n, embedding FROM embeddings GROUP BY embedding)"
_NEAR = f"""WITH {_ONE}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS s, a.n AS n_a, b.n AS n_b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE {_COS} >= {{t}} UNION ALL SELECT vec_id, vec_id, 1.0, n, n FROM e WHERE n > 1)
SELECT a, b, round(s, 6) AS score, n_a, n_b FROM p"""


def _pairs(spark: SparkSession, sf_dir: str, least: float, top: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ve.near_pairs(e, least, top).withColumn("score", F.round("score", 6))


@plan("j5_theta_near_duplicates", _NEAR.format(t=0.25))
def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all vectors whose cosine is 0.25 or more."""
    return _pairs(spark, sf_dir, 0.25)


@plan("l4_top_pairs", _NEAR.format(t=0.2) + " ORDER BY s DESC, a, b LIMIT 200")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 nearest pairs."""
    return _pairs(spark, sf_dir, 0.2, 200)


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+'))"


@plan("j13_leak", f"""WITH b AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
i AS (SELECT item_id, doc_id, count(*) AS c FROM b JOIN d USING (w) GROUP BY 1, 2)
SELECT item_id, doc_id, round(c / (bn.n + dn.n - c)::DOUBLE, 6) AS best FROM i JOIN bn USING (item_id) JOIN dn USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c / (bn.n + dn.n - c)::DOUBLE DESC, doc_id) = 1""")
def leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document whose words are most like each benchmark item's, and their Jaccard similarity."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return ma.best_match(items, docs, tx.tokens).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("best"))


sql("j10_golden_rank", """
WITH g AS (SELECT vec_id, label FROM {embeddings}), ret AS (SELECT label AS qid, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM {embeddings})
SELECT ret.qid, min(rank) AS first_rank, count(*) AS overlap FROM ret JOIN g ON g.vec_id = ret.vec_id AND g.vec_id % 4 = 0 GROUP BY ret.qid""")


@plan("r12_gateway_cache")
def gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns whose id is divisible by 20, looked up among all user turns by the vectors of their texts."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("key"), "text", F.lit(0).alias("created"))
    entries = cut(mo.encode(c))
    asked = entries.filter("key % 20 = 0").select(F.col("key").alias("qid"), "text", F.col("v").alias("qv"), F.lit(60).alias("at"))
    return r.gateway_lookup(asked, entries)


@plan("r9_pair_scores")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of the 40 BM25 candidates of each question by a scorer of pairs."""
    hits = _search(spark, sf_dir, 40).select("qid", "cid")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("text").alias("content"))
    return _top(mo.rescore(hits.join(docs, "cid").join(_queries(spark).withColumnRenamed("text", "query"), "qid")))


@plan("x5_encode", "SELECT doc_id, 256 AS dims, CASE WHEN regexp_matches(lower(text), '[0-9a-z_]|[\u4e00-\u9fff]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents: their dimensions and lengths."""
    v = mo.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return v.select("doc_id", F.size("v").alias("dims"), F.round(F.sqrt(tx.dot(F.col("v"), F.col("v"))), 5).alias("norm"))
