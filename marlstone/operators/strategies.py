"""Ways to gather what a question is answered from: the same lists, fused, spread and filled up differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import resolve
from marlstone.operators.retrieval import mmr, rrf
from marlstone.session import cut

# Mark and separator of graph evidence, and the form of a number in an answer.
EVIDENCE_MARK = "【关系推理】"
EVIDENCE_GAP = "；"
NUMBER = r"[\d.]+"
STRATEGIES = ("vector", "hybrid", "hybrid_mmr", "graph", "agentic", "audited")


def evidence(questions: DataFrame, triples: DataFrame, gap: str = EVIDENCE_GAP, mark: str = EVIDENCE_MARK) -> DataFrame:
    """qid, sentence: all triples (pos, head, relation, tail) whose head or tail a question (qid, text) names, in order of pos, as
    one sentence. Names are met by their first characters; questions that name nothing have no row."""
    names = triples.select(F.col("head").alias("entity")).unionByName(triples.select(F.col("tail").alias("entity"))).distinct().withColumn("alias", F.col("entity"))
    met = resolve(questions, names, most=1 << 30, id_col="qid").select("qid", "entity")
    either = triples.select("*", F.explode(F.array_distinct(F.array("head", "tail"))).alias("entity"))
    hits = met.join(either, "entity").select("qid", "pos", F.concat_ws(" ", "head", "relation", "tail").alias("s")).distinct()
    # Sentences of one question are one output row.
    told = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("all"))
    return told.select("qid", F.concat(F.lit(mark), F.array_join(F.transform("all", lambda x: x["s"]), gap)).alias("sentence"))


def contexts(dense_list: DataFrame, sparse_list: DataFrame, vectors: DataFrame, asked: DataFrame, told: DataFrame, k: int = 2, pool: int = 10, tool: int = 3, wanted: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """strategy, qid, rank, cid, sentence: what each strategy answers a question from.

    vector and audited: the k best of the dense list; hybrid: the k best of both lists fused; hybrid_mmr: `pool` fused
    ones, of which k diverse ones; graph: the same, and behind them the sentence of told (qid, sentence), without a
    cid; agentic: what a search tool hands over, `tool` fused ones. Lists are qid, cid, score, rank; vectors: cid, v;
    asked: qid, qv. Chunks without a vector take no part in hybrid_mmr and graph.
    """
    fused = cut(rrf([dense_list, sparse_list], max(pool, k, tool)))
    diverse = cut(mmr(fused.join(vectors, "cid").join(asked, "qid").filter(F.col("rank") <= pool), k))
    row = lambda d, name: d.select(F.lit(name).alias("strategy"), "qid", F.col("rank").cast("int").alias("rank"), "cid", F.lit(None).cast("string").alias("sentence"))
    first = lambda d, n: d.filter(F.col("rank") <= n)
    lists = {"vector": first(dense_list, k), "hybrid": first(fused, k), "hybrid_mmr": diverse, "graph": diverse, "agentic": first(fused, tool), "audited": first(dense_list, k)}
    out = None
    for name in wanted:
        one = row(lists[name], name)
        if name == "graph":
            n = diverse.groupBy("qid").agg(F.max("rank").alias("n"))
            cid = F.lit(None).cast(dict(diverse.dtypes)["cid"]).alias("cid")
            one = one.unionByName(told.join(n, "qid", "left").select(F.lit(name).alias("strategy"), "qid", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank"), cid, "sentence"))
        out = one if out is None else out.unionByName(one)
    return out


def strange_numbers(answer: Column, context: Column) -> Column:
    """Numbers of two characters or more in an answer that its context doesn't hold, in their order."""
    return F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: (F.length(x) > 1) & ~F.contains(F.coalesce(context, F.lit("")), x))


def audited(attempts: DataFrame, context: DataFrame, retries: int = 2) -> DataFrame:
    """qid, attempt, answer, passed, strange: the first of a question's attempts (qid, attempt from 0, answer) whose numbers all stand in its
    context (qid, text), or the last one, where none within the retries does. strange: the first number that doesn't."""
    tries = attempts.filter(F.col("attempt") <= retries).join(context, "qid", "left")
    tries = tries.withColumn("strange", F.try_element_at(strange_numbers(F.col("answer"), F.col("text")), F.lit(1)))
    passed = F.col("strange").isNull()
    order = F.struct((~passed).alias("bad"), F.when(passed, F.col("attempt")).otherwise(-F.col("attempt")).alias("at"))
    best = tries.groupBy("qid").agg(F.min_by(F.struct("attempt", "answer", passed.alias("passed"), "strange"), order).alias("x"))
    return best.select("qid", "x.*")
