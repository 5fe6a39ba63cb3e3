"""Lists as a service shows them: pages, queues, merged lists, who may see what, and what a list lacks or gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ordering import last_of

# Intents whose answers change or failed, and marks of failed answers.
NEVER_CACHED = ("error", "order", "shipping", "refund", "complaint")
FAILED_WORDS = ("分析引擎出错",)
FAILED_STARTS = ("⚠️",)


def browse(chunks: DataFrame, order: str, page: int = 1, size: int = 20, source: str = "", **parts: str) -> DataFrame:
    """One page of chunks in order, with total, the number of all that match: source equals (if given), and each column
    of parts holds its text. A page behind the last has no rows."""
    found = chunks.filter(F.col("source") == source) if source else chunks
    for c, part in parts.items():
        found = found.filter(F.contains(F.coalesce(c, F.lit("")), F.lit(part))) if part else found
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    return found.orderBy(order).offset((page - 1) * size).limit(size).crossJoin(total)


def page_of(rows: DataFrame, order: str, size: int, skip: int = 0) -> DataFrame:
    """`size` rows after the first `skip`, last in the order first."""
    return rows.orderBy(F.desc(order)).offset(skip).limit(size)


def top_k(rows: DataFrame, score: str, place: str, k: int) -> DataFrame:
    """The k rows with the highest score; of equal ones those that came first."""
    return rows.orderBy(F.desc(score), place).limit(k)


def in_states(rows: DataFrame, status: str, states: Sequence[str]) -> DataFrame:
    """rows in one of the states; a null state is none."""
    return rows.filter(F.col(status).isin(*states))


def queue(rows: DataFrame, status: str, states: Sequence[str], n: int, *order: str) -> DataFrame:
    """The n newest rows in one of the states."""
    return in_states(rows, status, states).orderBy(*[F.desc(c) for c in order]).limit(n)


def tail(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows, in ascending order."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def cacheable(intent: Column, answer: Column, never: Sequence[str] = NEVER_CACHED, words: Sequence[str] = FAILED_WORDS, starts: Sequence[str] = FAILED_STARTS) -> Column:
    """Whether an answer may be kept: its intent isn't one of never, and it neither holds a word nor begins with a start
    that marks failures. A null intent or answer speaks against nothing."""
    a = F.coalesce(answer, F.lit(""))
    bad = F.coalesce(intent.isin(*never), F.lit(False))
    for w in words:
        bad = bad | F.contains(a, F.lit(w))
    for w in starts:
        bad = bad | F.startswith(a, F.lit(w))
    return ~bad


def with_downvote(traces: DataFrame, feedback: DataFrame, key: str = "trace_id", below: int = 0) -> DataFrame:
    """traces that some feedback (key, rating) rates below `below`."""
    return traces.join(feedback.filter(F.col("rating") < below).select(key), key, "left_semi")


def with_lowest(traces: DataFrame, feedback: DataFrame, key: str = "trace_id") -> DataFrame:
    """traces with lowest, their lowest rating; null without feedback."""
    return traces.join(feedback.groupBy(key).agg(F.min("rating").alias("lowest")), key, "left")


def vectors_of(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """chunks that have a vector, with it; columns that order the chunks come along."""
    return chunks.join(vectors, key)


def unknown(candidates: DataFrame, known: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """candidates that known doesn't have, each once: the one that comes first in order. Null equals null."""
    first = candidates.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in candidates.columns if c not in keys]), order).alias("__x"))
    k = known.select(*[F.col(c).alias(f"__k_{c}") for c in keys]).distinct()
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        same = one if same is None else same & one
    return first.join(k, same, "left_anti").select(*keys, "__x.*").select(*candidates.columns)


def owned(asked: DataFrame, orders: DataFrame, key: str, owner: str) -> DataFrame:
    """asked (key, me) with access: missing (no such order), denied (another's) or ok; a null me may see all."""
    o = orders.select(key, F.col(owner).alias("__owner"), F.lit(True).alias("__there"))
    access = F.when(F.col("__there").isNull(), "missing").when((F.col("me") != F.col("__owner")), "denied").otherwise("ok")
    return asked.join(o, key, "left").withColumn("access", access).drop("__owner", "__there")


def scoped(rows: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """rows of the users asked for, and of nobody else; a user asked for twice gets them twice."""
    return users.select(key).join(rows, key)


def question_candidates(entities: DataFrame, chunks: DataFrame, key_types: Sequence[str], least: int = 40) -> DataFrame:
    """question, chunk_id: questions made from the entities of chunks that can answer them, each once.

    entities: chunk_id, at, question, entities array<struct<name, type>>; chunks: chunk_id, content. The chunk must be
    there with `least` characters, ends stripped, and hold the name of an entity of key_types, if there is one. Of equal
    questions the first in order of at stays; null and empty ones are none.
    """
    names = F.transform(F.filter(F.coalesce("entities", F.array().cast(dict(entities.dtypes)["entities"])), lambda e: e["type"].isin(*key_types)), lambda e: e["name"])
    both = entities.filter("question <> ''").join(chunks.select("chunk_id", F.trim("content").alias("__c")), "chunk_id").filter(F.length("__c") >= least)
    told = both.filter((F.size(names) == 0) | F.exists(names, lambda n: F.contains(F.col("__c"), n)))
    return told.groupBy("question").agg(F.min_by("chunk_id", "at").alias("chunk_id"))


def ticket_context(tickets: DataFrame, turns: DataFrame, key: str, seq: str, n: int = 6) -> DataFrame:
    """tickets with context: the last n turns of their session, oldest first; empty without any."""
    kept = [c for c in turns.columns if c != key]
    last = last_of(turns, [key], n, F.desc(seq)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, *[c for c in kept if c != seq]))).alias("context"))
    return tickets.join(last, key, "left").withColumn("context", F.coalesce("context", F.array().cast(dict(last.dtypes)["context"])))


def on_disk(files: DataFrame, documents: DataFrame) -> DataFrame:
    """files (path, ...) with name, in_db (whether a document of that filename is stored) and unprocessed, the number of those
    that aren't."""
    stored = documents.select(F.col("filename").alias("name")).distinct().withColumn("__there", F.lit(True))
    rows = files.withColumn("name", F.regexp_extract("path", "([^/\\\\]*)$", 1)).join(stored, "name", "left").withColumn("in_db", F.col("__there").isNotNull()).drop("__there")
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.when(~F.col("in_db"), 1)).alias("unprocessed"))))  # one row


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key it doesn't have."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def key_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change: keys that only old has (removed) and that only new has (added)."""
    o, n = old.select(key).distinct(), new.select(key).distinct()
    return o.join(n, key, "left_anti").withColumn("change", F.lit("removed")).unionByName(n.join(o, key, "left_anti").withColumn("change", F.lit("added")))


def merge_distinct(lists: DataFrame, chars: int = 50) -> DataFrame:
    """key, qid, cid, content, at: retrieved rows (qid, list, pos, cid, content) of each question, once each: by cid or, without one,
    by the first characters of the content. The one of the earliest list and place stays."""
    key = F.coalesce(F.col("cid").cast("string"), F.substring("content", 1, chars))
    best = lists.withColumn("key", key).groupBy("qid", "key").agg(F.min(F.struct("list", "pos")).alias("at"), F.min_by(F.struct("cid", "content"), F.struct("list", "pos")).alias("x"))
    return best.select("qid", "key", "x.cid", "x.content", "at")


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: the distinct values of each key in the order in which they come first. Nulls are left out."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("at"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", value))).alias("v")).select(key, F.transform("v", lambda x: x[value]).alias("values"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, by column name, each once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def injected(entries: DataFrame, local: DataFrame, most: int = 3) -> DataFrame:
    """Graph entries (qid, pos, source) whose source isn't among those of the question's local chunks (qid, source): the first
    `most` of each question."""
    new = entries.join(local.select("qid", "source").distinct(), ["qid", "source"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).filter(F.col("n") <= most)


def product_triples(catalog: DataFrame, domain: DataFrame, canon: dict[str, str] | None = None) -> DataFrame:
    """head, relation, tail: hand-written triples (domain) and three of each product of the catalog (id, name, type, risk, insured).

    A type is its part before a parenthesis, by its canonical name where canon has one. Products without an id give none;
    triples that are there already come once.
    """
    kind = F.trim(F.split(F.coalesce("type", F.lit("")), "[（(]")[0])
    if canon:
        kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in canon.items() for x in kv]), kind), kind)
    insured = F.when(F.coalesce("insured", F.lit(False)), "是").otherwise("否")
    each = F.array(*[F.struct(F.lit(r).alias("relation"), t.alias("tail")) for r, t in (("is_type_of", kind), ("risk_level", F.coalesce("risk", F.lit(""))), ("deposit_insured", insured))])
    made = catalog.filter("id is not null").select(F.col("name").alias("head"), F.explode(each).alias("t")).select("head", "t.*")
    return domain.select("head", "relation", "tail").unionByName(made).distinct()


def migrate(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """table with every column of columns (name: type and default) that it lacks; a second time changes nothing."""
    return table.withColumns({n: F.lit(d).cast(t) for n, (t, d) in columns.items() if n not in table.columns})


def true_count(stored: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """stored, deleted, live: rows, those whose key has a tombstone, and the others."""
    t = tombstones.select(key).distinct().withColumn("__gone", F.lit(True))
    gone = F.count(F.when(F.col("__gone"), 1))
    return stored.select(key).join(t, key, "left").agg(F.count("*").alias("stored"), gone.alias("deleted"), (F.count("*") - gone).alias("live"))
