"""Document lifecycle as table-to-table transformations; callers write what comes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.ordering import numbered


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base without the keys of new, and new (its last row per key by __seq, if there is one)."""
    if "__seq" in new.columns:
        w = Window.partitionBy(key).orderBy(F.desc("__seq"))
        new = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__seq")
    return base.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone, key, "left_anti")


def delete_everywhere(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of deleted documents."""
    return {n: delete(t, gone, key) for n, t in tables.items()}


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed, modified or same."""
    o, n = old.select(key, F.col(value).alias("__o"), F.lit(1).alias("__ho")), new.select(key, F.col(value).alias("__n"), F.lit(1).alias("__hn"))
    change = F.when(F.col("__ho").isNull(), "added").when(F.col("__hn").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "modified").otherwise("same")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def ingest(incoming: DataFrame, store: DataFrame, key: str = "name", hash_col: str = "content_hash") -> DataFrame:
    """incoming rows that the store doesn't hold, with version and prev_version of their name; a repeated hash is skipped."""
    known = store.select(hash_col).distinct()
    last = store.groupBy(key).agg(F.max("version").alias("prev_version"))
    w = Window.partitionBy(hash_col).orderBy(key)
    fresh = incoming.join(known, hash_col, "left_anti").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    n = F.row_number().over(Window.partitionBy(key).orderBy(hash_col))
    return fresh.join(last, key, "left").withColumn("version", F.coalesce("prev_version", F.lit(0)) + n).withColumn("status", F.lit("done"))


def approve(pending: DataFrame, decisions: DataFrame, store: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pending with status, store): approved documents replace their rows in the store, so that a repeat changes nothing."""
    p = pending.join(decisions, doc, "left").withColumn("status", F.coalesce("decision", F.lit("pending"))).drop("decision")
    ok = p.filter("status = 'approved'").drop("status")
    return p, delete(store, ok.select(doc).distinct(), doc).unionByName(ok, allowMissingColumns=True)


def rebuild(built: DataFrame, store: DataFrame, key: str = "chunk_id", upload: str = "is_upload") -> DataFrame:
    """A rebuilt store that keeps uploads whose ids it doesn't have."""
    return built.unionByName(store.filter(upload).join(built, key, "left_anti"), allowMissingColumns=True)


def counts_agree(*tables: DataFrame) -> bool:
    """Whether all tables have as many rows, and some."""
    n = [t.count() for t in tables]
    return n[0] > 0 and len(set(n)) == 1


# Transitions that a ticket may take.
TICKET_MOVES = (("open", "taken"), ("taken", "closed"), ("open", "closed"))


def move_tickets(tickets: DataFrame, wanted: DataFrame) -> DataFrame:
    """tickets (id, status) with the status wanted (id, to), where the move is allowed; moved tells."""
    may = reduce(lambda a, b: a | b, [(F.col("status") == s) & (F.col("to") == t) for s, t in TICKET_MOVES])
    t = tickets.join(wanted, "id", "left").withColumn("moved", F.coalesce(may, F.lit(False)))
    return t.withColumn("status", F.when(F.col("moved"), F.col("to")).otherwise(F.col("status"))).drop("to")


def promote(bad: DataFrame, golden: DataFrame, trace: str = "trace_id") -> DataFrame:
    """golden with the bad cases whose trace it lacks, in the order of traces, numbered on from its largest number."""
    top = golden.agg(F.coalesce(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")), F.lit(0)).alias("top")).first().top
    fresh = numbered(bad.join(golden, trace, "left_anti"), trace, name="__pos")
    fresh = fresh.withColumn("id", F.concat(F.lit("bad_"), (F.col("__pos") + top + 1).cast("string"))).drop("__pos")
    return golden.unionByName(fresh, allowMissingColumns=True)


def latest(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), seq).alias("__x")).select(key, "__x.*")


def task_upsert(tasks: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """tasks where new values that aren't null replace old ones; unknown tasks are added."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    j = tasks.join(n, key, "full_outer")
    return j.select(key, *[(F.coalesce(f"__{c}", c) if c in new.columns else F.col(c)).alias(c) for c in tasks.columns if c != key])


def relabel(rows: DataFrame, mapping: dict[str, str], col: str, drop: tuple[str, ...] = ()) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(col, F.coalesce(F.try_element_at(m, F.col(col)), F.col(col))).drop(*drop)


def backfill(rows: DataFrame, found: DataFrame, key: str, col: str) -> DataFrame:
    """rows with missing values of col taken from found."""
    f = found.select(key, F.col(col).alias("__f"))
    return rows.join(f, key, "left").withColumn(col, F.coalesce(col, "__f")).drop("__f")


def fold_sections(catalog: DataFrame, sections: DataFrame, key: str = "id") -> DataFrame:
    """catalog with sections array<struct<pos,title,body>> of each row."""
    s = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "body"))).alias("sections"))
    return catalog.join(s, key, "left")
