"""Helpers shared by the operators of this subpackage: words, spans in code points, durable cuts."""

from __future__ import annotations

import inspect
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Elements per block of a running sum (see spans_of): keeps appends in a fold linear.
BLOCK = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marlstone-ckpt-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet under the shared checkpoint folder and read back: for wide rows."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that this worker has freed to the system: idle workers keep their heap otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def leaving_nothing(run):
    """run, a function of an iterator of batches or of a group's frame, giving memory back when its task (or group) is done."""

    def batches(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    def group(frame):
        try:
            return run(frame)
        finally:
            give_back()

    return batches if inspect.isgeneratorfunction(run) else group


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+", -1))


def n_words_of(text: Column) -> Column:
    """Number of words of a text as long."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WS + "+", -1))).cast("long")


SPAN = "struct<s:int,e:int,m:string>"


def running(steps: Column, zero: Column, step, kind: str) -> Column:
    """Values of a fold over an array after each of its elements: step(value, element), of SQL type kind.

    Folded block by block: appending to one long array in a fold would cost the square of its length.
    """
    none = F.array().cast(f"array<{kind}>")

    def fold(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))

        def block(acc: Column, blk: Column) -> Column:
            one = lambda a, g: F.struct(step(a["at"], g).alias("at"), F.concat(a["out"], F.array(step(a["at"], g))).alias("out"))
            inner = F.aggregate(blk, F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        return F.flatten(F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), block)["out"])

    return let(steps, lambda x: F.when(F.size(x) == 0, none).otherwise(fold(x)))


def running_sums(steps: Column) -> Column:
    """Inclusive running sums of an array<int>."""
    return running(steps, F.lit(0), lambda a, g: a + g, "int")


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of pattern as array<struct<s,e,m>>: start and end in code points, match.

    Positions are running sums over the lengths of the gaps between matches and of the matches.
    """
    empty = F.array().cast(f"array<{SPAN}>")

    def located(m: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        placed = F.zip_with(running_sums(steps), m, lambda e, x: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m")))
        return F.when(F.size(m) == 0, empty).otherwise(placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined, of array<struct<s,k,e,kind>> in its natural order."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
