"""File sources and sinks: JSON lines, logs, markdown, settings, staged table swaps."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.chunking import long_enough


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; corrupt lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Appends JSON lines; a failed job leaves no part of itself."""
    df.write.mode("append").json(path)


def read_documents(spark: SparkSession, path: str, parse=None, schema: str = "path string, page int, text string", least: int = 30) -> DataFrame:
    """Pages of files: read as bytes, parsed by `parse` (frames of path, content -> frames of schema); short pages go.

    The default parser takes each file as one page of UTF-8 text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if parse is None:
        pages = files.select("path", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"))
    else:
        pages = files.mapInPandas(parse, schema)
    return long_enough(pages, least)


def check_uploads(files: DataFrame, known: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """path, content_hash, size, outcome of files (path, content_hash, size) against known content hashes: too_large,
    duplicate (of a known file, or of an accepted one whose path sorts before) or accepted."""
    k = known.select("content_hash").distinct().withColumn("seen", F.lit(True))
    first = files.filter(F.col("size") <= most_bytes).groupBy("content_hash").agg(F.min("path").alias("first"))
    out = F.when(F.col("size") > most_bytes, "too_large").when(F.col("seen") | (F.col("path") != F.col("first")), "duplicate").otherwise("accepted")
    return files.join(k, "content_hash", "left").join(first, "content_hash", "left").select("path", "content_hash", "size", out.alias("outcome"))


def uploads(spark: SparkSession, path: str, known: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """path, content_hash, size, outcome of the files of a folder, as `check_uploads` tells it."""
    return check_uploads(spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size")), known, most_bytes)


def parse_logs(lines: DataFrame) -> DataFrame:
    """Structured log lines (value) as timestamp, level, message, trace_id, path, status, latency_ms, ttfb_ms, stream: fields of a
    message are JSON or 'name=value'. Lines that aren't JSON, and those without a message, are left out."""
    line = "timestamp string, level string, message string, trace_id string, path string, status int, latency_ms double, ttfb_ms double, stream boolean"
    j = lines.select(F.from_json("value", line).alias("j")).select("j.*").filter("message is not null")
    return j.withColumn("latency_ms", F.coalesce("latency_ms", F.expr("try_cast(nullif(regexp_extract(message, 'latency_ms=([0-9.]+)', 1), '') as double)")))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The log lines of files, as `parse_logs` gives them."""
    return parse_logs(spark.read.text(path))


def render_products(parts: DataFrame) -> DataFrame:
    """Catalog rows (id, name, type, risk, sections array<struct<title,body>>) as chunks: a head and one per section."""
    head = F.struct(F.lit("overview").alias("title"), F.concat_ws(" ", "type", "risk").alias("body"))
    return parts.select("id", F.posexplode(F.concat(F.array(head), F.coalesce("sections", F.array().cast("array<struct<title:string,body:string>>")))).alias("n", "s"), "name").select(
        F.concat(F.col("id").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("chunk_id"), F.col("s.title").alias("section"), F.concat(F.lit("["), "name", F.lit("] "), "s.body").alias("content")
    )


def swap(df: DataFrame, path: str, least_rows: int = 1, equal_to: dict[str, int] | None = None) -> int:
    """Writes a staged copy, checks its count, then replaces path; on a failed check path stays as it was.

    equal_to: counts by name that must equal the staged one (vectors, index, chunks).
    """
    spark = df.sparkSession
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.parquet(staged).count()
    off = {k: v for k, v in (equal_to or {}).items() if v != n}
    if n < least_rows or off:
        raise ValueError(f"staged {n} rows; at least {least_rows}; unequal: {off}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(conf)
    old = p(f"{path}.old")
    fs.delete(old, True)
    if fs.exists(p(path)):
        fs.rename(p(path), old)
    fs.rename(p(staged), p(path))
    fs.delete(old, True)
    return n


@dataclass(frozen=True)
class Settings:
    """Chunking and retrieval settings, validated by validate()."""

    chunk_size: int = 350
    overlap: int = 70
    max_content: int = 150
    top_k: int = 5
    pool: int = 15
    mmr_lambda: float = 0.5
    rrf_k: int = 60


RANGES = {"chunk_size": (50, 4000), "overlap": (0, 1000), "max_content": (20, 4000), "top_k": (1, 50), "pool": (1, 500), "mmr_lambda": (0.0, 1.0), "rrf_k": (1, 1000)}


def validate(s: Settings) -> Settings:
    """s, or ValueError naming every setting out of range or at odds with another."""
    bad = []
    for f in fields(s):
        v = getattr(s, f.name)
        lo, hi = RANGES[f.name]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not lo <= v <= hi:
            bad.append(f.name)
    if not bad:
        bad += ["overlap"] * (s.overlap >= s.chunk_size) + ["max_content"] * (s.max_content > s.chunk_size) + ["pool"] * (s.pool <= s.top_k)
    if bad:
        raise ValueError("settings: " + ", ".join(bad))
    return s


def load_settings(text: str | None) -> Settings:
    """Settings from JSON over the defaults; unknown names are left out."""
    given = json.loads(text) if text else {}
    return validate(replace(Settings(), **{k: v for k, v in given.items() if k in RANGES}))


def settings_diff(s: Settings) -> list[str]:
    """Names, sorted, of settings that differ from the defaults."""
    return sorted(k for k, v in asdict(s).items() if v != asdict(Settings())[k])
