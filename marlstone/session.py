"""Session builder and table loader shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "marlstone", **conf: str) -> SparkSession:
    """A local session with UTC timestamps and adaptive execution.

    On a cluster the caller passes its own session; nothing in the library builds one.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or one of our own where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marlstone-ckpt-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own, for a table, in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session; harmless where it is installed there."""
    if getattr(spark.sparkContext, "_marlstone_shipped", False):
        return
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(here, f"{d}/src/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", f"{d}/src")
    spark.sparkContext.addPyFile(made)
    spark.sparkContext._marlstone_shipped = True
