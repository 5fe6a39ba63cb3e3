"""How plans are registered."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import table

QUERIES: dict = {}
ORACLES: dict = {}
_TABLE = re.compile(r"\{(\w+)\}")


def sql(name: str, text: str, duck: str | None = None, doc: str = "") -> None:
    """A plan in SQL: {table} stands for a table. duck: DuckDB's text, where its dialect differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(text))})

    run.__doc__ = doc
    QUERIES[name] = run
    ORACLES[name] = _TABLE.sub(r"\1", duck or text)


def plan(name: str, duck: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; duck: the same in DuckDB SQL."""

    def register(fn):
        QUERIES[name] = fn
        if duck:
            ORACLES[name] = duck
        return fn

    return register
