"""Connected components of an edge table, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of edges reaches (itself included).

    Every round is a few joins and aggregations of narrow rows, cut by a checkpoint; nothing but two numbers per
    round comes to the driver. Loops and repeated edges don't matter; rows with a null end are left out.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} is not null and {b} is not null").distinct())
    nodes = cut(e.select("u").union(e.select("v")).distinct())
    e = cut(e.filter("u <> v"))
    seen = None
    while True:
        # Large star: each larger neighbour of u is tied to the smallest node that u or its neighbours are.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), nodes["u"] == F.col("node"), "left").select(nodes["u"].alias("node"), F.coalesce("root", nodes["u"]).alias("root"))
