"""Places in a global order, without a window that puts all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """rows with name: their place, from 0, in the order given (rows that it doesn't tell apart in any order).

    Rows are dealt by ranges of the order and numbered within them, on from the rows of the ranges before. A key that
    many rows share makes one range: ties that matter in size need a further column.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    per = dealt.groupBy("__pid").agg(F.count("*").alias("__n"))
    # One row for each partition.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = F.broadcast(per.select("__pid", before.alias("__before")))
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(per, "__pid").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__pid", "__own", "__before")


def sequence(rows: DataFrame, group: list[str], order: list[Column], **running: tuple[str, Column]) -> DataFrame:
    """rows with pos, their place (from 0) in their group, in ascending order, and for each name of running its value there.

    running: (kind, column), over the rows of the group up to and including this one: sum, max, last (that isn't null),
    or lag (of the row before). A group is split over ranges of its order: within a range values run as in a window, and
    each range is carried on from those before it by one row for each group and range. No group is in one task.
    """
    named = rows.select("*", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o"), *[c.alias(f"__c_{n}") for n, (_, c) in running.items()])
    dealt = cut(named.repartitionByRange(*group, "__o").withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy("__pid", *group).orderBy("__o")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    own, carried, before = [F.row_number().over(local).alias("__at")], [F.count("*").alias("__n")], {}
    ahead = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in running.items():
        c = F.col(f"__c_{name}")
        here, there = f"__l_{name}", f"__b_{name}"
        if kind == "sum":
            own.append(F.sum(c).over(upto).alias(here))
            carried.append(F.sum(c).alias(there))
            before[name] = F.sum(there).over(ahead)
        elif kind == "max":
            own.append(F.max(c).over(upto).alias(here))
            carried.append(F.max(c).alias(there))
            before[name] = F.max(there).over(ahead)
        elif kind == "last":
            own.append(F.last(c, ignorenulls=True).over(upto).alias(here))
            carried.append(F.max_by(c, F.when(c.isNotNull(), F.col("__o"))).alias(there))
            before[name] = F.last(there, ignorenulls=True).over(ahead)
        elif kind == "lag":
            own.append(F.lag(c).over(local).alias(here))
            carried.append(F.max_by(F.struct(c.alias("x")), F.col("__o")).alias(there))
            before[name] = F.last(there).over(ahead)["x"]
        else:
            raise ValueError(f"no running value {kind!r}")
    per = dealt.groupBy("__pid", *group).agg(*carried)
    per = per.select(F.col("__pid").alias("__seq_pid"), *[F.col(g).alias(f"__g_{g}") for g in group], F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), *[b.alias(f"__a_{n}") for n, b in before.items()])
    same = F.col("__pid") == F.col("__seq_pid")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    both = dealt.select("*", *own).join(per, same)
    out = [F.col(f"`{c}`") for c in rows.columns] + [(F.col("__at") - 1 + F.col("__before")).cast("long").alias("pos")]
    for name, (kind, _) in running.items():
        here, there = F.col(f"__l_{name}"), F.col(f"__a_{name}")
        value = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0)), "max": F.greatest(here, there), "last": F.coalesce(here, there), "lag": F.when(F.col("__at") == 1, there).otherwise(here)}[kind]
        out.append(value.alias(name))
    return both.select(*out)


def last_of(rows: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in the order given: tasks leave out the others before rows are shuffled."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")
