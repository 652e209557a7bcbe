"""Running sums and ranks over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.session import Stash


def running_sum(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds `out`, the sum of `value` over the group's rows up to and with this one, in order (which must be total; nulls first).

    Rows are put into ranges of (group, order), so a group of any size is spread over tasks; each range sums its own
    rows, and the totals of the ranges before, one row per range and group, are added. The ranges are a table in the
    shared folder, as range bounds are sampled and must not change between the two steps. Runs that step when called.
    An empty table stays empty; a null group is a group.
    """
    cols = [F.col(c) for c in (*group, *order)]
    ranged = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    r = Stash(df.sparkSession, "ranges").finish(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_value", value))
    keys = ["_pid", *group]
    local = F.sum("_value").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = r.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("_before", F.coalesce(before, F.lit(0))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    d = r.withColumn(out, local)
    on = None
    for i, k in enumerate(keys):
        c = d[k].eqNullSafe(offsets[f"_k{i}"])
        on = c if on is None else on & c
    return d.join(offsets, on).withColumn(out, F.col(out) + F.col("_before")).drop("_pid", "_value", "_before", *[f"_k{i}" for i in range(len(keys))])


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """Adds `out`, the row's place in its group, from 1."""
    return running_sum(df, group, order, F.lit(1), out, parts)
