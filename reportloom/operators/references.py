"""References to records that don't exist, were withdrawn or arrive later.

Method: parent and child keys are united in long form and grouped by parent table and key; groups
lacking the parent flag are orphans; counts are summed by period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import strip
from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash


def parent_keys(df: DataFrame, name: str, key: str, arrived: str, deleted: str) -> DataFrame:
    """Parent side of the long form: one row per row of the parent table."""
    return df.select(F.lit(name).alias("parent_table"), reference_key(F.col(key)).alias("key"), F.col(arrived).alias("arrived"), F.col(deleted).isNotNull().alias("deleted"))


def child_keys(df: DataFrame, name: str, record: str, ref: str | Column, parent: str, at: str) -> DataFrame:
    """Child side of the long form: one row per distinct reference; null and blank keys are no references."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    out = df.select(F.lit(name).alias("table_name"), F.col(record).alias("record_key"), F.lit(parent).alias("parent_table"), reference_key(ref).alias("key"), F.col(at).alias("referred"))
    return out.where(F.col("key") != "").distinct()


def reference_key(c: Column) -> Column:
    """As keys are compared: without blanks at the ends, in lower case."""
    return F.lower(strip(c))


def orphan_references(parents: list[DataFrame], children: list[DataFrame]) -> DataFrame:
    """(table_name, record_key, missing_key, reason, period) of each reference without a usable target.

    reason is missing (no target row), else deleted (every target row is withdrawn), else late (the first
    target row arrived after the referring row). A target without arrival time, or a referring row without
    time, is never late. period is the month of the referring row's time, null without one. Repeated rows
    count once; empty tables give no rows, or, as parents, make all references missing.

    Keys are grouped with partial aggregates before the shuffle, so a key that holds a third of the references
    is one row per map task; it is split by salts where its references get their key's state. Children are read twice: for their keys,
    and to pick the references to keys without a usable target, whose table is in the shared folder and belongs to the caller.
    """
    p = reduce(DataFrame.unionByName, parents)
    c = reduce(DataFrame.unionByName, children)
    long = p.select("parent_table", "key", F.lit(1).alias("is_parent"), "arrived", "deleted", F.lit(None).cast("timestamp_ntz").alias("referred")).unionByName(
        c.select("parent_table", "key", F.lit(0).alias("is_parent"), F.lit(None).cast("timestamp_ntz").alias("arrived"), F.lit(None).cast("boolean").alias("deleted"), "referred")
    )
    keys = long.groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("has_parent"), F.sum(1 - F.col("is_parent")).alias("count"), F.min("deleted").alias("all_deleted"),
        F.min("arrived").alias("first_arrived"), F.min("referred").alias("first_referred"),
    )
    # a key all of whose references come after its first target is sound: only the others go on
    bad = keys.where((F.col("count") > 0) & ((F.col("has_parent") == 0) | F.col("all_deleted") | (F.col("first_arrived") > F.col("first_referred"))))
    one = F.concat_ws("\x01", "parent_table", "key")
    stash = Stash(c.sparkSession, "orphans")
    bad, seen = stash.put_counted(bad.select(one.alias("_ref"), "has_parent", "all_deleted", "first_arrived", "count"), refs=F.sum("count"))
    j = salted_lookup(c.withColumn("_ref", one), stash.keep(bad).drop("count"), "_ref", "inner", rows=seen["refs"], counts=bad.select("_ref", "count"))
    reason = F.when(F.col("has_parent") == 0, "missing").when(F.col("all_deleted"), "deleted").when(F.col("first_arrived") > F.col("referred"), "late")
    return j.select("table_name", "record_key", F.col("key").alias("missing_key"), reason.alias("reason"), F.trunc("referred", "month").alias("period")).where(F.col("reason").isNotNull()).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """(table_name, period, reason, orphan_refs, records): references without usable target per table and month."""
    return found.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("orphan_refs"), F.count_distinct("record_key").alias("records"))
