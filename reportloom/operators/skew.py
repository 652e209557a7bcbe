"""Joins whose left side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200
#: Parts into which the rows of a hot key are split at least, and rows of a part at most, about.
SALTS, PART_ROWS = 32, 1_000_000


def salted_lookup(big: DataFrame, lookup: DataFrame, key: str, how: str = "left", rows: int | None = None, counts: DataFrame | None = None, shuffled: bool = False) -> DataFrame:
    """Join `big` to `lookup` on `key` without sending a hot key to one task.

    The keys of `big` that hold more than one in HOT_SHARE of its rows are counted
    (partial counts before the shuffle); fewer than HOT_SHARE such keys can exist, so their
    list has a proven bound and is broadcast. Rows of hot keys get a salt, of so many that a part has about PART_ROWS rows, and the
    lookup's rows of hot keys are repeated once per salt. Other keys join as usual. `rows` is the number of rows of `big` if it is
    known, which saves a count; `counts` (key, count) if how often keys occur is known, which saves counting them. `shuffled` keeps
    the planner from a broadcast of either side: it goes by the size of files, which for repetitive rows in Parquet is a small part of theirs.

    Null keys match nothing: kept with how="left", dropped with how="inner". An empty side gives
    the usual join result. Columns of `lookup` other than `key` must not occur in `big`.
    """
    n = big.count() if rows is None else rows
    if n < 100_000:  # a hot key of so few rows is no burden
        return big.join(lookup, key, how)
    parts = F.greatest(F.lit(SALTS), F.ceil(F.col("count") / PART_ROWS)).cast("int")
    often = big.where(F.col(key).isNotNull()).groupBy(key).count() if counts is None else counts
    hot = F.broadcast(often.where(F.col("count") * HOT_SHARE > n).select(F.col(key).alias("_hot"), parts.alias("_parts")))
    # the salt depends on the row alone, so a task that runs again sends each row to the same place
    spread = [c for c, kind in big.dtypes if "map<" not in kind and c != key] or [key]
    nulls = max(SALTS, n // PART_ROWS)  # null keys may be many too
    salts = F.when(F.col(key).isNull(), F.lit(nulls)).otherwise(F.coalesce("_parts", F.lit(1)))
    left = big.join(hot, big[key] == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_hot", "_parts")
    right = lookup.join(hot, lookup[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return (left.hint("merge") if shuffled else left).join(right, [key, "_salt"], how).drop("_salt")
