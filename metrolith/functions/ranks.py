"""Running counts and ranks over all rows without one task that sorts them all.

Values fall in buckets by sign, power of two and 64ths of it: a rule that depends on no
other row, so every pass gives the same buckets.  Only the counts of buckets, some
thousand rows, are put in one order; rows are sorted within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(x: Column) -> Column:
    """A number that never falls as the value grows; NaN is above all others, null is null."""
    finite = F.when(F.abs(x) < float("inf"), F.abs(x))
    size = F.coalesce(F.floor(F.log2(finite) * 64).cast("bigint") + 100_000, F.lit(500_000))  # log2 of the least positive double is above -1075
    return F.when(F.isnan(x), F.lit(1_000_000).cast("bigint")).when(x.isNull(), F.lit(None).cast("bigint")).when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size)


def running(df: DataFrame, value: str, weight: Column, name: str, *, descending: bool = False, ties: list[Column] = ()) -> DataFrame:
    """Adds ``name``: the sum of weights of all rows before a row, in the order of its value and then of the ties.

    Null values come last.  Rows that are alike in value and ties go in no fixed order.
    """
    b = F.col("_bucket")
    marked = df.withColumn("_bucket", bucket(F.col(value).cast("double"))).withColumn("_weight", weight)
    order = b.desc_nulls_last() if descending else b.asc_nulls_last()
    sums = marked.groupBy("_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    starts = sums.select(b.alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    x = F.col(value)
    inside = Window.partitionBy("_bucket").orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    joined = local.join(starts, b.eqNullSafe(F.col("_b")), "left")
    return joined.withColumn(name, F.col("_start") + F.col("_local")).drop("_bucket", "_weight", "_local", "_start", "_b")


def by_value(df: DataFrame, value: str, *, descending: bool = False) -> DataFrame:
    """(_v, _n, _less, _place): each distinct value, its rows, the rows before it, the distinct values before it."""
    counted = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running(counted, "_v", F.col("_n"), "_less", descending=descending)
    return running(ranked, "_v", F.lit(1), "_place", descending=descending)
