"""Running aggregates and neighbours without one task for the whole order.

A window without partitions, or over one hot key, runs in one task. Here the order is cut in ranges: a window within each
range, and a window over the ranges' totals. Numbers are cut at a fixed width, and the ranges again, so that no window holds more than
a range's rows or WIDTH totals for 10^14 positions; strings are cut at sampled keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16


def running(df: DataFrame, by: list[str], order: str, value: str, out: str, how: str = "sum", width: int = WIDTH) -> DataFrame:
    """Add the running sum or max of value, over rows with equal `by`, up to and with the row, by the long column order."""
    total = F.sum if how == "sum" else F.max
    join = (lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))) if how == "sum" else (lambda a, b: F.greatest(a, b))
    cut = df.withColumn("_range", F.floor(F.col(order) / width))
    inner = total(value).over(Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # totals of ranges, and of ranges of ranges
    sums = cut.groupBy(*by, "_range").agg(total(value).alias("_total")).withColumn("_high", F.floor(F.col("_range") / width))
    near = total("_total").over(Window.partitionBy(*by, "_high").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    tops = sums.groupBy(*by, "_high").agg(total("_total").alias("_sum"))
    above = total("_sum").over(Window.partitionBy(*by).orderBy("_high").rowsBetween(Window.unboundedPreceding, -1))
    high = tops.withColumn("_above", above).drop("_sum")
    both = F.coalesce("_near", F.lit(0)) + F.coalesce("_above", F.lit(0)) if how == "sum" else F.greatest("_near", "_above")
    before = sums.withColumn("_near", near).join(high, [*by, "_high"]).select(*by, "_range", both.alias("_before"))
    met = cut.withColumn("_in", inner).join(before, [*by, "_range"])
    return met.withColumn(out, join("_in", F.col("_before"))).drop("_in", "_before", "_range")


def sampled_cuts(keys: DataFrame, column: str, ranges: int = 128) -> list:
    """Up to ranges - 1 different values of a column in order: those with the smallest hashes, so they divide it evenly at any size."""
    if ranges < 2:
        return []
    found = keys.select(F.col(column).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(ranges - 1).collect()
    return sorted(r.k for r in found)


def range_of(c: Column, cuts: list) -> Column:
    """How many cuts are at most c, by bisection."""
    if not cuts:
        return F.lit(0)

    def at(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c < F.lit(cuts[mid]), at(low, mid)).otherwise(at(mid + 1, high))

    return at(0, len(cuts))


def numbered(df: DataFrame, by: list[str], order: str, entry: str, before: str, ranges: int = 128) -> DataFrame:
    """Add each row's place from 0 (entry) and the row before's `order` (before) among rows with equal `by`, by the string or binary column order."""
    cut = df.withColumn("_range", range_of(F.col(order), sampled_cuts(df, order, ranges)))
    inner = Window.partitionBy(*by, "_range").orderBy(order)
    ends = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    outer = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*by, "_range", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"), F.last("_last").over(outer).alias("_end"))
    placed = cut.withColumn("_in", F.row_number().over(inner) - 1).withColumn("_lag", F.lag(order).over(inner)).join(earlier, [*by, "_range"])
    return placed.withColumn(entry, F.col("_in") + F.col("_before")).withColumn(before, F.coalesce("_lag", "_end")).drop("_range", "_in", "_lag", "_before", "_end")
