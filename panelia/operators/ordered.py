"""Places in a global order, without one task that holds all values of a key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.sources.shared import written

BEFORE = (Window.unboundedPreceding, -1)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality by all names; NULL equals NULL."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in names), F.lit(True))


def running_counts(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, below, part): each distinct value of a key, its rows and the rows of smaller values; NULL is the smallest.

    Rows are counted by value first.  Values are dealt by range into parts, and only the parts' totals, one row a key
    and part, are added up in one place.
    """
    counted = frame.groupBy(*keys, value).agg(F.count("*").alias("n"))
    dealt = written(counted.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "ordered")
    totals = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("_t"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(*BEFORE)), F.lit(0))).drop("_t")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(*BEFORE)), F.lit(0))
    placed = dealt.withColumn("_inside", inside)
    joined = placed.join(offsets, same(placed, offsets, [*keys, "part"]))
    return joined.select(*(placed[c] for c in [*keys, value, "n"]), (F.col("_inside") + F.col("_before")).alias("below"), placed["part"])


def least_from(values: DataFrame, order: str, x: str) -> DataFrame:
    """The least ``x`` at each row of ``running_counts`` or above it in the order, as ``least``."""
    parts = values.groupBy("part").agg(F.min(x).alias("_m"))
    later = parts.select("part", F.min("_m").over(Window.orderBy(F.desc("part")).rowsBetween(*BEFORE)).alias("_later"))
    here = F.min(x).over(Window.partitionBy("part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("_here", here).join(later, "part").withColumn("least", F.least("_here", "_later")).drop("_here", "_later")


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n: 64 terms added, the rest by the difference of two asymptotic expansions."""
    def tail(k: int) -> float:
        return math.log(k) + 1 / (2 * k) - 1 / (12 * k**2) + 1 / (120 * k**4)

    head = sum(1.0 / i for i in range(1, min(n, 64) + 1))
    return head if n <= 64 else head + tail(n) - tail(64)
