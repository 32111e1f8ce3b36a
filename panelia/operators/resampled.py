"""Bootstraps of whole people, by draws that depend on a seed, the replicate and the slot alone.

A draw is a hash modulo the number of people, so that any engine and any partitioning makes the same draws, and a
replicate can be made again by itself.  Draws are counted before they meet the data: a person's rows are joined once
a replicate, with the person's multiplicity.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_people(people: DataFrame, person: str, by: list[str]) -> DataFrame:
    """(by, person, j): places from 0, in order of a hash's first digits and the person; no group is sorted in one task."""
    own = people.select(*by, person).distinct().withColumn("_b", F.substring(F.md5(F.col(person).cast("string")), 1, 3))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(person)) - 1
    # at most 4,096 rows a group
    counts = own.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.withColumn("_i", inside).join(before, [*by, "_b"]).select(*by, person, (F.col("_before") + F.col("_i")).alias("j"))


def draws(people: DataFrame, person: str, replicates: int, seed: int, by: list[str] = []) -> DataFrame:
    """(by, replicate, person, w): how often each person is drawn, where there are as many draws as people."""
    numbered = numbered_people(people, person, by)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("n"))
    slots = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    counted = slots.groupBy(*by, "replicate", (number % F.col("n")).alias("j")).agg(F.count("*").alias("w"))
    return counted.join(numbered, [*by, "j"]).select(*by, "replicate", person, "w")


def weighted_medians(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The median of the values, each as often as its weight says (the mean of the two middle ones)."""
    seen = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("x")).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy(*keys))
    below = F.sum("w").over(Window.partitionBy(*keys).orderBy("x"))
    placed = seen.withColumn("n", total).withColumn("c", below)
    low, high = (F.min(F.when(F.col("c") >= F.floor(rank), F.col("x"))) for rank in ((F.col("n") + 1) / 2, F.col("n") / 2 + 1))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), ((low + high) / 2).alias("median"))


def resampled_medians(rows: DataFrame, people: DataFrame, person: str, keys: list[str], value: str) -> DataFrame:
    """(keys, replicate, n, median) of the values under the people's multiplicities."""
    by = [c for c in keys if c in people.columns]
    return weighted_medians(rows.where(F.col(value).isNotNull()).join(people, [*by, person]), [*keys, "replicate"], value, "w")


def resampled_means(rows: DataFrame, people: DataFrame, person: str, keys: list[str], value: str) -> DataFrame:
    """(keys, replicate, n, mean) of the values under the people's multiplicities."""
    joined = rows.where(F.col(value).isNotNull()).join(people, person)
    return joined.groupBy(*keys, "replicate").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def resampled_slopes(rows: DataFrame, person: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, slope): the within-person slope, from each person's sums of squares and products."""
    n = F.count("*")
    sums = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(person).agg((F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / n).alias("xx"), (F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n).alias("xy"))
    joined = draws(sums, person, replicates, seed).join(sums, person)
    return joined.groupBy("replicate").agg((F.sum(F.col("w") * F.col("xy")) / F.nullif(F.sum(F.col("w") * F.col("xx")), F.lit(0.0))).alias("slope"))


def endpoints(found: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """The valid replicates, and the order statistics at the interval's ends."""
    a = (1 - level) / 2
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})")
    return found.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("valid"), at(a).alias("low"), at(1 - a).alias("high"))


#: Statistics of a window's adjacent changes.
RAW = ("mean_vas", "sample_sd", "mssd", "rmssd", "mean_adjacent_change", "centered_change_ms")


def variability_statistics(windows: DataFrame, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """(subject_id, statistic, value) of each window under both rules of support, and of late less early complete windows."""
    parts = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(m).alias("metric"), F.when(F.col(flag), F.col(m)).alias("value")) for m in RAW)) for rule, flag in (("at_least_3_pairs", "eligible"), ("complete_window", "complete"))))))
    long = windows.select("subject_id", "start_min", "end_min", parts.alias("p")).select("subject_id", "start_min", "end_min", "p.*")
    own = long.select("subject_id", F.concat_ws("_", F.lit("raw"), F.col("start_min").cast("string"), F.col("end_min").cast("string"), "rule", "metric").alias("statistic"), "value")
    at = lambda w: (F.col("start_min") == w[0]) & (F.col("end_min") == w[1]) & (F.col("rule") == "complete_window")
    pair = long.groupBy("subject_id", "metric").agg((F.max(F.when(at(late), F.col("value"))) - F.max(F.when(at(early), F.col("value")))).alias("value"))
    name = F.concat(F.lit(f"paired_{late[0]}_{late[1]}_minus_{early[0]}_{early[1]}_"), "metric")
    return own.unionByName(pair.select("subject_id", name.alias("statistic"), "value"))


def order_ranks(sizes: DataFrame, size: str, probability: float, gamma: float) -> DataFrame:
    """For each distinct size n, the ranks between which a quantile lies with probability 1 - gamma, by enumerating the binomial.

    Ranks 0 and n + 1 stand for no bound. Rows grow with n: n + 2 for each distinct size.
    """
    n, k, log = F.col(size), F.col("k"), F.log
    rows = sizes.select(size).where(n >= 1).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    order = Window.partitionBy(size).orderBy("k")
    ways = F.sum(F.when(k > 0, log((n - k + 1) / k)).otherwise(0.0)).over(order)
    rows = rows.withColumn("mass", F.exp(ways + k * math.log(probability) + (n - k) * math.log1p(-probability)))
    rows = rows.withColumn("below", F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("above", F.sum("mass").over(order.rowsBetween(1, Window.unboundedFollowing)))
    low = F.max(F.when(F.col("below") <= gamma / 2, k))
    high = F.min(F.when(F.coalesce("above", F.lit(0.0)) <= gamma / 2, k + 1))
    return rows.groupBy(size).agg(low.alias("lower_rank"), high.alias("upper_rank"))
