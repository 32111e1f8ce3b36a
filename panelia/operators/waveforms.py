"""Waveforms in long form: summaries, decimation checks, pulses, supported means, sliding epochs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(samples: DataFrame, record: str, index: str, value: str) -> DataFrame:
    """n, non-finite values, range, population SD, share of zeros and the longest constant stretch of each record."""
    order = Window.partitionBy(record).orderBy(index)
    x = F.when(~F.isnan(value), F.col(value))
    rows = samples.withColumn("x", x).withColumn("new", (~F.coalesce(F.col(value) == F.lag(value).over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order)).withColumn("length", F.count("*").over(Window.partitionBy(record, "run")))
    n, s, q = F.count("x"), F.sum("x"), F.sum(F.col("x") * F.col("x"))
    return rows.groupBy(record).agg(
        F.count("*").alias("n"), (F.count("*") - n).alias("n_nonfinite"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.sqrt(F.greatest(F.try_divide(n * q - s * s, n * n), F.lit(0.0))).alias("sd"), F.try_divide(F.count_if(F.col("x") == 0).cast("double"), n).alias("zero_fraction"), F.max("length").alias("longest_constant"),
    )


def decimation_agreement(raw: DataFrame, exported: DataFrame, record: str, index: str, value: str, stride: int, offset: int, tolerance: float) -> DataFrame:
    """Whether an export equals every ``stride``-th raw sample; unmatched places count as disagreement."""
    a = raw.where((F.col(index) - offset) % stride == 0).where(F.col(index) >= offset).select(record, ((F.col(index) - offset) / stride).cast("long").alias("i"), F.col(value).alias("x"))
    b = exported.select(record, F.col(index).cast("long").alias("i"), F.col(value).alias("y"))
    both = a.join(b, [record, "i"], "full_outer")
    return both.groupBy(record).agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_unmatched"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_difference")).withColumn(
        "agrees", (F.col("n_unmatched") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance)
    )


def pulses(edges: DataFrame, record: str, order: str, time: str, before: str, after: str) -> DataFrame:
    """Pulses of an edge list in its own order: a rise and the next edge, if that falls back to where the rise began."""
    w = Window.partitionBy(record).orderBy(order)
    nxt = {c: F.lead(c).over(w) for c in (time, before, after)}
    rows = edges.select(record, F.col(time).alias("start"), nxt[time].alias("stop"), F.col(before).alias("low"), F.col(after).alias("high"), nxt[before].alias("b"), nxt[after].alias("a"))
    good = rows.where("high > low and b = high and a = low and stop > start")
    return good.select(record, "start", "stop", (F.col("stop") - F.col("start")).alias("duration"), "low", "high")


def support_weights(samples: DataFrame, record: str, time: str, start: float, end: float) -> DataFrame:
    """Each sample's share of [start, end]: the time since the sample before, none across a gap over 1.5 median steps."""
    w = Window.partitionBy(record).orderBy(time)
    steps = samples.withColumn("step", F.col(time) - F.lag(time).over(w))
    median = steps.where("step is not null").groupBy(record).agg(F.median("step").alias("dt"))
    rows = steps.join(median, record)
    left = F.col(time) - F.coalesce("step", "dt")
    weight = F.greatest(F.lit(0.0), F.least(F.col(time), F.lit(end)) - F.greatest(left, F.lit(start)))
    return rows.withColumn("weight", F.when(F.coalesce("step", "dt") > 1.5 * F.col("dt"), 0.0).otherwise(weight)).drop("step", "dt")


def supported_mean(weighted: DataFrame, record: str, value: str, bad: str, start: float, end: float) -> DataFrame:
    """Weighted mean of the good samples of each record, and the share of [start, end] that they cover."""
    w = F.when(~F.coalesce(F.col(bad), F.lit(False)) & F.col(value).isNotNull(), F.col("weight"))
    return weighted.groupBy(record).agg((F.try_divide(F.sum(w * F.col(value)), F.sum(w))).alias("mean"), (F.sum(w) / (end - start)).alias("coverage"))


def epochs(events: DataFrame, record: str, time: str, value: str, length: float, step: float) -> DataFrame:
    """Count, median and interquartile range of values in epochs of ``length``, one each ``step``.

    An event is dealt to the epochs that hold it, so that epochs need no range join.
    """
    last = F.floor(F.col(time) / step)
    first = F.floor((F.col(time) - length) / step) + 1
    rows = events.withColumn("epoch", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return rows.groupBy(record, "epoch").agg(F.count("*").alias("n"), F.median(value).alias("median"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr")).withColumn("start", F.col("epoch") * step)


def sine_fit(samples: DataFrame, record: str, time: str, value: str, cycles_per_minute: float) -> DataFrame:
    """Amplitude and phase of the least-squares sine of one frequency, from sums only; NULL where time doesn't tell both parts apart."""
    w = 2 * math.pi * cycles_per_minute / 60
    s, c, x = F.sin(w * F.col(time)), F.cos(w * F.col(time)), F.col(value)
    sums = samples.where(x.isNotNull() & F.col(time).isNotNull()).groupBy(record).agg(F.sum(s * s).alias("ss"), F.sum(c * c).alias("cc"), F.sum(s * c).alias("sc"), F.sum(s * x).alias("sx"), F.sum(c * x).alias("cx"))
    solve = lambda text: F.expr(f"case when ss * cc - sc * sc > 1e-9 * ss * cc then ({text}) / (ss * cc - sc * sc) end")
    rows = sums.select(record, solve("cc * sx - sc * cx").alias("a"), solve("ss * cx - sc * sx").alias("b"))
    return rows.select(record, F.hypot("a", "b").alias("amplitude"), F.atan2("b", "a").alias("phase"))


def band_integral(spectrum: DataFrame, record: str, frequency: str, power: str, low: float, high: float) -> DataFrame:
    """The integral over [low, high] of the straight lines between neighbouring points; 0 where none reaches in."""
    order = Window.partitionBy(record).orderBy(frequency)
    f0, p0 = F.lag(frequency).over(order), F.lag(power).over(order)
    rows = spectrum.select(record, f0.alias("f0"), p0.alias("p0"), F.col(frequency).alias("f1"), F.col(power).alias("p1"))
    rows = rows.withColumn("a", F.greatest(F.lit(low), "f0")).withColumn("b", F.least(F.lit(high), "f1"))
    # the mean of a line over a stretch is its value at the middle
    at_middle = F.col("p0") + (F.col("p1") - F.col("p0")) / (F.col("f1") - F.col("f0")) * ((F.col("a") + F.col("b")) / 2 - F.col("f0"))
    area = F.when(F.col("f0").isNotNull() & (F.col("a") < F.col("b")), at_middle * (F.col("b") - F.col("a"))).otherwise(0.0)
    return rows.groupBy(record).agg(F.sum(area).alias("integral"))


def step_profile(samples: DataFrame, record: str, index: str, value: str) -> DataFrame:
    """The share of steps that are zero, and the share of the commonest step in units of the median step's size (8 places).

    A record of one sample has no step: its shares are NULL and 1.
    """
    steps = samples.select(record, (F.col(value) - F.lag(value).over(Window.partitionBy(record).orderBy(index))).alias("d"))
    scale = steps.groupBy(record).agg(F.median(F.abs("d")).alias("m"), F.count("d").alias("n"), F.count_if(F.col("d") == 0).alias("z"))
    unit = F.round(F.col("d") / F.greatest("m", F.lit(2.2250738585072014e-308)), 8)
    most = steps.where("d is not null").join(scale, record).groupBy(record, unit.alias("u")).count().groupBy(record).agg(F.max("count").alias("most"))
    return scale.join(most, record, "left").select(record, F.col("n").alias("n_steps"), F.try_divide("z", "n").alias("zero_share"), F.coalesce(F.try_divide("most", "n"), F.lit(1.0)).alias("modal_share"))
