"""Labels and scores of intervals between beats, and of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_labels(beats: DataFrame, record: str, time: str, certain: Column, low: float, high: float, jump: float) -> DataFrame:
    """(record, start, stop, interval, label, reason) of the intervals between neighbouring beats."""
    order = Window.partitionBy(record).orderBy(time)
    rows = beats.withColumn("_c", F.coalesce(certain, F.lit(False)))
    rows = rows.select(record, F.lag(time).over(order).alias("start"), F.col(time).alias("stop"), (F.col("_c") & F.lag("_c").over(order)).alias("sure")).where("start is not null")
    rows = rows.withColumn("interval", F.col("stop") - F.col("start"))
    before = F.lag("interval").over(Window.partitionBy(record).orderBy("start"))
    leap = F.coalesce(F.abs(F.col("interval") - before) / F.greatest(before, F.lit(1e-9)) > jump, F.lit(False))
    reason = F.when(~F.col("interval").between(low, high), "absolute_bounds").when(~F.col("sure"), "uncertain_r_peak").when(leap, "adjacent_jump").otherwise("")
    label = F.create_map(*(F.lit(x) for x in ("absolute_bounds", "RR_OUT_OF_RANGE", "uncertain_r_peak", "RR_UNCERTAIN", "adjacent_jump", "RR_ECTOPIC", "", "NN_CLEAN")))
    return rows.withColumn("reason", reason).select(record, "start", "stop", "interval", label[F.col("reason")].alias("label"), "reason")


def interval_score(beats: DataFrame, record: str, time: str, low: float = 0.3, high: float = 1.8, jump: float = 0.25) -> DataFrame:
    """Half the share of intervals in range, and half the share of neighbouring pairs in range without a jump."""
    order = Window.partitionBy(record).orderBy(time)
    rows = beats.select(record, F.col(time).alias("_t"), (F.col(time) - F.lag(time).over(order)).alias("v")).where("v is not null")
    before = F.lag("v").over(Window.partitionBy(record).orderBy("_t"))
    rows = rows.withColumn("p", before).withColumn("ok", F.col("v").between(low, high))
    good = F.col("ok") & F.col("p").between(low, high) & (F.abs(F.col("v") - F.col("p")) / F.greatest("p", F.lit(1e-12)) <= jump)
    out = rows.groupBy(record).agg(F.count("*").alias("n"), F.count_if("ok").alias("k"), F.count("p").alias("m"), F.count_if(good).alias("j"))
    return out.select(record, (0.5 * F.col("k") / F.col("n") + 0.5 * F.coalesce(F.try_divide(F.col("j"), F.col("m")), F.lit(0.0))).alias("score"))


def robust_snr(samples: DataFrame, record: str, value: str) -> DataFrame:
    """20 log10 of the range over the scaled median absolute deviation."""
    centre = samples.groupBy(record).agg(F.median(value).alias("_m"))
    away = samples.join(centre, record).groupBy(record).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"), (F.max(value) - F.min(value)).alias("_r"))
    return away.select(record, (20 * F.log10(F.greatest("_r", F.lit(1e-12)) / F.greatest(F.col("_d") * 1.4826, F.lit(1e-12)))).alias("snr"))


def mask_summary(samples: DataFrame, record: str, time: str, flagged: Column) -> DataFrame:
    """The share of flagged samples and the longest run without a flag; gaps are not bridged."""
    rows = samples.withColumn("_f", F.coalesce(flagged, F.lit(True)).cast("int"))
    rows = rows.withColumn("_i", F.sum("_f").over(Window.partitionBy(record).orderBy(time)))
    runs = rows.groupBy(record, "_i").agg(F.sum("_f").alias("f"), F.count("*").alias("n"))
    return runs.groupBy(record).agg((F.sum("f") / F.sum("n")).alias("flagged_ratio"), F.max(F.col("n") - F.col("f")).alias("longest_clear"))


def sweep_summary(rows: DataFrame, keys: list[str], scenario: list[str], anchor: dict[str, float], value: str) -> DataFrame:
    """By scenario: rows, rows with a value, and how far values lie from the anchor scenario's of the same recording."""
    at = rows.where(" and ".join(f"{k} = {v}" for k, v in anchor.items())).select(*keys, F.col(value).alias("_a"))
    apart = F.abs(F.col(value) - F.col("_a"))
    return rows.join(at, keys, "left").groupBy(*scenario).agg(F.count("*").alias("n"), F.count(value).alias("n_candidates"), F.median(apart).alias("median_distance"), F.max(apart).alias("max_distance"))


def middle(values: Column) -> Column:
    """The median of an array; NULL if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(s, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def beat_metrics(beats: DataFrame, record: str, time: str, low: float = 0.3, high: float = 2.0, jump: float = 0.2, reach: int = 5, spread: float = 3.0, least: float = 120.0) -> DataFrame:
    """Rate and variability of each record from intervals in range, without a jump and near their neighbours' median.

    A record of fewer than three beats has no valid interval; a record without beats has no row. Ties in time count as
    beats of interval zero, which is out of range.
    """
    order = Window.partitionBy(record).orderBy("_t")
    rows = beats.select(record, F.col(time).alias("_t")).where("_t is not null").withColumn("v", F.col("_t") - F.lag("_t").over(order))
    n_beats = F.count("*").over(Window.partitionBy(record))
    rows = rows.withColumn("p", F.lag("v").over(order)).withColumn("near", F.collect_list("v").over(order.rowsBetween(-reach, reach))).withColumn("beats", n_beats)
    m = middle(F.col("near"))
    rows = rows.withColumn("m", m).withColumn("d", middle(F.transform("near", lambda x: F.abs(x - F.col("m")))) * 1.4826)
    steady = F.col("p").isNull() | (F.abs(F.col("v") - F.col("p")) / F.greatest("p", F.lit(1e-9)) <= jump)
    good = F.col("v").between(low, high) & steady & ((F.col("d") == 0) | (F.abs(F.col("v") - F.col("m")) <= spread * F.col("d"))) & (F.col("beats") >= 3)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("pair", F.when(F.col("good") & F.lag("good").over(order), F.col("v") - F.col("p"))).withColumn("run", F.sum((~F.col("good")).cast("int")).over(order))
    v = F.when(F.col("good"), F.col("v"))
    runs = rows.groupBy(record, "run").agg(F.count(v).alias("length"))
    longest = runs.groupBy(record).agg(F.max("length").alias("length"))
    out = rows.groupBy(record).agg(
        F.count("*").alias("r_peaks"), F.count(v).alias("nn_valid"), F.avg(v).alias("_mean"), F.sqrt(F.avg(F.col("pair") * F.col("pair"))).alias("_r"), F.median(v).alias("_median")
    )
    seconds = F.coalesce(F.col("length") * F.col("_median"), F.lit(0.0))
    return out.join(longest, record).select(
        record, "r_peaks", (F.col("r_peaks") - 1).alias("rr_total"), "nn_valid", F.coalesce(F.try_divide("nn_valid", F.col("r_peaks") - 1), F.lit(0.0)).alias("nn_valid_fraction"),
        F.try_divide(F.lit(60.0), "_mean").alias("mean_hr_bpm"), (F.col("_r") * 1000).alias("rmssd_ms"), seconds.alias("longest_contiguous_s"),
        F.when(seconds >= least, "estimable_candidate").otherwise("ECG_SAMPEN_INESTIMABLE").alias("sampen_status"),
    )


def event_windows(samples: DataFrame, events: DataFrame, record: str, index: str, value: str, left: int, right: int) -> DataFrame:
    """(record, event, offset, y): samples at offsets [left, right) of events, of whole windows only.

    ``events`` holds record and index; a window that lacks a sample, at an end or in a gap, is left out. Events are
    spread to ``right - left`` places and joined by record and place, so that a long record meets many tasks.
    """
    places = events.select(record, F.col(index).alias("event"), F.explode(F.sequence(F.lit(left), F.lit(right - 1))).alias("offset")).withColumn("_i", F.col("event") + F.col("offset"))
    rows = places.join(samples.select(record, F.col(index).alias("_i"), F.col(value).alias("y")).where("y is not null"), [record, "_i"])
    whole = F.count("*").over(Window.partitionBy(record, "event")) == right - left
    return rows.withColumn("_whole", whole).where("_whole").select(record, "event", "offset", "y")


def projections(windows: DataFrame, record: str, template: dict[int, float]) -> DataFrame:
    """Correlation with a template by offset, the factor that fits it, and both sides' root mean squares; flat windows have no row."""
    t = F.create_map(*(F.lit(x) for pair in template.items() for x in (pair[0], float(pair[1]))))[F.col("offset")]
    rows = windows.withColumn("t", t)
    out = rows.groupBy(record, "event").agg(F.corr("y", "t").alias("correlation"), F.regr_slope("y", "t").alias("factor"), F.stddev_pop("y").alias("rms"), F.stddev_pop("t").alias("template_rms"))
    return out.where("rms > 0 and template_rms > 0")


def morphology_score(windows: DataFrame, record: str) -> DataFrame:
    """The median over a record's windows of their correlation with the record's median window, at least 0; 0 below three windows."""
    template = windows.groupBy(record, "offset").agg(F.median("y").alias("t"))
    by_event = windows.join(template, [record, "offset"]).groupBy(record, "event").agg(F.corr("y", "t").alias("c"), F.stddev_pop("y").alias("sy"), F.stddev_pop("t").alias("st"))
    c = F.when((F.col("sy") > 0) & (F.col("st") > 0), F.greatest("c", F.lit(0.0)))
    out = by_event.groupBy(record).agg(F.count("*").alias("n_windows"), F.median(c).alias("m"))
    return out.select(record, "n_windows", F.when(F.col("n_windows") >= 3, F.coalesce("m", F.lit(0.0))).otherwise(0.0).alias("score"))
