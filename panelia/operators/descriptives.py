"""Counts and per-subject summaries of a panel; a subject's rows meet once, in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelia.sources.panel import STATUSES

def in_time() -> WindowSpec:
    """A subject's minutes in order."""
    return Window.partitionBy("subject_id").orderBy("time_min")


def observed(panel: DataFrame) -> DataFrame:
    return panel.where("status = 'observed'")


def sample_sd(x: Column) -> Column:
    """Sample standard deviation from sums, exact for whole numbers; NULL for fewer than two values."""
    n = F.count(x)
    spread = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n * (n - 1))))


def mean(x: Column) -> Column:
    return F.try_divide(F.sum(x), F.count(x))


def with_previous(frame: DataFrame) -> DataFrame:
    """Observed rows with the value of the minute before (NULL across a gap)."""
    near = F.col("time_min") - F.lag("time_min").over(in_time()) == 1
    return observed(frame).withColumn("previous", F.when(near, F.lag("vas").over(in_time())))


def time_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("time_min").agg(F.count("*").alias("n_scheduled"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))


def subject_summary(panel: DataFrame) -> DataFrame:
    """Descriptives and adjacent area of each subject: gaps are not bridged, a subject without scores has NULLs."""
    is_observed = F.col("status") == "observed"
    near = is_observed & (F.lag("status").over(in_time()) == "observed") & (F.col("time_min") - F.lag("time_min").over(in_time()) == 1)
    rows = panel.withColumn("x", F.when(is_observed, F.col("vas"))).withColumn("p", F.when(near, F.lag("vas").over(in_time())))
    rows = rows.withColumn("d", F.col("x") - F.col("p"))
    t = F.when(is_observed, F.col("time_min"))
    marker = F.col("status").startswith("termination_")
    out = rows.groupBy("subject_id").agg(
        F.count("x").alias("n_observed"),
        F.count("d").alias("n_adjacent_pairs"),
        mean(F.col("x")).alias("mean_observed_vas"),
        sample_sd(F.col("x")).alias("raw_sd"),
        mean(F.col("d") * F.col("d")).alias("raw_mssd"),
        F.max(t).alias("last_observed_min"),
        F.coalesce(F.min_by(F.when(marker, F.col("termination_code")), F.when(marker, F.col("time_min"))), F.lit("")).alias("termination_code"),
        F.min(F.when(marker, F.col("time_min"))).alias("first_marker_min"),
        F.sum((F.col("x") + F.col("p")) / 2).alias("observed_adjacent_auc"),
        F.count("d").alias("auc_covered_minutes"),
        F.max("x").alias("peak_observed_vas"),
        F.min_by(t, F.when(is_observed, F.struct(-F.col("vas"), F.col("time_min")))).alias("first_observed_peak_min"),
        F.max_by(F.col("x"), t).alias("_last"),
    )
    return out.withColumn("peak_at_last_observation", F.coalesce(F.col("_last") == F.col("peak_observed_vas"), F.lit(False))).withColumn("complete_1_20", F.col("n_observed") == 20).drop("_last")


def window_metrics(panel: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Variability inside minute windows [a, b]; pairs that a window's edge cuts don't count."""
    spans = F.explode(F.array(*(F.struct(F.lit(a).alias("start_min"), F.lit(b).alias("end_min")) for a, b in windows)))
    rows = with_previous(panel).select("subject_id", "time_min", "vas", "previous", spans.alias("w")).select("subject_id", "time_min", "vas", "previous", "w.*")
    inside = rows.where("time_min between start_min and end_min")
    d = F.when(F.col("time_min") > F.col("start_min"), F.col("vas") - F.col("previous"))
    out = inside.withColumn("d", d).groupBy("subject_id", "start_min", "end_min").agg(
        F.count("*").alias("n_observed"),
        F.count("d").alias("n_pairs"),
        mean(F.col("vas")).alias("mean_vas"),
        sample_sd(F.col("vas")).alias("sample_sd"),
        mean(F.col("d") * F.col("d")).alias("mssd"),
        mean(F.col("d")).alias("mean_adjacent_change"),
        F.sum("d").alias("_s"),
        F.sum(F.col("d") * F.col("d")).alias("_q"),
    )
    n = F.col("n_pairs")
    centred = F.try_divide(n * F.col("_q") - F.col("_s") * F.col("_s"), n * n)
    return out.select(
        "subject_id", "start_min", "end_min", "n_observed", "n_pairs", (F.col("n_observed") == F.col("end_min") - F.col("start_min") + 1).alias("complete"), (n >= 3).alias("eligible"),
        "mean_vas", "sample_sd", "mssd", F.sqrt("mssd").alias("rmssd"), "mean_adjacent_change", centred.alias("centered_change_ms"),
    )


def finite_changes(panel: DataFrame, horizons: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Changes over h minutes, only where every minute between is observed."""
    parts = None
    for h in horizons:
        frame = in_time().rowsBetween(0, h)
        whole = (F.count(F.when(F.col("status") == "observed", 1)).over(frame) == h + 1) & (F.lead("time_min", h).over(in_time()) - F.col("time_min") == h)
        part = panel.select("subject_id", "time_min", F.lit(h).alias("h"), F.when(whole, F.lead("vas", h).over(in_time()) - F.col("vas")).alias("change")).where("change is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts
