"""Missingness patterns, threshold states and runs: gaps and islands over a subject's minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.operators.descriptives import in_time, mean, observed


def classified(panel: DataFrame) -> DataFrame:
    """Rows with their analysis category."""
    category = (
        F.when(F.col("status").isin("observed", "termination_E", "termination_T"), F.col("status"))
        .when(F.max(F.when(F.col("status").startswith("termination_"), 1)).over(in_time().rowsBetween(Window.unboundedPreceding, -1)) == 1, "post_termination_missing")
        .otherwise("pre_marker_missing")
    )
    return panel.withColumn("category", category)


def islands(frame: DataFrame, condition: Column | str, keys: list[str], order: str) -> DataFrame:
    """(keys, start, end, length) of the runs of rows that meet a condition; rows that don't, break them."""
    every = Window.partitionBy(*keys).orderBy(order)
    rows = frame.withColumn("_rn", F.row_number().over(every)).where(condition)
    return rows.withColumn("_i", F.col("_rn") - F.row_number().over(every)).groupBy(*keys, "_i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("_i")


def classify_subjects(panel: DataFrame) -> DataFrame:
    """Counts by category, the longest gap before the marker, and the pattern of each subject."""
    rows = classified(panel)
    gap = F.col("category") == "pre_marker_missing"
    run = F.when(gap, F.col("time_min") - F.coalesce(F.max(F.when(~gap, F.col("time_min"))).over(in_time().rowsBetween(Window.unboundedPreceding, 0)), F.min("time_min").over(Window.partitionBy("subject_id")) - 1)).otherwise(0)
    marker = F.col("status").startswith("termination_")
    return rows.withColumn("_run", run).groupBy("subject_id").agg(
        F.coalesce(F.min_by(F.when(marker, F.col("termination_code")), F.when(marker, F.col("time_min"))), F.lit("none")).alias("eventual_marker"),
        F.min(F.when(marker, F.col("time_min"))).alias("first_marker_min"),
        F.count_if(F.col("category") == "observed").alias("n_observed"),
        F.count_if(gap).alias("n_pre_marker_missing"),
        F.count_if(F.col("category") == "post_termination_missing").alias("n_post_termination_missing"),
        F.max("_run").alias("longest_pre_marker_gap"),
        F.max(F.when(F.col("category") == "observed", F.col("time_min"))).alias("last_observed_min"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_min", "category"))), lambda x: x["category"]), "|").alias("pattern"),
    )


def adjacent_composition(panel: DataFrame, minutes: range = range(1, 21)) -> DataFrame:
    """The change of the observed mean between neighbouring minutes: paired change, and who comes and goes.

    A subject's next minute is looked up by a window, so that the panel is not joined with itself.
    """
    nxt = F.lead("vas").over(in_time())
    follows = F.lead("time_min").over(in_time()) == F.col("time_min") + 1
    rows = panel.select("subject_id", "time_min", F.when(F.col("status") == "observed", F.col("vas")).alias("x"), F.when(follows & (F.lead("status").over(in_time()) == "observed"), nxt).alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = rows.where(F.col("time_min") < minutes.stop - 1).groupBy(F.col("time_min").alias("start_min")).agg(
        F.count("x").alias("n_start"),
        F.count("y").alias("n_end"),
        F.count_if(both).alias("n_both"),
        mean(F.col("x")).alias("_x"),
        mean(F.col("y")).alias("_y"),
        mean(F.when(both, F.col("x"))).alias("_bx"),
        mean(F.when(both, F.col("y"))).alias("_by"),
        mean(F.when(both, F.col("y") - F.col("x"))).alias("paired_observed_change"),
    )
    left, right = F.col("_bx") - F.col("_x"), F.col("_y") - F.col("_by")
    return rows.select(
        "start_min", (F.col("start_min") + 1).alias("end_min"), "n_start", "n_end", "n_both", (F.col("n_start") - F.col("n_both")).alias("n_leaving"), (F.col("n_end") - F.col("n_both")).alias("n_entering"),
        (F.col("_y") - F.col("_x")).alias("observed_mean_change"), "paired_observed_change", left.alias("start_composition"), right.alias("end_composition"), (left + right).alias("composition_total"), (F.col("n_both") > 0).alias("defined"),
    )


def state_points(panel: DataFrame, thresholds: list[float]) -> DataFrame:
    """Observed rows with their state: the number of thresholds at or below the score."""
    if not thresholds or thresholds != sorted(set(thresholds)):
        raise ValueError("thresholds must increase")
    state = sum((F.when(F.col("vas") >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return observed(panel).select("subject_id", "time_min", state.cast("int").alias("state"), "vas")


def state_transitions(points: DataFrame) -> DataFrame:
    """Counts of transitions between neighbouring minutes."""
    near = F.col("time_min") - F.lag("time_min").over(in_time()) == 1
    rows = points.select(F.when(near, F.lag("state").over(in_time())).alias("from_state"), F.col("state").alias("to_state")).where("from_state is not null")
    return rows.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def state_spells(points: DataFrame) -> DataFrame:
    """Runs of one state over neighbouring minutes, with what bounds them on both sides."""
    near = F.col("time_min") - F.lag("time_min").over(in_time()) == 1
    far = F.lead("time_min").over(in_time()) - F.col("time_min")
    rows = points.withColumn("adjacent", F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("begins", ~F.col("adjacent") | (F.lag("state").over(in_time()) != F.col("state"))).withColumn("far", far)
    rows = rows.withColumn("spell", F.sum(F.col("begins").cast("int")).over(in_time()))
    out = rows.groupBy("subject_id", "spell", "state").agg(
        F.min("time_min").alias("start_min"), F.max("time_min").alias("end_min"), F.count("*").alias("n_observed"), (~F.min_by("adjacent", "time_min")).alias("left_censored"), F.max_by("far", "time_min").alias("_far")
    )
    right = F.when(F.col("_far").isNull(), "observation_end").when(F.col("_far") > 1, "observation_gap").otherwise("observed_transition")
    left = F.when(F.col("left_censored"), "observation_start_or_gap").otherwise("observed_transition")
    return out.select("subject_id", "state", "start_min", "end_min", "n_observed", (F.col("end_min") - F.col("start_min")).alias("observed_span_min"), "left_censored", left.alias("left_boundary"), (F.coalesce(F.col("_far"), F.lit(2)) > 1).alias("right_censored"), right.alias("right_boundary"))


def recode_connected_zeros(panel: DataFrame) -> DataFrame:
    """(subject_id, time_min, old_first_E_min, new_first_E_min): zeros that run up to a first E and count as E.

    Subjects with a T, and zeros before a gap or another score, are left as they are.
    """
    whole = Window.partitionBy("subject_id")
    first = F.min(F.when(F.col("status") == "termination_E", F.col("time_min"))).over(whole)
    has_t = F.max(F.when(F.col("status") == "termination_T", 1)).over(whole)
    rows = panel.withColumn("f", first).withColumn("t", has_t).where("f is not null and t is null")
    blocks = F.max(F.when((F.col("time_min") < F.col("f")) & ~F.coalesce(F.col("vas") == 0, F.lit(False)), F.col("time_min"))).over(whole)
    rows = rows.withColumn("start", F.coalesce(blocks, F.min("time_min").over(whole) - 1) + 1)
    return rows.where("time_min >= start and time_min <= f").select("subject_id", "time_min", F.col("f").alias("old_first_E_min"), F.col("start").alias("new_first_E_min"))
