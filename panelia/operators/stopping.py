"""Stopping markers: audit, distribution, bounds without imputed rows, scenario grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelia.operators.descriptives import in_time, mean
from panelia.sources.panel import ContractError, Scale


def audit_stopping(panel: DataFrame, processed_e: bool = False) -> DataFrame:
    """First marker of each subject, the two values before it, and what supports an E."""
    marker = F.col("status").isin("termination_E", "termination_T")
    seen = F.col("status") == "observed"
    back = lambda k: F.when((F.lag("status", k).over(in_time()) == "observed") & (F.lag("time_min", k).over(in_time()) == F.col("time_min") - k), F.lag("vas", k).over(in_time()))
    zero_pair = seen & (F.col("vas") == 0) & (back(1) == 0)
    rows = panel.withColumn("b1", back(1)).withColumn("b2", back(2)).withColumn("zp", F.coalesce(zero_pair, F.lit(False)))
    t = F.when(seen, F.col("time_min"))
    first = F.min_by(F.when(marker, F.struct("termination_code", "time_min", "b1", "b2")), F.when(marker, F.col("time_min")))
    found = rows.groupBy("subject_id").agg(
        first.alias("f"),
        F.count_if(seen).alias("n_observed"),
        F.max(t).alias("last_observed_min"),
        F.max_by(F.when(seen, F.col("vas")), t).alias("last_observed_vas"),
        F.count_if("zp").alias("n_observed_adjacent_zero_pairs"),
        F.min(F.when(F.col("zp"), F.col("time_min"))).alias("first_recorded_zero_pair_end_min"),
    )
    code = F.coalesce("f.termination_code", F.lit("none"))
    zeros = (F.col("f.b1") == 0) & (F.col("f.b2") == 0)
    if processed_e:
        support = F.when(code != "E", "not_applicable").when(F.coalesce(zeros, F.lit(False)), "remaining_uncoded_zero_pair").otherwise("existing_E_processed_no_preceding_zeros_required")
    else:
        support = (
            F.when(code != "E", "not_applicable")
            .when(F.col("f.b1").isNull() | F.col("f.b2").isNull(), "preceding_numeric_window_unavailable")
            .when(zeros, "two_preceding_recorded_zeros")
            .otherwise("not_two_preceding_recorded_zeros_requires_review")
        )
    return found.select(
        "subject_id", code.alias("eventual_marker"), F.col("f.time_min").alias("first_marker_min"), "n_observed", "last_observed_min", "last_observed_vas",
        F.col("f.b2").alias("preceding_2min_vas"), F.col("f.b1").alias("preceding_1min_vas"), support.alias("E_recorded_support"),
        "n_observed_adjacent_zero_pairs", "first_recorded_zero_pair_end_min",
    )


def minute_spine(frame: DataFrame, minutes: range) -> DataFrame:
    return frame.sparkSession.range(minutes.start, minutes.stop, numPartitions=1).select(F.col("id").cast("int").alias("time_min"))


def stopping_distribution(audit: DataFrame, minutes: range = range(1, 21)) -> DataFrame:
    """New and cumulative markers by minute; one aggregation, then a spine of minutes."""
    by_minute = audit.groupBy(F.coalesce("first_marker_min", F.lit(0)).alias("m")).agg(
        F.count("*").alias("n"), F.count_if(F.col("eventual_marker") == "E").alias("e"), F.count_if(F.col("eventual_marker") == "T").alias("t")
    )
    spine = minute_spine(audit, range(0, minutes.stop))
    # at most one row a minute
    running = Window.orderBy("time_min").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(by_minute, F.col("time_min") == F.col("m"), "left").fillna(0, ["n", "e", "t"])
    total = F.sum("n").over(Window.orderBy("time_min").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.select("time_min", total.alias("n_candidate"), F.col("e").alias("n_first_E"), F.col("t").alias("n_first_T"), F.sum("e").over(running).alias("n_E_by_minute"), F.sum("t").over(running).alias("n_T_by_minute"))
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_candidate"))
    out = out.withColumn("fraction_E_by_minute", share("n_E_by_minute")).withColumn("fraction_T_by_minute", share("n_T_by_minute"))
    return out.withColumn("n_without_marker_yet", F.col("n_candidate") - F.col("n_E_by_minute") - F.col("n_T_by_minute")).where(F.col("time_min") >= minutes.start)


def grouped_observed(panel: DataFrame, minutes: range = range(1, 21)) -> DataFrame:
    """Mean by eventual marker and minute, empty cells included."""
    whole = Window.partitionBy("subject_id")
    code = F.coalesce(F.min_by(F.when(F.col("status").startswith("termination_"), F.col("termination_code")), F.when(F.col("status").startswith("termination_"), F.col("time_min"))).over(whole), F.lit("none"))
    seen = F.col("status") == "observed"
    cells = panel.withColumn("eventual_marker", code).groupBy("eventual_marker", "time_min").agg(F.count("*").alias("n_group"), F.count_if(seen).alias("n_observed"), mean(F.when(seen, F.col("vas"))).alias("mean_observed"))
    spine = minute_spine(panel, minutes).select("time_min", F.explode(F.array(F.lit("E"), F.lit("T"), F.lit("none"))).alias("eventual_marker"))
    return spine.join(cells, ["eventual_marker", "time_min"], "left").fillna(0, ["n_group", "n_observed"]).select("eventual_marker", "time_min", "n_group", "n_observed", "mean_observed")


def bounded_means(panel: DataFrame, scale: Scale) -> DataFrame:
    """The least and greatest cohort mean that missing scores allow, by minute, with the width by reason."""
    seen = F.col("status") == "observed"
    low, high = scale.minimum, scale.maximum
    reason = F.when(F.col("termination_code").isin("E", "T"), F.col("termination_code")).otherwise("other")
    rows = panel.groupBy("time_min").agg(
        F.count("*").alias("n_candidate"),
        F.count_if(seen).alias("n_observed"),
        F.coalesce(F.sum(F.when(seen, F.col("vas"))), F.lit(0.0)).alias("observed_sum"),
        *(F.count_if(~seen & (reason == r)).alias(n) for r, n in (("E", "n_unobserved_E"), ("T", "n_unobserved_T"), ("other", "n_other_missing"))),
    )
    m = F.col("n_candidate") - F.col("n_observed")
    n = F.col("n_candidate")
    width = lambda c: F.col(c) * (high - low) / n
    return rows.select(
        "*", ((F.col("observed_sum") + m * low) / n).alias("cohort_mean_lower"), ((F.col("observed_sum") + m * high) / n).alias("cohort_mean_upper"),
        width("n_unobserved_E").alias("width_due_to_E"), width("n_unobserved_T").alias("width_due_to_T"), width("n_other_missing").alias("width_due_to_other_missing"),
    )


def area_bounds(bounds: DataFrame) -> DataFrame:
    """Trapezoid areas of the bounds: one row; minutes must follow each other."""
    # one row a minute
    nxt = Window.orderBy("time_min")
    names = {"cohort_mean_lower": "candidate_mean_auc_lower", "cohort_mean_upper": "candidate_mean_auc_upper", "width_due_to_E": "width_due_to_E", "width_due_to_T": "width_due_to_T", "width_due_to_other_missing": "width_due_to_other_missing"}
    rows = bounds.select("time_min", *(((F.col(c) + F.lead(c).over(nxt)) / 2).alias(c) for c in names))
    return rows.agg(F.min("time_min").alias("start_min"), F.max("time_min").alias("end_min"), *(F.sum(c).alias(a) for c, a in names.items()))


def post_stop_grid(panel: DataFrame, e_levels: list[float], t_levels: list[float], scale: Scale) -> DataFrame:
    """Hypothetical means by minute for scores assumed after E and after T."""
    if any(not scale.minimum <= x <= scale.maximum for x in [*e_levels, *t_levels]):
        raise ContractError("a scenario lies outside the scale")
    bounds = bounded_means(panel, scale)
    cells = F.explode(F.array(*(F.struct(F.lit(float(e)).alias("assumed_E"), F.lit(float(t)).alias("assumed_T")) for e in e_levels for t in t_levels)))
    rows = bounds.select("*", cells.alias("s")).select("*", "s.*")
    base = (F.col("observed_sum") + F.col("assumed_E") * F.col("n_unobserved_E") + F.col("assumed_T") * F.col("n_unobserved_T")) / F.col("n_candidate")
    return rows.select(
        "assumed_E", "assumed_T", "time_min", F.col("n_candidate").alias("n_people"), "n_observed", F.col("n_unobserved_E").alias("n_E_missing"), F.col("n_unobserved_T").alias("n_T_missing"), "n_other_missing",
        base.alias("hypothetical_mean_low"), (base + scale.maximum * F.col("n_other_missing") / F.col("n_candidate")).alias("hypothetical_mean_high"),
    )
