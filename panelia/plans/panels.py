"""Queries of the rating panel."""

from __future__ import annotations

from panelia.operators import descriptives, missingness, stopping
from panelia.plans.common import SCALE, panel, with_panel

WINDOWS = [(1, 5), (6, 10), (1, 10), (11, 20)]
CUTS = [3000.0, 6000.0]

QUERIES = {
    "status_panel": panel,
    "time_counts": lambda s, d: descriptives.time_counts(panel(s, d)),
    "subject_summary": lambda s, d: descriptives.subject_summary(panel(s, d)),
    "window_metrics": lambda s, d: descriptives.window_metrics(panel(s, d), WINDOWS),
    "finite_changes": lambda s, d: descriptives.finite_changes(panel(s, d)),
    "audit_stopping": lambda s, d: stopping.audit_stopping(panel(s, d)),
    "stopping_distribution": lambda s, d: stopping.stopping_distribution(stopping.audit_stopping(panel(s, d))),
    "grouped_observed": lambda s, d: stopping.grouped_observed(panel(s, d)),
    "bounded_means": lambda s, d: stopping.bounded_means(panel(s, d), SCALE),
    "area_bounds": lambda s, d: stopping.area_bounds(stopping.bounded_means(panel(s, d), SCALE)).selectExpr("start_min", "end_min", *(f"round({c}, 3) as {c}" for c in AREAS)),
    "post_stop_grid": lambda s, d: stopping.post_stop_grid(panel(s, d), [0.0, 10_000.0], [10_000.0, 20_000.0], SCALE),
    "classify_subjects": lambda s, d: missingness.classify_subjects(panel(s, d)),
    "adjacent_composition": lambda s, d: missingness.adjacent_composition(panel(s, d)),
    "state_points": lambda s, d: missingness.state_points(panel(s, d), CUTS),
    "state_transitions": lambda s, d: missingness.state_transitions(missingness.state_points(panel(s, d), CUTS)),
    "state_spells": lambda s, d: missingness.state_spells(missingness.state_points(panel(s, d), CUTS)),
    "recode_connected_zeros": lambda s, d: missingness.recode_connected_zeros(panel(s, d)),
    "continuous_runs": lambda s, d: missingness.islands(panel(s, d), "status = 'observed'", ["subject_id"], "time_min").where("length >= 3"),
}
AREAS = ["candidate_mean_auc_lower", "candidate_mean_auc_upper", "width_due_to_E", "width_due_to_T", "width_due_to_other_missing"]

SEEN = """seen AS (SELECT *, CASE WHEN time_min - lag(time_min) OVER w = 1 THEN lag(vas) OVER w END AS p
  FROM panel WHERE status = 'observed' WINDOW w AS (PARTITION BY subject_id ORDER BY time_min))"""
SD = "CASE WHEN count({0}) > 1 THEN sqrt((count({0}) * sum({0} * {0}) - sum({0}) * sum({0})) / (count({0}) * (count({0}) - 1))) END"
AUDIT = """marks AS (SELECT subject_id, min(time_min) AS f, arg_min(termination_code, time_min) AS code FROM panel WHERE status LIKE 'termination_%' GROUP BY subject_id),
audit AS (SELECT a.subject_id, coalesce(m.code, 'none') AS eventual_marker, m.f AS first_marker_min,
    count(*) FILTER (status = 'observed') AS n_observed, max(time_min) FILTER (status = 'observed') AS last_observed_min,
    arg_max(vas, time_min) FILTER (status = 'observed') AS last_observed_vas,
    max(vas) FILTER (time_min = m.f - 2) AS preceding_2min_vas, max(vas) FILTER (time_min = m.f - 1) AS preceding_1min_vas
  FROM panel a LEFT JOIN marks m USING (subject_id) GROUP BY a.subject_id, m.code, m.f)"""
BOUNDS = """bounds AS (SELECT time_min, count(*) AS n_candidate, count(vas) AS n_observed, coalesce(sum(vas), 0) AS observed_sum,
    count(*) FILTER (status <> 'observed' AND termination_code = 'E') AS n_unobserved_E, count(*) FILTER (status <> 'observed' AND termination_code = 'T') AS n_unobserved_T,
    count(*) FILTER (status <> 'observed' AND termination_code = '') AS n_other_missing FROM panel GROUP BY time_min),
wide_bounds AS (SELECT *, observed_sum / n_candidate AS cohort_mean_lower, (observed_sum + (n_candidate - n_observed) * 20000.0) / n_candidate AS cohort_mean_upper,
    n_unobserved_E * 20000.0::DOUBLE / n_candidate AS width_due_to_E, n_unobserved_T * 20000.0::DOUBLE / n_candidate AS width_due_to_T, n_other_missing * 20000.0::DOUBLE / n_candidate AS width_due_to_other_missing FROM bounds)"""
STATE = "points AS (SELECT subject_id, time_min, CAST((vas >= 3000) AS INTEGER) + CAST((vas >= 6000) AS INTEGER) AS state, vas FROM panel WHERE status = 'observed')"
STEPS = """steps AS (SELECT *, coalesce(time_min - lag(time_min) OVER w = 1, false) AS adjacent, lag(state) OVER w AS before, lead(time_min) OVER w - time_min AS far
  FROM points WINDOW w AS (PARTITION BY subject_id ORDER BY time_min))"""

ORACLES = {
    "status_panel": with_panel("SELECT * FROM panel"),
    "time_counts": with_panel(
        "SELECT time_min, count(*) AS n_scheduled, "
        + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ("observed", "missing", "termination_E", "termination_T", "post_termination"))
        + " FROM panel GROUP BY time_min"
    ),
    "subject_summary": with_panel(
        f"""SELECT a.subject_id, count(s.vas) AS n_observed, count(s.p) AS n_adjacent_pairs, sum(s.vas) / nullif(count(s.vas), 0) AS mean_observed_vas, {SD.format("s.vas")} AS raw_sd,
          sum((s.vas - s.p) * (s.vas - s.p)) / nullif(count(s.p), 0) AS raw_mssd, max(s.time_min) AS last_observed_min, coalesce(max(m.code), '') AS termination_code, max(m.f) AS first_marker_min,
          sum((s.vas + s.p) / 2) AS observed_adjacent_auc, count(s.p) AS auc_covered_minutes, max(s.vas) AS peak_observed_vas, max(k.first_peak) AS first_observed_peak_min,
          coalesce(max(s.vas) = arg_max(s.vas, s.time_min), false) AS peak_at_last_observation, count(s.vas) = 20 AS complete_1_20
        FROM panel a LEFT JOIN seen s USING (subject_id, time_min) LEFT JOIN marks m USING (subject_id) LEFT JOIN peak k USING (subject_id) GROUP BY a.subject_id""",
        SEEN,
        "marks AS (SELECT subject_id, min(time_min) AS f, arg_min(termination_code, time_min) AS code FROM panel WHERE status LIKE 'termination_%' GROUP BY subject_id)",
        "top AS (SELECT subject_id, max(vas) AS v FROM panel GROUP BY subject_id)",
        "peak AS (SELECT subject_id, min(time_min) AS first_peak FROM panel JOIN top USING (subject_id) WHERE vas = v GROUP BY subject_id)",
    ),
    "window_metrics": with_panel(
        f"""SELECT subject_id, a AS start_min, b AS end_min, count(*) AS n_observed, count(d) AS n_pairs, count(*) = b - a + 1 AS complete, count(d) >= 3 AS eligible, sum(vas) / count(*) AS mean_vas,
          {SD.format("vas")} AS sample_sd, sum(d * d) / nullif(count(d), 0) AS mssd, sqrt(sum(d * d) / nullif(count(d), 0)) AS rmssd, sum(d) / nullif(count(d), 0) AS mean_adjacent_change,
          (count(d) * sum(d * d) - sum(d) * sum(d)) / nullif(count(d) * count(d), 0) AS centered_change_ms
        FROM (SELECT s.*, w.*, CASE WHEN time_min > a THEN vas - p END AS d FROM seen s JOIN (VALUES (1, 5), (6, 10), (1, 10), (11, 20)) w(a, b) ON time_min BETWEEN a AND b) GROUP BY subject_id, a, b""",
        SEEN,
    ),
    "finite_changes": with_panel(
        """SELECT subject_id, time_min, h, v - vas AS change FROM (SELECT a.subject_id, a.time_min, CAST(h AS INTEGER) AS h, a.vas, max(b.vas) FILTER (b.time_min = a.time_min + h) AS v, count(b.vas) AS n
        FROM panel a, (VALUES (1), (2), (5)) hs(h), panel b WHERE a.subject_id = b.subject_id AND b.time_min BETWEEN a.time_min AND a.time_min + h GROUP BY a.subject_id, a.time_min, h, a.vas) WHERE n = h + 1"""
    ),
    "audit_stopping": with_panel(
        """SELECT a.*, CASE WHEN eventual_marker <> 'E' THEN 'not_applicable' WHEN preceding_1min_vas IS NULL OR preceding_2min_vas IS NULL THEN 'preceding_numeric_window_unavailable'
          WHEN preceding_1min_vas = 0 AND preceding_2min_vas = 0 THEN 'two_preceding_recorded_zeros' ELSE 'not_two_preceding_recorded_zeros_requires_review' END AS E_recorded_support,
          (SELECT count(*) FROM seen s WHERE s.subject_id = a.subject_id AND vas = 0 AND p = 0) AS n_observed_adjacent_zero_pairs,
          (SELECT min(time_min) FROM seen s WHERE s.subject_id = a.subject_id AND vas = 0 AND p = 0) AS first_recorded_zero_pair_end_min FROM audit a""",
        SEEN,
        AUDIT,
    ),
    "stopping_distribution": with_panel(
        """SELECT time_min, n AS n_candidate, count(*) FILTER (eventual_marker = 'E' AND f = time_min) AS n_first_E, count(*) FILTER (eventual_marker = 'T' AND f = time_min) AS n_first_T,
          count(*) FILTER (eventual_marker = 'E' AND f <= time_min) AS n_E_by_minute, count(*) FILTER (eventual_marker = 'T' AND f <= time_min) AS n_T_by_minute,
          count(*) FILTER (eventual_marker = 'E' AND f <= time_min) / CAST(n AS DOUBLE) AS fraction_E_by_minute, count(*) FILTER (eventual_marker = 'T' AND f <= time_min) / CAST(n AS DOUBLE) AS fraction_T_by_minute,
          n - count(*) FILTER (eventual_marker IN ('E', 'T') AND f <= time_min) AS n_without_marker_yet
        FROM (SELECT eventual_marker, first_marker_min AS f, count(*) OVER () AS n FROM audit), (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS time_min) GROUP BY time_min, n""",
        AUDIT,
    ),
    "grouped_observed": with_panel(
        """SELECT c.code AS eventual_marker, t.time_min, count(a.subject_id) AS n_group, count(p.vas) AS n_observed, sum(p.vas) / nullif(count(p.vas), 0) AS mean_observed
        FROM (VALUES ('E'), ('T'), ('none')) c(code) CROSS JOIN (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS time_min) t
        LEFT JOIN audit a ON a.eventual_marker = c.code LEFT JOIN panel p ON p.subject_id = a.subject_id AND p.time_min = t.time_min GROUP BY c.code, t.time_min""",
        AUDIT,
    ),
    "bounded_means": with_panel("SELECT * FROM wide_bounds", BOUNDS),
    "area_bounds": with_panel(
        """SELECT min(time_min) AS start_min, max(time_min) AS end_min, round(sum((cohort_mean_lower + l) / 2), 3) AS candidate_mean_auc_lower, round(sum((cohort_mean_upper + u) / 2), 3) AS candidate_mean_auc_upper,
          round(sum((width_due_to_E + e) / 2), 3) AS width_due_to_E, round(sum((width_due_to_T + t) / 2), 3) AS width_due_to_T, round(sum((width_due_to_other_missing + o) / 2), 3) AS width_due_to_other_missing
        FROM (SELECT *, lead(cohort_mean_lower) OVER w AS l, lead(cohort_mean_upper) OVER w AS u, lead(width_due_to_E) OVER w AS e, lead(width_due_to_T) OVER w AS t, lead(width_due_to_other_missing) OVER w AS o
          FROM wide_bounds WINDOW w AS (ORDER BY time_min))""",
        BOUNDS,
    ),
    "post_stop_grid": with_panel(
        """SELECT CAST(e AS DOUBLE) AS assumed_E, CAST(t AS DOUBLE) AS assumed_T, time_min, n_candidate AS n_people, n_observed, n_unobserved_E AS n_E_missing, n_unobserved_T AS n_T_missing, n_other_missing,
          (observed_sum + e * n_unobserved_E + t * n_unobserved_T) / n_candidate AS hypothetical_mean_low,
          (observed_sum + e * n_unobserved_E + t * n_unobserved_T) / n_candidate + 20000.0::DOUBLE * n_other_missing / n_candidate AS hypothetical_mean_high
        FROM bounds, (VALUES (0.0::DOUBLE), (10000.0::DOUBLE)) es(e), (VALUES (10000.0::DOUBLE), (20000.0::DOUBLE)) ts(t)""",
        BOUNDS,
    ),
    "classify_subjects": with_panel(
        """SELECT c.subject_id, coalesce(max(code), 'none') AS eventual_marker, max(f) AS first_marker_min, count(*) FILTER (category = 'observed') AS n_observed,
          count(*) FILTER (category = 'pre_marker_missing') AS n_pre_marker_missing, count(*) FILTER (category = 'post_termination_missing') AS n_post_termination_missing,
          coalesce(max(g.longest), 0) AS longest_pre_marker_gap, max(time_min) FILTER (category = 'observed') AS last_observed_min, string_agg(category, '|' ORDER BY time_min) AS pattern
        FROM cats c LEFT JOIN (SELECT subject_id, max(n) AS longest FROM (SELECT subject_id, count(*) AS n FROM (SELECT subject_id, time_min - row_number() OVER (PARTITION BY subject_id ORDER BY time_min) AS i FROM cats WHERE category = 'pre_marker_missing') GROUP BY subject_id, i) GROUP BY subject_id) g USING (subject_id)
        GROUP BY c.subject_id""",
        "marks AS (SELECT subject_id, min(time_min) AS f, arg_min(termination_code, time_min) AS code FROM panel WHERE status LIKE 'termination_%' GROUP BY subject_id)",
        "cats AS (SELECT *, CASE WHEN status IN ('observed', 'termination_E', 'termination_T') THEN status WHEN time_min > f THEN 'post_termination_missing' ELSE 'pre_marker_missing' END AS category FROM panel LEFT JOIN marks USING (subject_id))",
    ),
    "adjacent_composition": with_panel(
        """SELECT t AS start_min, t + 1 AS end_min, count(x) AS n_start, count(y) AS n_end, count(x + y) AS n_both, count(x) - count(x + y) AS n_leaving, count(y) - count(x + y) AS n_entering,
          sum(y) / nullif(count(y), 0) - sum(x) / nullif(count(x), 0) AS observed_mean_change, sum(y - x) / nullif(count(x + y), 0) AS paired_observed_change,
          sum(x) FILTER (y IS NOT NULL) / nullif(count(x + y), 0) - sum(x) / nullif(count(x), 0) AS start_composition,
          sum(y) / nullif(count(y), 0) - sum(y) FILTER (x IS NOT NULL) / nullif(count(x + y), 0) AS end_composition,
          (sum(x) FILTER (y IS NOT NULL) / nullif(count(x + y), 0) - sum(x) / nullif(count(x), 0)) + (sum(y) / nullif(count(y), 0) - sum(y) FILTER (x IS NOT NULL) / nullif(count(x + y), 0)) AS composition_total, count(x + y) > 0 AS defined
        FROM (SELECT a.time_min AS t, a.vas AS x, b.vas AS y FROM panel a JOIN panel b ON a.subject_id = b.subject_id AND b.time_min = a.time_min + 1) GROUP BY t"""
    ),
    "state_points": with_panel("SELECT * FROM points", STATE),
    "state_transitions": with_panel("SELECT before AS from_state, state AS to_state, count(*) AS n FROM steps WHERE adjacent GROUP BY before, state", STATE, STEPS),
    "state_spells": with_panel(
        """SELECT subject_id, state, min(time_min) AS start_min, max(time_min) AS end_min, count(*) AS n_observed, max(time_min) - min(time_min) AS observed_span_min, NOT arg_min(adjacent, time_min) AS left_censored,
          CASE WHEN arg_min(adjacent, time_min) THEN 'observed_transition' ELSE 'observation_start_or_gap' END AS left_boundary, coalesce(arg_max(f, time_min), 2) > 1 AS right_censored,
          CASE WHEN arg_max(f, time_min) = 99 THEN 'observation_end' WHEN arg_max(f, time_min) > 1 THEN 'observation_gap' ELSE 'observed_transition' END AS right_boundary
        FROM (SELECT *, coalesce(far, 99) AS f, sum(CASE WHEN adjacent AND before = state THEN 0 ELSE 1 END) OVER (PARTITION BY subject_id ORDER BY time_min) AS spell FROM steps) GROUP BY subject_id, spell, state""",
        STATE,
        STEPS,
    ),
    "recode_connected_zeros": with_panel(
        """SELECT p.subject_id, p.time_min, m.f AS old_first_E_min, coalesce(b.last_block, 0) + 1 AS new_first_E_min FROM panel p JOIN marks m USING (subject_id)
        LEFT JOIN (SELECT subject_id, max(time_min) AS last_block FROM panel JOIN marks USING (subject_id) WHERE time_min < f AND (vas IS NULL OR vas <> 0) GROUP BY subject_id) b USING (subject_id)
        WHERE m.code = 'E' AND p.time_min BETWEEN coalesce(b.last_block, 0) + 1 AND m.f""",
        "marks AS (SELECT subject_id, min(time_min) AS f, arg_min(termination_code, time_min) AS code FROM panel WHERE status LIKE 'termination_%' GROUP BY subject_id)",
    ),
    "continuous_runs": with_panel(
        """SELECT subject_id, min(time_min) AS start, max(time_min) AS "end", count(*) AS length FROM (SELECT *, time_min - row_number() OVER (PARTITION BY subject_id ORDER BY time_min) AS i FROM panel WHERE status = 'observed')
        GROUP BY subject_id, i HAVING count(*) >= 3"""
    ),
}
