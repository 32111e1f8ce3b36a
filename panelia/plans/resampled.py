"""Queries of beats, masks and bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.operators import beats, descriptives, identities, resampled
from panelia.plans.common import panel, table, with_panel
from panelia.plans.panels import SD, SEEN

WINDOWS = [(1, 5), (6, 10), (16, 20)]
SEED, FEW, MANY = 7, 20, 50


def beat_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") / 150).alias("t"), (F.col("event_type") != "error").alias("sure"))


def interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.interval_labels(beat_times(spark, sf_dir), "user_id", "t", F.col("sure"), 0.3, 1.8, 0.25)


def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.interval_score(beat_times(spark, sf_dir), "user_id", "t").select("user_id", F.round("score", 9).alias("score"))


def robust_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.robust_snr(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("snr", 6).alias("snr"))


def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.mask_summary(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("m"), (F.col("event_id") % 2).alias("r")).agg(F.max(F.round("value")).alias("v"))
    e = e.withColumn("v", F.when(F.col("v") >= 400, F.col("v")))
    return beats.sweep_summary(e, ["user_id"], ["m", "r"], {"m": 0, "r": 0}, "v")


def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("g")).agg(F.count("*").alias("size"))
    return identities.group_sizes(sizes, ["event_type"], "g", "size")


def median_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.round(F.col("c_acctbal") * 100).alias("v"))
    drawn = resampled.draws(c, "c_custkey", MANY, SEED, ["c_nationkey"])
    return resampled.endpoints(resampled.resampled_medians(c, drawn, "c_custkey", ["c_nationkey"], "v"), ["c_nationkey"], "median")


def slope_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 100).cast("double").alias("x"), F.round(F.col("value") * 100).alias("y"))
    found = resampled.resampled_slopes(e, "user_id", "x", "y", MANY, SEED).withColumn("slope", F.round("slope", 6))
    return resampled.endpoints(found, [], "slope")


def people(frame: DataFrame) -> DataFrame:
    return resampled.draws(frame, "subject_id", FEW, SEED)


def variability_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled.variability_statistics(descriptives.window_metrics(panel(spark, sf_dir), WINDOWS), (1, 5), (16, 20))
    return found.select("subject_id", "statistic", F.round("value", 6).alias("value"))


def variability_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled.resampled_medians(variability_statistics(spark, sf_dir), people(panel(spark, sf_dir)), "subject_id", ["statistic"], "value")
    return resampled.endpoints(found, ["statistic"], "median").select("statistic", "valid", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


def change_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return resampled.endpoints(resampled.resampled_means(descriptives.finite_changes(p), people(p), "subject_id", ["time_min", "h"], "change"), ["time_min", "h"], "mean")


QUERIES = {f.__name__: f for f in (interval_labels, interval_scores, robust_ranges, mask_summary, sweep_summary, group_sizes, median_intervals, slope_intervals, variability_statistics, variability_intervals, change_intervals)}


def drawn(rows: str, replicates: int, by: str = "") -> str:
    """Common tables numbered(by, id, j, n) of the rows' ids, and drawn(by, r, id), a row a draw."""
    g, on = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""numbered AS (SELECT {g}id, row_number() OVER ({on}ORDER BY substr(md5(CAST(id AS VARCHAR)), 1, 3), id) - 1 AS j, count(*) OVER ({on.strip()}) AS n FROM (SELECT DISTINCT {g}id FROM {rows})),
      slots AS (SELECT {g}n, r, unnest(range(n)) AS i FROM (SELECT DISTINCT {g}n FROM numbered), range({replicates}) t(r)),
      drawn AS (SELECT {"s." + by + "," if by else ""} s.r, p.id FROM slots s JOIN numbered p ON {f"s.{by} = p.{by} AND" if by else ""} p.j = CAST(('0x' || substr(md5('{SEED}:' || s.r || ':' || s.i), 1, 8)) AS BIGINT) % s.n)"""


LOW, HIGH = (1 - 0.95) / 2, 1 - (1 - 0.95) / 2
ENDS = f"count(*) AS valid, quantile_disc({{0}}, {LOW}::DOUBLE) AS low, quantile_disc({{0}}, {HIGH}::DOUBLE) AS high"
BEATS = """b AS (SELECT user_id, event_id / 150.0::DOUBLE AS t, event_type <> 'error' AS sure FROM events),
  i AS (SELECT user_id, lag(t) OVER w AS start, t AS stop, t - lag(t) OVER w AS v, sure AND lag(sure) OVER w AS sure FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  k AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY start) AS p FROM i WHERE start IS NOT NULL)"""
METRICS = ("mean_vas", "sample_sd", "mssd", "rmssd", "mean_adjacent_change", "centered_change_ms")
STATISTICS = [
    SEEN,
    f"""m AS (SELECT subject_id, a, b, count(*) = b - a + 1 AS complete, count(d) >= 3 AS eligible, sum(vas) / count(*) AS mean_vas, {SD.format("vas")} AS sample_sd, sum(d * d) / nullif(count(d), 0) AS mssd, sqrt(sum(d * d) / nullif(count(d), 0)) AS rmssd,
        sum(d) / nullif(count(d), 0) AS mean_adjacent_change, (count(d) * sum(d * d) - sum(d) * sum(d)) / nullif(count(d) * count(d), 0) AS centered_change_ms
      FROM (SELECT s.*, w.*, CASE WHEN time_min > a THEN vas - p END AS d FROM seen s JOIN (VALUES (1, 5), (6, 10), (16, 20)) w(a, b) ON time_min BETWEEN a AND b) GROUP BY subject_id, a, b)""",
    f"u AS (SELECT subject_id, a, b, complete, eligible, unnest([{', '.join(repr(x) for x in METRICS)}]) AS metric, unnest([{', '.join(METRICS)}]) AS x FROM m)",
    """st AS (SELECT subject_id, 'raw_' || a || '_' || b || '_at_least_3_pairs_' || metric AS statistic, round(CASE WHEN eligible THEN x END, 6) AS value FROM u
      UNION ALL SELECT subject_id, 'raw_' || a || '_' || b || '_complete_window_' || metric, round(CASE WHEN complete THEN x END, 6) FROM u
      UNION ALL SELECT subject_id, 'paired_16_20_minus_1_5_' || metric, round(max(x) FILTER (complete AND a = 16) - max(x) FILTER (complete AND a = 1), 6) FROM u GROUP BY subject_id, metric)""",
]
ORACLES = {
    "interval_labels": f"""WITH {BEATS} SELECT user_id, start, stop, v AS "interval", CASE reason WHEN 'absolute_bounds' THEN 'RR_OUT_OF_RANGE' WHEN 'uncertain_r_peak' THEN 'RR_UNCERTAIN' WHEN 'adjacent_jump' THEN 'RR_ECTOPIC' ELSE 'NN_CLEAN' END AS label, reason
      FROM (SELECT *, CASE WHEN v NOT BETWEEN 0.3 AND 1.8 THEN 'absolute_bounds' WHEN NOT sure THEN 'uncertain_r_peak' WHEN abs(v - p) / greatest(p, 1e-9) > 0.25 THEN 'adjacent_jump' ELSE '' END AS reason FROM k)""",
    "interval_scores": f"""WITH {BEATS} SELECT user_id, round(0.5::DOUBLE * n_ok / n + 0.5::DOUBLE * coalesce(CAST(j AS DOUBLE) / nullif(m, 0), 0), 9) AS score FROM (
      SELECT user_id, count(*) AS n, count(p) AS m, count(*) FILTER (v BETWEEN 0.3 AND 1.8) AS n_ok, count(*) FILTER (v BETWEEN 0.3 AND 1.8 AND p BETWEEN 0.3 AND 1.8 AND abs(v - p) / greatest(p, 1e-12) <= 0.25) AS j FROM k GROUP BY user_id)""",
    "robust_ranges": """WITH c AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id)
      SELECT user_id, round(20 * log10(greatest(max(value) - min(value), 1e-12) / greatest(median(abs(value - m)) * 1.4826, 1e-12)), 6) AS snr FROM events JOIN c USING (user_id) GROUP BY user_id""",
    "mask_summary": """WITH r AS (SELECT user_id, event_type = 'error' AS f, sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
      SELECT user_id, sum(n_f) / CAST(sum(n) AS DOUBLE) AS flagged_ratio, CAST(max(n - n_f) AS BIGINT) AS longest_clear FROM (SELECT user_id, i, count(*) AS n, count(*) FILTER (f) AS n_f FROM r GROUP BY user_id, i) GROUP BY user_id""",
    "sweep_summary": """WITH s AS (SELECT user_id, m, r, CASE WHEN v >= 400 THEN v END AS v FROM (SELECT user_id, event_id % 3 AS m, event_id % 2 AS r, max(round(value)) AS v FROM events GROUP BY ALL))
      SELECT s.m, s.r, count(*) AS n, count(s.v) AS n_candidates, median(abs(s.v - a.v)) AS median_distance, max(abs(s.v - a.v)) AS max_distance FROM s LEFT JOIN s a ON a.user_id = s.user_id AND a.m = 0 AND a.r = 0 GROUP BY s.m, s.r""",
    "group_sizes": """SELECT event_type, count(*) AS k, CAST(sum(n) AS BIGINT) AS n_people, string_agg(CAST(n AS VARCHAR), ' / ' ORDER BY g) AS group_sizes FROM (SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""",
    "median_intervals": f"""WITH c AS (SELECT c_nationkey AS g, c_custkey AS id, round(c_acctbal * 100) AS v FROM customer), {drawn("c", MANY, "g")}, md AS (SELECT g, r, median(v) AS x FROM drawn JOIN c USING (g, id) GROUP BY g, r)
      SELECT g AS c_nationkey, {ENDS.format("x")} FROM md GROUP BY g""",
    "slope_intervals": f"""WITH e AS (SELECT user_id AS id, CAST(event_id % 100 AS DOUBLE) AS x, round(value * 100) AS y FROM events), {drawn("e", MANY)},
      q AS (SELECT id, sum(x * x) - sum(x) * sum(x) / count(*) AS xx, sum(x * y) - sum(x) * sum(y) / count(*) AS xy FROM e GROUP BY id), sl AS (SELECT r, round(sum(xy) / nullif(sum(xx), 0), 6) AS b FROM drawn JOIN q USING (id) GROUP BY r) SELECT {ENDS.format("b")} FROM sl""",
    "variability_statistics": with_panel("SELECT * FROM st", *STATISTICS),
    "variability_intervals": with_panel(
        f"SELECT statistic, valid, round(low, 5) AS low, round(high, 5) AS high FROM (SELECT statistic, {ENDS.format('x')} FROM (SELECT statistic, r, median(value) AS x FROM drawn JOIN st ON st.subject_id = drawn.id WHERE value IS NOT NULL GROUP BY statistic, r) GROUP BY statistic)",
        *STATISTICS,
        "ids AS (SELECT subject_id AS id FROM panel)",
        drawn("ids", FEW),
    ),
    "change_intervals": with_panel(
        f"""SELECT time_min, h, {ENDS.format("x")} FROM (SELECT time_min, h, r, sum(v - vas) / count(*) AS x FROM drawn JOIN (SELECT a.subject_id, a.time_min, CAST(h AS INTEGER) AS h, a.vas, max(b.vas) FILTER (b.time_min = a.time_min + h) AS v, count(b.vas) AS n
        FROM panel a, (VALUES (1), (2), (5)) hs(h), panel b WHERE a.subject_id = b.subject_id AND b.time_min BETWEEN a.time_min AND a.time_min + h GROUP BY a.subject_id, a.time_min, h, a.vas) c ON c.subject_id = drawn.id WHERE n = h + 1 GROUP BY time_min, h, r) GROUP BY time_min, h""",
        "ids AS (SELECT subject_id AS id FROM panel)",
        drawn("ids", FEW),
    ),
}
