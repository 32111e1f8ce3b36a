"""Queries of statistics over panels, blocks and event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.operators import statistics as st
from panelia.plans.common import panel, table, with_panel

LOW, HIGH = 60_000_000, 6 * 3_600_000_000


def click_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    return e.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundredths of spending and numbers of orders by customer and year: a repeated-block panel."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("block")).agg(F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("y"), F.count("*").alias("x"))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).where("vas is not null")
    return p.groupBy("time_min").agg(st.quantile_linear(F.col("vas"), 0.25).alias("q25"), F.expr("percentile_disc(0.025) within group (order by vas)").alias("low"), F.expr("percentile_disc(0.5) within group (order by vas)").alias("lower_median"), F.median("vas").alias("median"))


def burden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = st.burden(panel(spark, sf_dir), ["subject_id"], 1, 10)
    return b.select("subject_id", "area", F.round("centroid", 9).alias("centroid"), "late_fraction")


def standardized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.standardized(blocks(spark, sf_dir), "o_custkey", "block", "y").select("o_custkey", "block", F.round("z", 9).alias("z"))


def fixed_effect_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.fixed_effect_slope(blocks(spark, sf_dir).withColumn("y", F.col("y").cast("double")), "o_custkey", "y", "x")
    return s.select("people", "rows", F.round("slope", 4).alias("slope"), F.round("se_cr1", 4).alias("se_cr1"))


def two_way_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.two_way_slope(blocks(spark, sf_dir), "o_custkey", "block", "y", "x").select("n", F.round("slope", 3).alias("slope"))


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.spearman(blocks(spark, sf_dir), ["block"], "x", "y").select("block", "n", F.round("rho", 9).alias("rho"))


def adjusted_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 101 + 1) / 20200.0).alias("p"))
    by, bh = st.adjust(p, "p", "BY").select("s_suppkey", F.round("q", 9).alias("q_by")), st.adjust(p, "p", "BH").select("s_suppkey", F.round("q", 9).alias("q_bh"))
    return by.join(bh, "s_suppkey")


def clock_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.select("event_type", F.col("event_id").cast("double").alias("device_time"), (F.col("event_id") * 1.5 + F.dayofmonth("ts")).alias("reference_time"), (F.col("event_id") % 5 == 0).alias("held_out"))
    f = st.clock_fit(a, ["event_type"])
    return f.select("event_type", "n_fit", F.round("slope", 9).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("max_holdout_error", 5).alias("max_holdout_error"))


def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = st.gap_summary(click_times(spark, sf_dir), "user_id", "t", LOW, HIGH)
    return g.select("user_id", "n_ok", "n_flagged", "mean_gap", "n_pairs", F.round(F.col("rmssd") / 1e6, 4).alias("rmssd_s"))


def continuity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.continuity_blocks(click_times(spark, sf_dir), "user_id", "t", LOW, HIGH, 0.2)


def time_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.time_segments(click_times(spark, sf_dir), "user_id", "t")


QUERIES = {f.__name__: f for f in (score_quantiles, burden_metrics, standardized_blocks, fixed_effect_slope, two_way_slope, rank_correlation, adjusted_p, clock_fits, gap_summary, continuity_blocks, time_segments)}
QUERIES |= {
    "block_support": lambda s, d: st.block_support(panel(s, d)),
    "lagged_features": lambda s, d: st.lagged_features(panel(s, d)),
    "last_value_errors": lambda s, d: st.last_value_errors(st.lagged_features(panel(s, d))).withColumn("mae_person", F.round("mae_person", 6)),
    "band_depth": lambda s, d: st.band_depth(panel(s, d).where("time_min <= 5"), 5),
    "band_envelope": lambda s, d: st.band_envelope(panel(s, d).where("time_min <= 5"), 5),
}

BLOCKS = "blocks AS (SELECT o_custkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS block, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS y, count(*) AS x FROM orders GROUP BY ALL)"
CLICKS = "clicks AS (SELECT user_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t FROM events WHERE event_type = 'click'), gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM clicks)"
OKS = f"oks AS (SELECT *, gap BETWEEN {LOW} AND {HIGH} AS ok FROM gaps WHERE gap IS NOT NULL)"
DEPTHS = [
    "c AS (SELECT * FROM panel WHERE time_min <= 5 AND subject_id IN (SELECT subject_id FROM panel WHERE time_min <= 5 GROUP BY subject_id HAVING count(vas) = 5))",
    "sides AS (SELECT a.subject_id, a.time_min, count(*) AS n, count(*) FILTER (b.vas < a.vas) AS l, count(*) FILTER (b.vas > a.vas) AS g FROM c a JOIN c b USING (time_min) GROUP BY a.subject_id, a.time_min)",
    """depths AS (SELECT subject_id, CAST(sum(w * (n * (n - 1) // 2 - l * (l - 1) // 2 - g * (g - 1) // 2)) AS DOUBLE) / sum(w * (n * (n - 1) // 2)) AS depth
      FROM (SELECT *, CASE WHEN time_min IN (1, 5) THEN 1 ELSE 2 END AS w FROM sides) GROUP BY subject_id)""",
    "half AS (SELECT depth AS cutoff FROM (SELECT depth, row_number() OVER (ORDER BY depth DESC) AS k, count(*) OVER () AS n FROM depths) WHERE k = (n + 1) // 2)",
]
LAGS = """lags AS (SELECT p.subject_id, p.time_min, a.vas AS x1, b.vas AS x2, c.vas AS x3, p.vas AS y FROM panel p JOIN panel a ON a.subject_id = p.subject_id AND a.time_min = p.time_min - 3
  JOIN panel b ON b.subject_id = p.subject_id AND b.time_min = p.time_min - 2 JOIN panel c ON c.subject_id = p.subject_id AND c.time_min = p.time_min - 1 WHERE a.vas + b.vas + c.vas + p.vas IS NOT NULL)"""
ORACLES = {
    "score_quantiles": with_panel("SELECT time_min, quantile_cont(vas, 0.25) AS q25, quantile_disc(vas, 0.025) AS low, quantile_disc(vas, 0.5) AS lower_median, median(vas) AS median FROM panel WHERE vas IS NOT NULL GROUP BY time_min"),
    "burden_metrics": with_panel(
        """SELECT subject_id, area, CASE WHEN area > 0 THEN round(m / area, 9) END AS centroid, CASE WHEN area > 0 THEN late / area END AS late_fraction FROM (
          SELECT subject_id, sum((vas + b) / 2) AS area, sum((vas * (3 * time_min + 1) + b * (3 * time_min + 2)) / 6) AS m, sum(CASE WHEN b IS NULL THEN NULL WHEN time_min >= 5.5 THEN (vas + b) / 2 WHEN time_min = 5 THEN (vas + (b - vas) * 0.5::DOUBLE + b) / 2 * 0.5::DOUBLE ELSE 0 END) AS late, count(*) AS n
          FROM (SELECT *, lead(vas) OVER (PARTITION BY subject_id ORDER BY time_min) AS b FROM panel WHERE time_min <= 10 AND vas IS NOT NULL) GROUP BY subject_id) WHERE n = 10"""
    ),
    "standardized_blocks": f"""WITH {BLOCKS}, s AS (SELECT o_custkey, count(*) AS n, sum(y) AS sy, sum(CAST(y AS HUGEINT) * y) AS qy FROM blocks GROUP BY o_custkey)
      SELECT o_custkey, block, round((y - CAST(sy AS DOUBLE) / n) / sqrt(CAST(n * qy - sy * sy AS DOUBLE) / (n * (n - 1))), 9) AS z FROM blocks JOIN s USING (o_custkey) WHERE n >= 2 AND n * qy > sy * sy""",
    "fixed_effect_slope": f"""WITH {BLOCKS}, s AS (SELECT count(*) AS n, sum(CAST(x AS DOUBLE) * x) - sum(CAST(x AS DOUBLE)) * sum(CAST(x AS DOUBLE)) / count(*) AS h, sum(CAST(x AS DOUBLE) * y) - sum(CAST(x AS DOUBLE)) * sum(CAST(y AS DOUBLE)) / count(*) AS c FROM blocks GROUP BY o_custkey HAVING count(*) >= 2),
      b AS (SELECT sum(c) / sum(h) AS b, sum(h) AS hh, count(*) AS g, CAST(sum(n) AS BIGINT) AS r FROM s)
      SELECT g AS people, r AS rows, round(b, 4) AS slope, round(sqrt(g / (g - 1.0::DOUBLE) * (r - 1.0::DOUBLE) / (r - g - 1) * (SELECT sum((c - h * b) * (c - h * b)) FROM s)) / hh, 4) AS se_cr1 FROM b""",
    "two_way_slope": "WITH "
    + BLOCKS
    + ", r0 AS (SELECT o_custkey AS p, block, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM blocks)"
    + "".join(f", r{i + 1} AS (SELECT p, block, y - avg(y) OVER (PARTITION BY {k}) AS y, x - avg(x) OVER (PARTITION BY {k}) AS x FROM r{i})" for i, k in enumerate(["p", "block"] * 4))
    + " SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 3) AS slope FROM r8",
    "rank_correlation": f"""WITH {BLOCKS}, r AS (SELECT block, rank() OVER (PARTITION BY block ORDER BY x) + (count(*) OVER (PARTITION BY block, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY block ORDER BY y) + (count(*) OVER (PARTITION BY block, y) - 1) / 2.0::DOUBLE AS b FROM blocks)
      SELECT block, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN round(corr(a, b), 9) END AS rho FROM r GROUP BY block""",
    "adjusted_p": """WITH f AS (SELECT s_suppkey, (s_suppkey * 37 % 101 + 1) / 20200.0::DOUBLE AS p FROM supplier), m AS (SELECT count(*) AS m, (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) FROM supplier) + 1) t(i)) AS f FROM supplier),
      r AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM f, m)
      SELECT s_suppkey, round(least(1, min(p * m * f / r) OVER w), 9) AS q_by, round(least(1, min(p * m / r) OVER w), 9) AS q_bh FROM r WINDOW w AS (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)""",
    "clock_fits": """WITH a AS (SELECT event_type, CAST(event_id AS DOUBLE) AS x, event_id * 1.5::DOUBLE + extract(day FROM ts) AS y, event_id % 5 = 0 AS h FROM events),
      f AS (SELECT event_type, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM a WHERE NOT h GROUP BY event_type)
      SELECT event_type, n AS n_fit, round(s, 9) AS slope, round(i, 5) AS intercept, round(max(CASE WHEN h THEN abs(y - (s * x + i)) END), 5) AS max_holdout_error FROM a JOIN f USING (event_type) GROUP BY event_type, n, s, i""",
    "gap_summary": f"""WITH {CLICKS}, {OKS} SELECT user_id, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_flagged, sum(gap) FILTER (ok) / CAST(nullif(count(*) FILTER (ok), 0) AS DOUBLE) AS mean_gap, count(d) AS n_pairs,
        round(sqrt(sum(CAST(d AS DOUBLE) * d) / nullif(count(d), 0)) / 1e6, 4) AS rmssd_s FROM (SELECT *, CASE WHEN ok AND lag(ok) OVER w THEN gap - lag(gap) OVER w END AS d FROM oks WINDOW w AS (PARTITION BY user_id ORDER BY t)) GROUP BY user_id""",
    "continuity_blocks": f"""WITH {CLICKS}, {OKS} SELECT user_id, t, gap, block FROM (SELECT *, sum(CASE WHEN ok AND edge THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS block
        FROM (SELECT *, NOT coalesce(lag(ok) OVER w, false) OR abs(ln(gap) - ln(lag(gap) OVER w)) > ln(1.2) AS edge FROM oks WINDOW w AS (PARTITION BY user_id ORDER BY t))) WHERE ok""",
    "time_segments": f"""WITH {CLICKS}, m AS (SELECT user_id, median(gap) AS m FROM gaps WHERE gap IS NOT NULL GROUP BY user_id)
      SELECT user_id, segment, min(t) AS start, max(t) AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > 1.5 * m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS segment FROM gaps JOIN m USING (user_id)) GROUP BY user_id, segment""",
    "block_support": with_panel(
        """SELECT subject_id, block, start_min, end_min, n = 5 AS complete, s / n AS vas_mean FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, block ORDER BY n DESC, start_min) AS k FROM (
          SELECT subject_id, block, min(time_min) AS start_min, max(time_min) AS end_min, count(*) AS n, sum(vas) AS s FROM (SELECT *, CAST(floor((time_min - 1) / 5.0) AS INTEGER) AS block, time_min - row_number() OVER (PARTITION BY subject_id, CAST(floor((time_min - 1) / 5.0) AS INTEGER) ORDER BY time_min) AS i FROM panel WHERE status = 'observed')
          GROUP BY subject_id, block, i)) WHERE k = 1 AND n >= 3"""
    ),
    "lagged_features": with_panel("SELECT * FROM lags", LAGS),
    "last_value_errors": with_panel(
        "SELECT CAST(sum(n) AS BIGINT) AS n_windows, count(*) AS n_people, sum(a) / sum(n) AS mae_window, sum(q) / sum(n) AS mse_window, round(sum(a / n) / count(*), 6) AS mae_person FROM (SELECT subject_id, count(*) AS n, sum(abs(y - x3)) AS a, sum((y - x3) * (y - x3)) AS q FROM lags GROUP BY subject_id)", LAGS
    ),
    "band_depth": with_panel("SELECT subject_id, depth, depth >= cutoff - 1e-12 AS central FROM depths, half", *DEPTHS),
    "band_envelope": with_panel("SELECT time_min, min(vas) AS low, max(vas) AS high FROM c JOIN depths USING (subject_id), half WHERE depth >= cutoff - 1e-12 GROUP BY time_min", *DEPTHS),
}
