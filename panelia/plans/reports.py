"""Queries of reports, checks of tables, beats and spectra in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelia.functions import scalars
from panelia.operators import beats, reports, resampled, waveforms
from panelia.plans.common import panel, table, with_panel
from panelia.plans.resampled import beat_times
from panelia.plans.scalars import RULES

TEMPLATE = {-2: -2, -1: 1, 0: 4, 1: 1, 2: -2}
MODELS = ["AIR", "RAIL", "SHIP"]
TARGETS = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
ROOTS = ["HTTPS:", "http://thther.example.org/"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every person's events as a record of evenly spaced samples, in whole hundredths."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", i.alias("i"), F.round(F.col("value") * 100).alias("y"), "event_type")


def beat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    return beats.event_windows(s, s.where("event_type = 'error'"), "user_id", "i", "y", -2, 3)


def beat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.beat_metrics(beat_times(spark, sf_dir), "user_id", "t", 0.3, 8.0, 0.9)
    return found.withColumns({c: F.round(c, 6) for c in ("nn_valid_fraction", "mean_hr_bpm", "rmssd_ms", "longest_contiguous_s")})


def beat_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = beats.projections(beat_windows(spark, sf_dir), "user_id", TEMPLATE)
    return found.select("user_id", "event", F.round("correlation", 6).alias("correlation"), F.round("factor", 4).alias("factor"), F.round("rms", 4).alias("rms"), F.round("template_rms", 6).alias("template_rms"))


def morphology_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats.morphology_score(beat_windows(spark, sf_dir), "user_id").withColumn("score", F.round("score", 6))


def sine_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("t", F.col("i") / 2)
    return waveforms.sine_fit(s, "user_id", "t", "y", 3.0).select("user_id", F.round("amplitude", 3).alias("amplitude"), F.round("phase", 5).alias("phase"))


def band_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("f", F.col("i") / 4)
    return waveforms.band_integral(s, "user_id", "f", "y", 2.1, 7.9).withColumn("integral", F.round("integral", 3))


def step_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("y", F.floor(F.col("y") / 5000))
    return waveforms.step_profile(s, "user_id", "i", "y").withColumns({c: F.round(c, 9) for c in ("zero_share", "modal_share")})


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled.order_ranks(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n", 0.025, 0.05)


def cohort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cohort_table(panel(spark, sf_dir))


def sparse_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return reports.sparse_curves(panel(spark, sf_dir), 1, 10).select("subject_id", text("minutes").alias("minutes"), text("scores").alias("scores"), "reason")


def selected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("l_partkey") % 4).cast("int"))
    of = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber", "l_linestatus", F.coalesce(model, F.lit("other")).alias("model"), "l_suppkey")
    q = of.agg(F.min("l_quantity").cast("double").alias("low"), F.max("l_quantity").cast("double").alias("high"), F.count("*").alias("repeats"))
    return reports.selected_results(q, {"l_returnflag": "R", "l_linestatus": "F"}, ["l_linenumber", "l_suppkey"], "model", MODELS, "repeats", 2, ["low", "high"])


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, ("hurry", "open", "other"))), (F.col("c_custkey") % 3).cast("int"))
    counts = table(spark, sf_dir, "customer").groupBy(code.alias("code")).agg(F.count_if(F.col("c_acctbal") > 0).alias("k"), F.count("*").alias("n"))
    return reports.rule_table(spark, RULES, counts, "code", "k", "n").withColumn("proportion", F.round("proportion", 9))


def module_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") * 100).cast("long").alias("planned"), F.col("n_name").alias("run"))
    attempts = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("target"), (F.when(F.col("c_nationkey") % 3 == 0, F.floor(F.col("c_custkey") % 17 / 12)).otherwise(1) * 1000).cast("long").alias("attempted"))
    return reports.module_table(modules, "n_nationkey", "planned", "run", attempts, "target", "attempted", TARGETS)


def cell_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("price"))
    k = F.col("l_orderkey")
    actual = found.where(k % 11 != 0).withColumns({"n": F.when(k % 13 != 0, F.col("n") + F.when(k % 7 == 0, 1).otherwise(0)), "price": F.col("price") * F.when(k % 5 == 0, 1 + 1e-14).otherwise(1.0) + F.when(k % 17 == 0, 1.0).otherwise(0.0)})
    return reports.cell_differences(actual, found.where(k % 19 != 0), ["l_orderkey"]).select("l_orderkey", "cell", "reason")


def scenario_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 5 + 2).alias("s"), (F.col("event_id") % 23 == 0).alias("again"))
    e = e.agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"), F.count_if(F.col("event_type") == "error").alias("m"))
    e = e.withColumn("agreement", F.when(F.col("a") + F.col("b") > 0, 2.0 * F.least("a", "b") / (F.col("a") + F.col("b"))))
    return reports.scenario_checks(e, ["user_id"], "s", [2, 3, 4, 5], "a", "b", "m", "agreement")


def relocated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 7 == 0, "/../x").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", scalars.relocated_path(url, ROOTS, "/data/").alias("x")).select("page_id", "x.*")


QUERIES = {
    f.__name__: f
    for f in (beat_metrics, beat_projections, morphology_scores, sine_fits, band_integrals, step_profiles, order_ranks, cohort_table, sparse_curves, selected_results, rule_table, module_table, cell_differences, scenario_checks, relocated_paths)
}

SAMPLES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, round(value * 100) AS y, event_type FROM events)"
WINDOWS = f"""{SAMPLES}, w AS (SELECT * FROM (SELECT e.user_id, e.i AS event, s.i - e.i AS o, s.y, count(*) OVER (PARTITION BY e.user_id, e.i) AS n FROM s e JOIN s ON s.user_id = e.user_id AND s.i BETWEEN e.i - 2 AND e.i + 2 WHERE e.event_type = 'error') WHERE n = 5)"""
PARTS = ("required_all", "required_any", "required_region_any", "supportive", "supportive_region_any")
RULE_ROWS = ", ".join(str((name, *("; ".join(rule.get(p, [])) for p in PARTS))) for name, rule in RULES.items())
UNDER = " ".join(f"WHEN lower(u) = '{r.lower()}' OR starts_with(lower(u), '{r.lower()}/') THEN regexp_replace(substr(u, {len(r) + 1}), '^/+', '')" for r in (x.rstrip("/") for x in ROOTS))
ORACLES = {
    "beat_metrics": """WITH b AS (SELECT user_id, event_id / 150.0::DOUBLE AS t FROM events),
      i AS (SELECT user_id, t, t - lag(t) OVER w AS v, count(*) OVER (PARTITION BY user_id) AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      k AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS p, median(v) OVER w AS m, list(v) OVER w AS l FROM i WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
      d AS (SELECT *, list_aggregate(list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: abs(x - m)), 'median') * 1.4826::DOUBLE AS d FROM k),
      g AS (SELECT *, coalesce(n >= 3 AND v BETWEEN 0.3 AND 8 AND (p IS NULL OR abs(v - p) / greatest(p, 1e-9) <= 0.9) AND (d = 0 OR abs(v - m) <= 3 * d), false) AS good FROM d),
      r AS (SELECT *, good AND lag(good) OVER w AS pair, sum(CAST(NOT good AS INTEGER)) OVER w AS run FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      x AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, run, count(*) FILTER (good) AS c FROM r GROUP BY user_id, run) GROUP BY user_id)
      SELECT user_id, count(*) AS r_peaks, count(*) - 1 AS rr_total, count(*) FILTER (good) AS nn_valid, round(coalesce(count(*) FILTER (good) / nullif(CAST(count(*) - 1 AS DOUBLE), 0), 0), 6) AS nn_valid_fraction,
        round(60 / (avg(v) FILTER (good)), 6) AS mean_hr_bpm, round(sqrt(avg((v - p) * (v - p)) FILTER (pair)) * 1000, 6) AS rmssd_ms, round(coalesce(max(c) * median(v) FILTER (good), 0), 6) AS longest_contiguous_s,
        CASE WHEN max(c) * median(v) FILTER (good) >= 120 THEN 'estimable_candidate' ELSE 'ECG_SAMPEN_INESTIMABLE' END AS sampen_status FROM r JOIN x USING (user_id) GROUP BY user_id""",
    "beat_projections": f"""WITH {WINDOWS} SELECT user_id, CAST(event AS INTEGER) AS event, round(corr(t, y), 6) AS correlation, round(regr_slope(y, t), 4) AS factor, round(stddev_pop(y), 4) AS rms, round(stddev_pop(t), 6) AS template_rms
      FROM w JOIN (VALUES {", ".join(map(str, TEMPLATE.items()))}) z(o, t) USING (o) GROUP BY user_id, event HAVING stddev_pop(y) > 0""",
    "morphology_scores": f"""WITH {WINDOWS}, t AS (SELECT user_id, o, median(y) AS t FROM w GROUP BY user_id, o), c AS (SELECT user_id, event, CASE WHEN stddev_pop(y) > 0 AND stddev_pop(t) > 0 THEN greatest(corr(y, t), 0) END AS c FROM w JOIN t USING (user_id, o) GROUP BY user_id, event)
      SELECT user_id, count(*) AS n_windows, round(CASE WHEN count(*) >= 3 THEN coalesce(median(c), 0) ELSE 0 END, 6) AS score FROM c GROUP BY user_id""",
    "sine_fits": f"""WITH {SAMPLES}, z AS (SELECT user_id, sin(pi() / 10 * i / 2) AS a, cos(pi() / 10 * i / 2) AS b, y FROM s), q AS (SELECT user_id, sum(a * a) AS ss, sum(b * b) AS cc, sum(a * b) AS sc, sum(a * y) AS sx, sum(b * y) AS cx FROM z GROUP BY user_id),
      f AS (SELECT user_id, CASE WHEN ss * cc - sc * sc > 1e-9 * ss * cc THEN (cc * sx - sc * cx) / (ss * cc - sc * sc) END AS a, CASE WHEN ss * cc - sc * sc > 1e-9 * ss * cc THEN (ss * cx - sc * sx) / (ss * cc - sc * sc) END AS b FROM q)
      SELECT user_id, round(sqrt(a * a + b * b), 3) AS amplitude, round(atan2(b, a), 5) AS phase FROM f""",
    "band_integrals": f"""WITH {SAMPLES}, l AS (SELECT user_id, lag(i) OVER w / 4 AS f0, lag(y) OVER w AS p0, i / 4 AS f1, y AS p1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)), c AS (SELECT *, greatest(2.1::DOUBLE, f0) AS a, least(7.9::DOUBLE, f1) AS b FROM l)
      SELECT user_id, round(sum(CASE WHEN f0 IS NOT NULL AND a < b THEN p0 * (b - a) + 0.5::DOUBLE * (p1 - p0) / (f1 - f0) * ((b - f0) * (b - f0) - (a - f0) * (a - f0)) ELSE 0 END), 3) AS integral FROM c GROUP BY user_id""",
    "step_profiles": f"""WITH {SAMPLES}, d AS (SELECT user_id, floor(y / 5000) - lag(floor(y / 5000)) OVER (PARTITION BY user_id ORDER BY i) AS d FROM s), m AS (SELECT user_id, median(abs(d)) AS m, count(d) AS n, count(*) FILTER (d = 0) AS z FROM d GROUP BY user_id),
      u AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, round(d / greatest(m, 2.2250738585072014e-308::DOUBLE), 8) AS u, count(*) AS c FROM d JOIN m USING (user_id) WHERE d IS NOT NULL GROUP BY ALL) GROUP BY user_id)
      SELECT user_id, n AS n_steps, round(z / nullif(CAST(n AS DOUBLE), 0), 9) AS zero_share, round(coalesce(c / CAST(n AS DOUBLE), 1), 9) AS modal_share FROM m LEFT JOIN u USING (user_id)""",
    "order_ranks": """WITH z AS (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)), k AS (SELECT n, unnest(range(n + 1)) AS k FROM z),
      p AS (SELECT n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.025::DOUBLE) + (n - k) * ln(0.975::DOUBLE)) AS p FROM k),
      c AS (SELECT n, k, coalesce(sum(p) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, coalesce(sum(p) OVER (PARTITION BY n ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS above FROM p)
      SELECT n, CAST(max(k) FILTER (below <= 0.025) AS INTEGER) AS lower_rank, CAST(min(k + 1) FILTER (above <= 0.025) AS INTEGER) AS upper_rank FROM c GROUP BY n""",
    "cohort_table": with_panel(
        """SELECT CAST(place AS INTEGER) AS place, characteristic, participants_or_value, scores_or_predictions FROM t, LATERAL (VALUES
          (1, 'Unique analytic participants', CAST(n AS VARCHAR), ratings || ' ratings, minutes 1–20'), (2, 'Recorded E / T / neither stopping code', e || ' / ' || t || ' / ' || none, ''),
          (3, 'Complete minutes 1–10', CAST(ten AS VARCHAR), (ten * 10) || ' ratings'), (4, 'Complete minutes 1–20', CAST(twenty AS VARCHAR), (twenty * 20) || ' ratings'),
          (5, 'Next-rating objective', CAST(followed AS VARCHAR), pairs || ' eligible predictions'), (6, 'Minutes 1–5 to minute 10 objective', CAST(prefix AS VARCHAR), prefix || ' eligible predictions')) v(place, characteristic, participants_or_value, scores_or_predictions)""",
        "pp AS (SELECT *, status = 'observed' AS o, lead(status = 'observed') OVER (PARTITION BY subject_id ORDER BY time_min) AS after FROM panel)",
        "q AS (SELECT subject_id, count(*) FILTER (o) AS r, max(termination_code) AS code, count(*) FILTER (o AND time_min <= 10) AS r10, count(*) FILTER (o AND after) AS pr, count(*) FILTER (o AND (time_min <= 5 OR time_min = 10)) AS r6 FROM pp GROUP BY subject_id)",
        """t AS (SELECT count(*) AS n, CAST(sum(r) AS BIGINT) AS ratings, count(*) FILTER (code = 'E') AS e, count(*) FILTER (code = 'T') AS t, count(*) FILTER (code = '') AS none, count(*) FILTER (r10 = 10) AS ten, count(*) FILTER (r = 20) AS twenty,
          count(*) FILTER (pr > 0) AS followed, CAST(sum(pr) AS BIGINT) AS pairs, count(*) FILTER (r6 = 6) AS prefix FROM q)""",
    ),
    "sparse_curves": with_panel("SELECT subject_id, string_agg(CAST(time_min AS VARCHAR), ',' ORDER BY time_min) AS minutes, string_agg(CAST(CAST(vas AS BIGINT) AS VARCHAR), ',' ORDER BY time_min) AS scores, '' AS reason FROM panel WHERE status = 'observed' AND time_min <= 10 GROUP BY subject_id"),
    "selected_results": f"""WITH q AS (SELECT l_linenumber, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'SHIP' ELSE 'other' END AS model, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, count(*) AS repeats FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY ALL)
      SELECT q.*, place, CASE WHEN place IS NULL THEN 'unknown_model' WHEN repeats <> 2 THEN 'incomplete_repeats' ELSE '' END AS status FROM q LEFT JOIN (VALUES {", ".join(f"('{m}', {i}::INTEGER)" for i, m in enumerate(MODELS))}) m(model, place) USING (model)""",
    "rule_table": f"""WITH c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'hurry' WHEN 1 THEN 'open' ELSE 'other' END AS rule, count(*) FILTER (c_acctbal > 0) AS "count", count(*) AS denominator_people FROM customer GROUP BY 1)
      SELECT rule, {", ".join(PARTS)}, "count", denominator_people, round("count" / CAST(denominator_people AS DOUBLE), 9) AS proportion, CASE WHEN "count" IS NULL THEN 'no_counts' WHEN required_all IS NULL THEN 'no_definition' ELSE '' END AS status
      FROM (VALUES {RULE_ROWS}) r(rule, {", ".join(PARTS)}) FULL JOIN c USING (rule)""",
    "module_table": f"""WITH a AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS t, min(x) AS lo, max(x) AS hi FROM (SELECT *, CAST(CASE WHEN c_nationkey % 3 = 0 THEN floor(c_custkey % 17 / 12) ELSE 1 END * 1000 AS BIGINT) AS x FROM customer) GROUP BY ALL)
      SELECT n_nationkey, CAST(n_regionkey * 100 AS BIGINT) AS historical_planned_replicates, n_name AS historical_run_reference, {", ".join(f'max(lo) FILTER (t = {t!r} AND lo = hi) AS "{t}"' for t in TARGETS)},
        coalesce(string_agg(t, '; ' ORDER BY t) FILTER (lo <> hi AND t IN {tuple(TARGETS)}), '') AS disagreeing FROM nation LEFT JOIN a USING (n_nationkey) GROUP BY ALL""",
    "cell_differences": """WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), d AS (
        SELECT k, NULL AS cell, CASE WHEN k % 11 = 0 THEN 'absent' ELSE 'unexpected' END AS reason FROM f WHERE (k % 11 = 0) <> (k % 19 = 0)
        UNION ALL SELECT k, 'n', CASE WHEN k % 13 = 0 THEN 'defined_on_one_side' ELSE 'value' END FROM f WHERE k % 11 <> 0 AND k % 19 <> 0 AND (k % 13 = 0 OR k % 7 = 0)
        UNION ALL SELECT k, 'price', 'number' FROM f WHERE k % 11 <> 0 AND k % 19 <> 0 AND k % 17 = 0) SELECT k AS l_orderkey, cell, reason FROM d""",
    "scenario_checks": """WITH g AS (SELECT user_id, event_id % 5 + 2 AS s, event_id % 23 = 0 AS again, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY ALL),
      h AS (SELECT user_id, count(DISTINCT s) FILTER (s <= 5) AS k, count(*) AS n, count(DISTINCT s) AS ds, count(*) FILTER (s > 5) AS u, count(*) FILTER (m > least(a, b)) AS bm, count(*) FILTER (a + b > 0 AND abs(2.0::DOUBLE * (least(a, b) - m) / (a + b)) > 1e-12) AS ba FROM g GROUP BY user_id)
      SELECT user_id, 4 - k AS n_missing, n - ds AS n_repeated, u AS n_unknown, bm AS n_bad_matched, ba AS n_bad_agreement, k = 4 AND n = ds AND u = 0 AND bm = 0 AND ba = 0 AS valid FROM h""",
    "relocated_paths": rf"""WITH p AS (SELECT page_id, replace(url || CASE WHEN page_id % 7 = 0 THEN '/../x' ELSE '' END, '\', '/') AS u FROM pages), f AS (SELECT page_id, u, CASE {UNDER} END AS found FROM p)
      SELECT page_id, CASE WHEN list_contains(string_split(found, '/'), '..') THEN NULL WHEN found IS NOT NULL THEN regexp_replace('/data/' || found, '/$', '') ELSE u END AS path,
        CASE WHEN list_contains(string_split(found, '/'), '..') THEN 'parent_traversal' WHEN found IS NOT NULL THEN 'relocated' ELSE '' END AS reason FROM f""",
}
