"""Queries of admission rules and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.functions import names
from panelia.operators import admission, resampling, waveforms
from panelia.plans.common import table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth-rounded long waveform for each user: events in order."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.round(F.col("value")).alias("x"))


def admitted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rules = {"pending": F.col("o_orderstatus") == "P", "low priority": F.col("o_orderpriority").startswith("5"), "small": F.col("o_totalprice") < 1000}
    return admission.admitted(o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), rules).select("o_orderkey", "reason", "admitted", F.array_join(admission.all_reasons(rules), ",").alias("reasons"))


def flag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("f", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return o.groupBy("o_custkey").agg(admission.flag_status("f").alias("state"))


def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = e.select(F.col("event_id").alias("ID"), (F.col("event_id") % 3).cast("string").alias("recent"), F.when(F.col("event_id") % 4 == 0, F.lit("NA")).otherwise((F.col("event_id") % 30).cast("string")).alias("hours"))
    return admission.baseline_rows(source).select("ID", "status", "hours_value", "reject")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.presence(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["click", "error"])


def waveform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveforms.describe(samples(spark, sf_dir), "user_id", "event_id", "x")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 1.0).alias("t"), (F.col("event_id") % 2).alias("before"), ((F.col("event_id") + 1) % 2).alias("after"))
    return waveforms.pulses(e, "user_id", "event_id", "t", "before", "after")


def decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("record"), F.floor(F.col("event_id") / 5).alias("i"), "value")
    exported = raw.where("i % 4 = 1 and record < 4").select("record", ((F.col("i") - 1) / 4).cast("long").alias("i"), "value")
    return waveforms.decimation_agreement(raw, exported, "record", "i", "value", 4, 1, 0.0)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("t"), F.round("value").alias("x"))
    return waveforms.epochs(e, "user_id", "t", "x", 2000.0, 1000.0).select("user_id", "epoch", "n", "median", "iqr")


def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_0"), F.col("o_custkey").cast("string"), F.lit("_Ab_"), F.lower("o_orderstatus"), F.when(F.col("o_orderkey") % 3 > 0, ".csv").otherwise(""))
    r = names.recording_name(name)
    return o.select("o_orderkey", r["date"].cast("string").alias("date"), r["code"].alias("code"), r["label"].alias("label"), r["stage"].alias("stage"))


def observed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 > 0, F.round(F.col("value") * 100).cast("long")).alias("v"))
    return resampling.observed_intervals(e, "user_id", "event_id", "v")


def job_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.job_roster(spark, ["a", "b", "c"], 1050, 100)


QUERIES = {f.__name__: f for f in (admitted_orders, flag_states, baseline_rows, presence, waveform_summary, pulses, decimation, epochs, recording_names, observed_intervals, job_roster)}
ORACLES = {
    "admitted_orders": """SELECT o_orderkey, reason, reason IS NULL AS admitted, concat_ws(',', a, b, c) AS reasons FROM (SELECT o_orderkey, a, b, c, coalesce(a, b, c) AS reason FROM (
      SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS a, CASE WHEN o_orderpriority LIKE '5%' THEN 'low priority' END AS b, CASE WHEN o_totalprice < 1000 THEN 'small' END AS c FROM orders))""",
    "flag_states": "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'unknown' WHEN bool_and(o_orderstatus = 'F') THEN 'all' WHEN bool_or(o_orderstatus = 'F') THEN 'mixed' ELSE 'none' END AS state FROM orders GROUP BY o_custkey",
    "baseline_rows": """SELECT ID, status, CASE WHEN status = 'observed' THEN CAST(h AS DOUBLE) END AS hours_value, CASE WHEN status IN ('conflict', 'out_of_range', 'unknown_flag') THEN 'uninterpretable' END AS reject
      FROM (SELECT *, CASE f WHEN 0 THEN CASE WHEN h IS NULL THEN 'not_applicable' ELSE 'conflict' END WHEN 1 THEN CASE WHEN h IS NULL THEN 'missing' WHEN h > 0 AND h <= 24 THEN 'observed' ELSE 'out_of_range' END ELSE 'unknown_flag' END AS status
        FROM (SELECT event_id AS ID, event_id % 3 AS f, CASE WHEN event_id % 4 <> 0 THEN event_id % 30 END AS h FROM events))""",
    "presence": "SELECT user_id, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'error') AS has_error FROM events GROUP BY user_id",
    "waveform_summary": """WITH r AS (SELECT user_id, event_id, round(value) AS x, coalesce(round(value) = lag(round(value)) OVER (PARTITION BY user_id ORDER BY event_id), false) AS same FROM events),
      g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r), l AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM g GROUP BY user_id, run) GROUP BY user_id)
      SELECT user_id, count(*) AS n, 0 AS n_nonfinite, min(x) AS low, max(x) AS high, sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) / (count(*) * count(*))) AS sd, count(*) FILTER (x = 0) / CAST(count(*) AS DOUBLE) AS zero_fraction, max(longest) AS longest_constant FROM r JOIN l USING (user_id) GROUP BY user_id""",
    "pulses": """SELECT user_id, CAST(event_id AS DOUBLE) AS start, CAST(nxt AS DOUBLE) AS stop, CAST(nxt - event_id AS DOUBLE) AS duration, 0 AS low, 1 AS high FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE event_id % 2 = 0 AND nxt % 2 = 1""",
    "decimation": """WITH raw AS (SELECT event_id % 5 AS record, event_id // 5 AS i FROM events WHERE (event_id // 5) % 4 = 1)
      SELECT record, count(*) AS n, CASE WHEN record = 4 THEN count(*) ELSE 0 END AS n_unmatched, CASE WHEN record < 4 THEN 0.0::DOUBLE END AS max_difference, record < 4 AS agrees FROM raw GROUP BY record""",
    "epochs": """WITH e AS (SELECT user_id, event_id AS t, round(value) AS x FROM events WHERE event_type = 'view'), k AS (SELECT user_id, x, unnest(range(greatest(0, CAST(floor((t - 2000) / 1000.0) AS BIGINT) + 1), t // 1000 + 1)) AS epoch FROM e)
      SELECT user_id, epoch, count(*) AS n, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM k GROUP BY user_id, epoch""",
    "recording_names": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS code, CASE WHEN o_orderkey % 3 > 0 THEN 'ab' END AS label, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS stage FROM orders""",
    "observed_intervals": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS row, CASE WHEN event_id % 3 > 0 THEN CAST(round(value * 100) AS BIGINT) END AS v FROM events),
      k AS (SELECT user_id, row, lag(row) OVER w AS previous_row, v - lag(v) OVER w AS interval FROM r WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY row))
      SELECT *, row - previous_row - 1 AS skipped FROM k WHERE previous_row IS NOT NULL""",
    "job_roster": "SELECT CAST(c.i * 11 + b.s // 100 AS INTEGER) AS job, c.cell, CAST(b.s AS INTEGER) AS start, CAST(least(b.s + 100, 1050) AS INTEGER) AS stop FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) c(i, cell), (SELECT unnest(range(0, 1050, 100)) AS s) b",
}
