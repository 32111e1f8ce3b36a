"""Queries of pairs, registries, intervals and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.operators import joins
from panelia.plans.common import table

BASELINES = ["signup", "view"]


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total hundredths by user, day and event type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def of_type(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"), "event_id")


def strict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.strict_pair(cents(spark, sf_dir), ["user_id", "day"], "event_type", "cents", BASELINES, "purchase")


def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unpaired(cents(spark, sf_dir), ["user_id", "day"], "event_type", BASELINES, "purchase")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cents(spark, sf_dir)
    a, b = (c.where(F.col("event_type") == k).drop("event_type") for k in ("click", "error"))
    return joins.compare_runs(a, b, ["user_id", "day"], ["cents"])


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    registry = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = orders.join(registry, "c_custkey", "left_semi")
    return joins.apply_registry(known, registry, "c_custkey", "c_mktsegment")


def unresolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lines.join(table(spark, sf_dir, "orders"), "o_orderkey", "left_anti").groupBy("o_orderkey").agg(F.count("*").alias("n"))


def first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_by_priority(cents(spark, sf_dir), ["user_id", "day"], "event_type", ["purchase", "click", "view"])


def resolve_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("priority"), F.col("l_suppkey").alias("identity"))
    return joins.resolve_claims(claims, "part", "priority", "identity")


def latest_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("path"))
    return joins.latest_unique(rows, ["o_custkey"], "o_orderdate", "path")


def earliest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.earliest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


def within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = of_type(spark, sf_dir, "click").withColumnRenamed("event_id", "a_id")
    b = of_type(spark, sf_dir, "view").withColumnRenamed("event_id", "b_id")
    return joins.within_tolerance(a, b, ["user_id"], "t", 3_600_000_000).select("user_id", "a_id", "b_id", (F.col("right_time") - F.col("left_time")).alias("gap"))


def supported_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = 3_600_000_000
    span = lambda k: of_type(spark, sf_dir, k).select("user_id", F.col("t").alias("start"), (F.col("t") + 6 * hour).alias("end"))
    times = of_type(spark, sf_dir, "click").select("user_id", F.col("t").alias("time"), "event_id")
    return joins.supported_times(times, span("view"), span("error"), ["user_id"], hour, 8 * hour).select("user_id", "event_id")


def unify_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("id"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    alias = c.where("c_custkey % 10 in (1, 2)").select(F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("alias"), F.concat(F.lit("P"), F.expr("c_custkey - c_custkey % 10").cast("string")).alias("canonical"))
    return joins.unify_people(rows, alias, ["c_mktsegment", "nation"], "smallest_numeric_id")


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 1).alias("canonical"))
    return joins.canonical_ids(n)


def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("d"))
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.unix_date(F.to_date("l_shipdate"))).alias("a"), F.max(F.unix_date(F.to_date("l_shipdate"))).alias("b"))
    return o.join(line, "o_orderkey").select("o_orderkey", joins.interval_gap(F.col("d"), F.col("a"), F.col("b")).alias("gap"))


QUERIES = {
    f.__name__: f
    for f in (strict_pairs, unpaired, compare_runs, registry_lookup, unresolved_keys, first_stage, resolve_claims, latest_unique, earliest_rows, within_tolerance, supported_times, unify_people, canonical_ids, interval_gaps)
}

CENTS = "WITH cents AS (SELECT user_id, CAST(extract(day FROM ts) AS INTEGER) AS day, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL)"

ORACLES = {
    "strict_pairs": f"""{CENTS} SELECT user_id, day, CASE WHEN s IS NOT NULL THEN 'signup' ELSE 'view' END AS baseline_stage, coalesce(s, v) AS baseline, p AS stimulus, p - coalesce(s, v) AS difference
      FROM (SELECT user_id, day, max(cents) FILTER (event_type = 'signup') AS s, max(cents) FILTER (event_type = 'view') AS v, max(cents) FILTER (event_type = 'purchase') AS p FROM cents GROUP BY user_id, day)
      WHERE p IS NOT NULL AND coalesce(s, v) IS NOT NULL""",
    "unpaired": f"""{CENTS} SELECT * FROM (SELECT user_id, day, CASE WHEN count(*) FILTER (event_type IN ('signup', 'view')) = 0 THEN 'no baseline' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'no stimulus' END AS reason
      FROM cents GROUP BY user_id, day) WHERE reason IS NOT NULL""",
    "compare_runs": f"""{CENTS} SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, CASE WHEN a.user_id IS NULL THEN 'second_only' WHEN b.user_id IS NULL THEN 'first_only' ELSE 'both' END AS side, abs(a.cents - b.cents) AS delta_cents
      FROM (SELECT * FROM cents WHERE event_type = 'click') a FULL JOIN (SELECT * FROM cents WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.day = b.day""",
    "registry_lookup": "SELECT c_custkey, o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "unresolved_keys": "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey",
    "first_stage": f"""{CENTS} SELECT user_id, day, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS event_type FROM cents WHERE event_type IN ('purchase', 'click', 'view') GROUP BY user_id, day""",
    "resolve_claims": """SELECT part, min(identity) AS identity, max(priority) AS priority FROM (SELECT l_partkey AS part, CAST(l_quantity AS BIGINT) AS priority, l_suppkey AS identity, max(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey) AS top FROM lineitem)
      WHERE priority = top GROUP BY part HAVING count(DISTINCT identity) = 1""",
    "latest_unique": """SELECT o_custkey, max(o_orderdate) AS o_orderdate, CASE WHEN count(DISTINCT o_orderkey) = 1 THEN CAST(min(o_orderkey) AS VARCHAR) END AS path
      FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_orderdate = top GROUP BY o_custkey""",
    "earliest_rows": "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderdate = first",
    "within_tolerance": """SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000""",
    "supported_times": """SELECT user_id, event_id FROM events c WHERE event_type = 'click'
      AND EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND epoch_us(c.ts) BETWEEN epoch_us(v.ts) - 3600000000 AND epoch_us(v.ts) + 7 * 3600000000)
      AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'error' AND v.user_id = c.user_id AND epoch_us(c.ts) BETWEEN epoch_us(v.ts) - 3600000000 AND epoch_us(v.ts) + 7 * 3600000000)""",
    "unify_people": """SELECT 'P' || p AS person, arg_min(c_mktsegment, c_custkey) AS c_mktsegment, arg_min(CAST(c_nationkey AS VARCHAR), c_custkey) AS nation, count(*) AS n_copies,
        concat_ws(',', CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'c_mktsegment' END, CASE WHEN count(DISTINCT c_nationkey) > 1 THEN 'nation' END) AS conflicts
      FROM (SELECT *, CASE WHEN c_custkey % 10 IN (1, 2) THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS p FROM customer) GROUP BY p""",
    "canonical_ids": "SELECT c_custkey AS alias, c_custkey - c_custkey % 8 AS canonical FROM customer WHERE c_custkey % 8 <> 0",
    "interval_gaps": """SELECT o_orderkey, CAST(greatest(0, a - d, d - b) AS INTEGER) AS gap FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders)
      JOIN (SELECT l_orderkey, min(CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS a, max(CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS b FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
}
