"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.functions import scalars
from panelia.plans.common import table

RULES = {
    "hurry": {"required_all": ["1-URGENT"], "required_any": ["O", "F"], "supportive": ["P"]},
    "open": {"required_any": ["O", "P"], "required_region_any": ["1"], "supportive_region_any": ["2"]},
    "low": {"required_any": ["5-LOW"], "supportive": ["F"], "supportive_region_any": ["3", "4"]},
}


def parsed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", scalars.clean_code(F.col("url")).alias("code"), scalars.path_key(F.col("url")).alias("key"), scalars.file_extension(F.concat("url", F.lit(".HTM"))).alias("extension"))


def clock_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    label = F.concat_ws(":", F.date_format("ts", "HH"), F.date_format("ts", "mm"), (F.col("event_id") % 75).cast("string"))
    return e.select("event_id", scalars.hms_seconds(label).alias("seconds"), scalars.filename_time(F.concat(F.lit("rec_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".txt"))).alias("stamp"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(scalars.split_tokens(F.concat_ws("; ", "p_name", "p_brand", "p_type", "p_name")), ",").alias("tokens"), F.levenshtein("p_name", "p_type").alias("distance"))


def rating_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 7 == 0, "e ").when(F.col("event_id") % 7 == 1, " T").when(F.col("event_id") % 7 == 2, "n/a").when(F.col("event_id") % 7 == 3, "1_0").otherwise(F.concat(F.lit(" "), (F.col("event_id") % 11).cast("string"), F.lit(".0")))
    return e.select("event_id", scalars.rating_token(raw).alias("token"))


def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    w = scalars.wilson(F.col("k"), F.col("n"))
    return n.select("o_orderpriority", "k", "n", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"), F.round(scalars.zero_event_bound(F.col("n")), 9).alias("bound"))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules scored for each customer's set of order traits and its region."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_union(F.collect_set("o_orderstatus"), F.collect_set("o_orderpriority")).alias("symptoms"))
    regions = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array(F.col("n_regionkey").cast("string")).alias("regions"))
    both = orders.join(regions, F.col("o_custkey") == F.col("c_custkey"))
    ranked = scalars.rule_ranking(F.col("symptoms"), F.col("regions"), RULES)
    return both.select("c_custkey", F.array_join(F.transform(ranked, lambda x: F.concat(x["name"], F.lit("="), x["score"].cast("int").cast("string"))), ";").alias("ranking"))


QUERIES = {f.__name__: f for f in (parsed_urls, clock_labels, token_lists, rating_tokens, wilson_intervals, rule_scores)}

Z = "1.959963984540054::DOUBLE"
ORACLES = {
    "parsed_urls": r"""SELECT page_id, nullif(regexp_replace(regexp_extract(url, '(\d+)', 1), '^0+([0-9])', '\1'), '') AS code, lower(regexp_replace(replace(url, '\', '/'), '/+$', '')) AS key, '.htm' AS extension FROM pages""",
    "clock_labels": """SELECT event_id, CASE WHEN event_id % 75 < 60 THEN CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + event_id % 75 AS DOUBLE) END AS seconds, date_trunc('second', ts) AS stamp FROM events""",
    "token_lists": r"""SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(p_name || '; ' || p_brand || '; ' || p_type || '; ' || p_name), '[;\s]+'), lambda x: x <> ''))), 'string_agg', ',') AS tokens, levenshtein(p_name, p_type) AS distance FROM part""",
    "rating_tokens": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'E' WHEN 1 THEN 'T' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE CAST(event_id % 11 AS VARCHAR) END AS token FROM events",
    "wilson_intervals": f"""SELECT o_orderpriority, k, n, round((p + {Z} * {Z} / (2 * n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4.0::DOUBLE * n * n))) / (1 + {Z} * {Z} / n), 9) AS low,
        round((p + {Z} * {Z} / (2 * n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4.0::DOUBLE * n * n))) / (1 + {Z} * {Z} / n), 9) AS high, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / n), 9) AS bound
      FROM (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY o_orderpriority)""",
    "rule_scores": """WITH traits AS (SELECT o_custkey AS c, bool_or(o_orderpriority = '1-URGENT') AS u, bool_or(o_orderpriority = '5-LOW') AS l, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey),
      pts AS (SELECT c_custkey, CASE WHEN u AND (o OR f) THEN 2 + 2 * (CAST(o AS INTEGER) + CAST(f AS INTEGER)) + CAST(p AS INTEGER) ELSE 0 END AS a,
          CASE WHEN (o OR p) AND n_regionkey = 1 THEN 2 * (CAST(o AS INTEGER) + CAST(p AS INTEGER)) + 2 ELSE 0 END AS b, CASE WHEN l THEN 2 + CAST(f AS INTEGER) + CAST(n_regionkey IN (3, 4) AS INTEGER) ELSE 0 END AS d
        FROM traits JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey),
      long AS (SELECT c_custkey, 0 AS i, 'hurry' AS name, a AS s FROM pts UNION ALL SELECT c_custkey, 1, 'open', b FROM pts UNION ALL SELECT c_custkey, 2, 'low', d FROM pts)
      SELECT c_custkey, coalesce(string_agg(name || '=' || s, ';' ORDER BY s DESC, i) FILTER (s > 0), '') AS ranking FROM long GROUP BY c_custkey""",
}
