"""Queries of kernels: sequential and iterative operators, most of them without an SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.operators import clusters, kernels, prediction, resampling, statistics
from panelia.plans.common import panel, table


def trains(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("t"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def matched_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.match_trains(trains(spark, sf_dir, "click"), trains(spark, sf_dir, "view"), "user_id", "t", 7200.0)


def anchored_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.anchored_gaps(trains(spark, sf_dir, "click"), "user_id", "t", 60.0, 86_400.0, 0.25)


def edge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.edge_clusters(trains(spark, sf_dir, "click"), "user_id", "t", 21_600.0)


def welch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.welch_summary(records(spark, sf_dir), "vec_id", "samples", 16.0, 2.0, 1.0, 7.0)


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bootstrap_intervals(kernels.bootstrap_minutes(panel(spark, sf_dir), 20261003, "observation", 400), ["time_min"], "mean")


def poisson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.bootstrap_intervals(kernels.poisson_bootstrap(panel(spark, sf_dir), 7, 200), ["time_min"], "mean")


def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes by market segment over customer-years."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("block")).agg(F.sum("o_totalprice").alias("y"), F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return kernels.fixed_effects(o.join(c, "o_custkey"), "c_mktsegment", "o_custkey", "block", "y", ["n", "top"], replicates=199)


def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = statistics.lagged_features(panel(spark, sf_dir))
    return prediction.error_table(prediction.held_out_predictions(f, "subject_id", ["x1", "x2", "x3", "time_min"], "x3", folds=3, trees=10), "subject_id")


def endpoint_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.endpoint_precision(kernels.bootstrap_minutes(panel(spark, sf_dir), 20261003, "observation", 200), "time_min", "mean")


def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, grid = clusters.curves(panel(spark, sf_dir), 5), [1.0, 2.0, 3.0, 4.0, 5.0]
    return resampling.component_scores(c, "subject_id", "y", grid, resampling.curve_components(c, "y", grid, 2))


def cluster_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.stability(panel(spark, sf_dir), 4, "dtw_medoids", 2, 24, 5)


def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.large_kmeans(panel(spark, sf_dir), 4, 2, 5)


QUERIES = {f.__name__: f for f in (matched_trains, anchored_gaps, edge_clusters, welch_summary, bootstrap_intervals, poisson_intervals, fixed_effects, prediction_errors, cluster_stability, cluster_labels, endpoint_precision, component_scores)}
ORACLES = {
    "edge_clusters": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'click'),
      c AS (SELECT user_id, 0::BIGINT AS cluster, min(t) AS first FROM e GROUP BY user_id UNION ALL SELECT c.user_id, c.cluster + 1, min(e.t) FROM c JOIN e ON e.user_id = c.user_id AND e.t - c.first > 21600 GROUP BY c.user_id, c.cluster)
      SELECT e.user_id, cluster, first AS start, max(t) AS "end", count(*) AS n FROM e ASOF JOIN c ON e.user_id = c.user_id AND e.t >= c.first GROUP BY ALL""",
}
