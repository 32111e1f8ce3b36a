"""Access to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelia.sources.panel import EVENTS_PANEL_SQL, Scale, events_panel

SCALE = Scale(0.0, 20_000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(table(spark, sf_dir, "events"))


def with_panel(sql: str, *more: str) -> str:
    """SQL over the view ``panel``, with further common tables."""
    return "WITH " + ",\n".join([EVENTS_PANEL_SQL.strip(), *more]) + "\n" + sql
