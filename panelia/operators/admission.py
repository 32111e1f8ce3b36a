"""Rules that admit rows, or say why not; reasons are columns, so that no row is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.functions.scalars import finite


def all_reasons(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def first_reason(conditions: dict[str, Column]) -> Column:
    """The first condition that holds; NULL: admitted."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in conditions.items()), F.lit(None))


def admitted(frame: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``frame`` with its reason and whether it is admitted."""
    return frame.withColumn("reason", first_reason(conditions)).withColumn("admitted", F.col("reason").isNull())


def flag_status(flag: str) -> Column:
    """What a group's yes, no and unknown flags come to (an aggregate)."""
    return F.when(F.count_if(F.col(flag).isNull()) > 0, "unknown").when(F.bool_and(flag), "all").when(F.bool_or(flag), "mixed").otherwise("none")


def complete_scores(wide: DataFrame, columns: list[str], low: float, high: float) -> Column:
    """Whether every cell is a number in range."""
    return F.forall(F.array(*(finite(F.col(c)) for c in columns)), lambda x: x.isNotNull() & x.between(low, high))


def baseline_rows(source: DataFrame, id_column: str = "ID", flag: str = "recent", hours: str = "hours") -> DataFrame:
    """Conditional coding of recent intake: hours count only where there was some, and lie in (0, 24].

    ``reject`` names what can't be interpreted.
    """
    f, h = finite(F.col(flag)), finite(F.col(hours))
    blank = F.trim(F.coalesce(F.col(hours), F.lit(""))).isin("", "NA", "N/A")
    status = F.when(f == 0, F.when(blank, "not_applicable").otherwise("conflict")).when(f == 1, F.when(blank, "missing").when((h > 0) & (h <= 24), "observed").otherwise("out_of_range")).otherwise("unknown_flag")
    every = Window.partitionBy(id_column)
    rows = source.withColumn("status", status).withColumn("hours_value", F.when(status == "observed", h)).withColumn("_n", F.count("*").over(every))
    return rows.withColumn("reject", first_reason({"duplicate id": F.col("_n") > 1, "blank id": F.trim(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) == "", "uninterpretable": F.col("status").isin("conflict", "out_of_range", "unknown_flag")})).drop("_n")


def presence(rows: DataFrame, keys: list[str], kind: str, values: list[str]) -> DataFrame:
    """Which kinds each key has, as one column a kind."""
    return rows.groupBy(*keys).agg(*(F.bool_or(F.col(kind) == v).alias(f"has_{v}") for v in values))
