"""Sources of the rating panel: the strict wide-table contract, and an adapter from event tables.

The panel is long: subject_id, time_min, status, vas, termination_code (and raw_token when it is read from text).
A missing score is NULL and never zero; a marker is never a number; a gap is never filled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The status names and the missing tokens of the contract.
STATUSES = ("observed", "missing", "termination_E", "termination_T", "post_termination")
MISSING_TOKENS = ("", "NA", "N/A", "NAN")

PANEL = T.StructType(
    [
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("time_min", T.IntegerType(), False),
        T.StructField("vas", T.DoubleType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("raw_token", T.StringType(), False),
        T.StructField("termination_code", T.StringType(), False),
    ]
)
#: What Python's float() accepts as a finite decimal number, so that try_cast never sees suffixes or hex.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


class ContractError(ValueError):
    """The input cannot be interpreted."""


@dataclass(frozen=True)
class Scale:
    minimum: float
    maximum: float

    def __post_init__(self):
        if not self.minimum < self.maximum:
            raise ContractError("the scale needs a minimum below its maximum")


def finite_number(text: Column) -> Column:
    """A finite double, or NULL."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def wide_columns(names: list[str], pattern: str = r"^VAS_(\d+)min$") -> dict[str, int]:
    """The minute columns by name; duplicates and a table without any are errors."""
    if len(set(names)) != len(names):
        raise ContractError("duplicate columns")
    found = {n: int(m[1]) for n in names if (m := re.match(pattern, n))}
    if not found or len(set(found.values())) != len(found):
        raise ContractError("no minute columns, or one minute twice")
    return found


def classify_wide(wide: DataFrame, scale: Scale, id_column: str = "ID", pattern: str = r"^VAS_(\d+)min$") -> DataFrame:
    """Long rows with a column ``reject`` that says why a row can't be interpreted (else NULL)."""
    minutes = wide_columns(wide.columns, pattern)
    if id_column not in wide.columns:
        raise ContractError(f"no column {id_column}")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("time_min"), F.coalesce(F.col(f"`{n}`"), F.lit("")).alias("raw_token")) for n, m in minutes.items())))
    named = wide.select(F.trim(F.coalesce(F.col(id_column), F.lit(""))).alias("subject_id"), *(F.col(f"`{n}`") for n in minutes))
    rows = named.select("subject_id", cells.alias("c")).select("subject_id", "c.*")
    token = F.upper(F.trim("raw_token"))
    kind = F.when(token.isin("E", "T"), token).when(token.isin(*MISSING_TOKENS), "missing").otherwise("number")
    so_far = Window.partitionBy("subject_id").orderBy("time_min").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("subject_id")
    marked = rows.withColumn("kind", kind).withColumn("value", finite_number(F.col("raw_token")))
    marked = marked.withColumn("before", F.first(F.when(F.col("kind").isin("E", "T"), F.col("kind")), ignorenulls=True).over(so_far))
    reject = (
        F.when(F.col("subject_id") == "", "blank id")
        .when(F.count("*").over(whole) > len(minutes), "duplicate id")
        .when((F.col("kind") == "number") & F.col("value").isNull(), "unknown token")
        .when((F.col("kind") == "number") & ~F.col("value").between(scale.minimum, scale.maximum), "score outside the scale")
        .when((F.col("kind") == "number") & F.col("before").isNotNull(), "number after a marker")
        .when(F.col("kind").isin("E", "T") & (F.col("before") != F.col("kind")), "mixed markers")
    )
    status = (
        F.when(F.col("kind") == "number", "observed")
        .when(F.col("kind").isin("E", "T"), F.concat(F.lit("termination_"), F.col("kind")))
        .when(F.col("before").isNotNull(), "post_termination")
        .otherwise("missing")
    )
    code = F.coalesce(F.when(F.col("kind").isin("E", "T"), F.col("kind")), F.col("before"), F.lit(""))
    return marked.select("subject_id", "time_min", F.when(F.col("kind") == "number", F.col("value")).alias("vas"), status.alias("status"), "raw_token", code.alias("termination_code"), reject.alias("reject"))


def read_wide(spark: SparkSession, path: str, scale: Scale, id_column: str = "ID", pattern: str = r"^VAS_(\d+)min$") -> DataFrame:
    """The panel of a wide CSV file of text cells; every row that can't be interpreted is an error."""
    header = spark.read.option("header", False).csv(path).first()
    names = [str(x) for x in (header or [])]
    wide_columns(names, pattern)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wide = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    rows = classify_wide(wide, scale, id_column, pattern)
    bad = rows.where("reject is not null").limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0]['reject']}: subject {bad[0]['subject_id']!r}, minute {bad[0]['time_min']}")
    return rows.drop("reject")


def to_wide(panel: DataFrame, minutes: range = range(1, 21)) -> DataFrame:
    """One row a subject: ID and the minutes' tokens."""
    token = F.when(F.col("status") == "observed", F.col("vas").cast("string")).when(F.col("status").startswith("termination_"), F.col("termination_code")).otherwise("")
    wide = panel.groupBy(F.col("subject_id").alias("ID")).agg(*(F.max(F.when(F.col("time_min") == m, token)).alias(f"VAS_{m}min") for m in minutes))
    return wide


def events_panel(events: DataFrame, minutes: int = 20, t_above: int = 20_000, e_below: int = 100) -> DataFrame:
    """A panel from an event table: day of the month is the minute, the day's last value (in hundredths) the score.

    The first day above ``t_above`` is marker T, below ``e_below`` marker E; what follows is post_termination.
    Two shuffles: the day's last event (map-side combined), and at most ``minutes`` rows a subject.
    """
    # the key is cast first, so that what follows by subject needs no further shuffle
    keyed = events.select(F.col("user_id").cast("string").alias("subject_id"), F.dayofmonth("ts").alias("m"), F.round(F.col("value") * 100).cast("long").alias("c"), "ts", "event_id")
    last = keyed.where(F.col("m") <= minutes).groupBy("subject_id", "m").agg(F.max_by("c", F.struct("ts", "event_id")).alias("c"))
    by_minute = last.groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "c"))).alias("days"))
    marker = lambda c: (c > t_above) | (c < e_below)
    first = F.array_min(F.map_keys(F.map_filter("days", lambda m, c: marker(c))))
    spine = by_minute.select("subject_id", "days", first.alias("f"), F.explode(F.sequence(F.lit(1), F.lit(minutes))).alias("time_min"))
    c = F.try_element_at("days", F.col("time_min"))
    code = F.when(F.try_element_at("days", F.col("f")) > t_above, "T").otherwise("E")
    before = F.col("f").isNull() | (F.col("time_min") < F.col("f"))
    status = (
        F.when(F.col("time_min") > F.col("f"), "post_termination")
        .when(F.col("time_min") == F.col("f"), F.concat(F.lit("termination_"), code))
        .when(c.isNull(), "missing")
        .otherwise("observed")
    )
    return spine.select("subject_id", "time_min", F.when(before, c.cast("double")).alias("vas"), status.alias("status"), F.when(before, F.lit("")).otherwise(code).alias("termination_code"))


EVENTS_PANEL_SQL = """
days AS (
  SELECT user_id, CAST(extract(day FROM ts) AS INTEGER) AS m, CAST(round(value * 100) AS BIGINT) AS c,
         row_number() OVER (PARTITION BY user_id, extract(day FROM ts) ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE extract(day FROM ts) <= 20),
last_day AS (SELECT user_id, m, c FROM days WHERE rn = 1),
spine AS (SELECT user_id, CAST(t.m AS INTEGER) AS m FROM (SELECT DISTINCT user_id FROM last_day), (SELECT unnest(range(1, 21)) AS m) t),
marker AS (SELECT user_id, min(m) AS f, arg_min(c, m) AS fc FROM last_day WHERE c > 20000 OR c < 100 GROUP BY user_id),
panel AS (
  SELECT CAST(s.user_id AS VARCHAR) AS subject_id, s.m AS time_min,
    CASE WHEN k.f IS NULL OR s.m < k.f THEN CAST(l.c AS DOUBLE) END AS vas,
    CASE WHEN s.m > k.f THEN 'post_termination'
         WHEN s.m = k.f THEN 'termination_' || CASE WHEN k.fc > 20000 THEN 'T' ELSE 'E' END
         WHEN l.c IS NULL THEN 'missing' ELSE 'observed' END AS status,
    CASE WHEN k.f IS NULL OR s.m < k.f THEN '' WHEN k.fc > 20000 THEN 'T' ELSE 'E' END AS termination_code
  FROM spine s LEFT JOIN last_day l ON l.user_id = s.user_id AND l.m = s.m LEFT JOIN marker k ON k.user_id = s.user_id)
"""
