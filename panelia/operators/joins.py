"""Pairs, registries, intervals and identities: equi-joins, with buckets where the condition is a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.sources.panel import ContractError
from panelia.sources.shared import written


def require_empty(bad: DataFrame, what: str) -> None:
    """An error with one example if there are rows."""
    row = bad.limit(1).collect()
    if row:
        raise ContractError(f"{what}: {row[0].asDict()}")


def strict_pair(rows: DataFrame, keys: list[str], stage: str, value: str, baselines: list[str], stimulus: str) -> DataFrame:
    """Per key the first available baseline stage beside the stimulus stage; keys without both are left out.

    One aggregation; ``unpaired`` lists what a strict reader rejects.
    """
    of = {s: F.max(F.when(F.col(stage) == s, F.col(value))) for s in [*baselines, stimulus]}
    wide = rows.groupBy(*keys).agg(*(c.alias(f"_{i}") for i, c in enumerate(of.values())))
    names = [f"_{i}" for i in range(len(baselines))]
    chosen = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(s)) for n, s in zip(names, baselines, strict=True)))
    base, top = F.coalesce(*map(F.col, names)), F.col(f"_{len(baselines)}")
    return wide.select(*keys, chosen.alias("baseline_stage"), base.alias("baseline"), top.alias("stimulus"), (top - base).alias("difference")).where("baseline is not null and stimulus is not null")


def unpaired(rows: DataFrame, keys: list[str], stage: str, baselines: list[str], stimulus: str) -> DataFrame:
    """Keys with a stage twice, without a baseline, or without the stimulus."""
    found = rows.groupBy(*keys).agg(
        F.max(F.when(F.col(stage).isin(*baselines), 1)).alias("b"), F.max(F.when(F.col(stage) == stimulus, 1)).alias("s"), F.count("*").alias("n"), F.count_distinct(stage).alias("d")
    )
    reason = F.when(F.col("n") > F.col("d"), "duplicate stage").when(F.col("b").isNull(), "no baseline").when(F.col("s").isNull(), "no stimulus")
    return found.select(*keys, reason.alias("reason")).where("reason is not null")


def compare_runs(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two runs by key: absolute differences, and which run lacks the key."""
    a = first.select(*keys, F.lit(True).alias("_a"), *(F.col(v).alias(f"a_{v}") for v in values))
    b = second.select(*keys, F.lit(True).alias("_b"), *(F.col(v).alias(f"b_{v}") for v in values))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_a").isNull(), "second_only").when(F.col("_b").isNull(), "first_only").otherwise("both")
    return both.select(*keys, side.alias("side"), *(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values))


def apply_registry(rows: DataFrame, registry: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows with their registry decision; a row without one, or a key with two owners, is an error."""
    require_empty(registry.groupBy(key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1"), "more than one owner")
    require_empty(rows.join(registry, key, "left_anti").select(key), "no decision")
    return rows.join(registry.dropDuplicates([key]), key)


def first_by_priority(rows: DataFrame, keys: list[str], stage: str, priority: list[str]) -> DataFrame:
    """The first stage of a priority list that each key has."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(stage))
    return rows.where(F.col(stage).isin(*priority)).groupBy(*keys).agg(F.min_by(stage, place).alias(stage))


def resolve_claims(claims: DataFrame, key: str, priority: str, identity: str) -> DataFrame:
    """The identity that the claims of the highest priority agree on; keys where they don't are left out."""
    top = claims.groupBy(key).agg(F.max(F.struct(priority, identity)).alias("hi"), F.max(F.struct(F.col(priority), -F.col(identity))).alias("lo"))
    return top.where(F.col("hi")[identity] == -F.col("lo")["col2"]).select(key, F.col("hi")[identity].alias(identity), F.col("hi")[priority].alias(priority))


def latest_unique(rows: DataFrame, keys: list[str], date: str, path: str) -> DataFrame:
    """The path of the latest date of each key; two paths on that date leave it undecided (NULL)."""
    last = Window.partitionBy(*keys)
    found = rows.withColumn("_d", F.max(date).over(last)).where(F.col(date) == F.col("_d"))
    return found.groupBy(*keys).agg(F.max(date).alias(date), F.when(F.min(path) == F.max(path), F.min(path)).alias(path))


def earliest(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """All rows of each key's earliest date."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(date))).where("_r = 1").drop("_r")


def interval_gap(t: Column, a: Column, b: Column) -> Column:
    """Distance from a time to an interval; 0 inside."""
    return F.greatest(F.lit(0), a - t, t - b)


def buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """All pairs of one key whose times differ by at most ``tolerance``: an equi-join on time buckets, then the exact test."""
    a = left.withColumn("_k", F.floor(F.col(time) / tolerance)).withColumnRenamed(time, "left_time")
    b = right.withColumnRenamed(time, "right_time").withColumn("_k", F.explode(F.array(*(F.floor(F.col("right_time") / tolerance) + i for i in (-1, 0, 1)))))
    joined = a.join(b, [*keys, "_k"]).where(F.abs(F.col("left_time") - F.col("right_time")) <= tolerance)
    return joined.drop("_k")


def supported_times(times: DataFrame, own: DataFrame, competing: DataFrame, keys: list[str], padding: float, width: float) -> DataFrame:
    """Times inside an own interval (widened by ``padding``) and inside no competing one; ranges meet by buckets."""

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_k", buckets(F.col("start") - padding, F.col("end") + padding, width)).withColumnRenamed("start", "_s").withColumnRenamed("end", "_e")

    asked = times.withColumn("_k", F.floor(F.col("time") / width))
    inside = (F.col("time") >= F.col("_s") - padding) & (F.col("time") <= F.col("_e") + padding)

    def semi(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = dealt(right).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_k").alias("_kk"), "_s", "_e")
        same = F.col("_k") == F.col("_kk")
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return left.join(r, same & inside, how)

    return semi(semi(asked, own, "left_semi"), competing, "left_anti").drop("_k")


def canonical_ids(aliases: DataFrame, source: str = "alias", target: str = "canonical") -> DataFrame:
    """(alias, canonical) with chains followed to their end, by pointer jumping; a cycle is an error.

    A round doubles the steps, so that a chain of n aliases ends after log2(n) + 1 rounds; what goes on is a cycle.
    """
    ends = written(aliases.select(F.col(source).alias("a"), F.col(target).alias("c")).distinct(), "aliases")
    require_empty(ends.groupBy("a").count().where("count > 1"), "an alias with two targets")
    for _ in range(ends.count().bit_length() + 1):
        nxt = ends.select(F.col("a").alias("n"), F.col("c").alias("d"))
        joined = ends.join(nxt, F.col("c") == F.col("n"), "left")
        if joined.where("d is not null").isEmpty():
            return ends.select(F.col("a").alias(source), F.col("c").alias(target))
        ends = written(joined.select("a", F.coalesce("d", "c").alias("c")), "aliases")
    raise ContractError("a cycle of aliases")


def numeric_suffix(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("bigint")


def unify_people(rows: DataFrame, aliases: DataFrame, fields: list[str], policy: str = "missing") -> DataFrame:
    """One row a person: fields on which the copies agree; others NULL, or from the smallest numeric id.

    ``rows`` has ``id``, ``aliases`` (alias, canonical); ``n_copies`` and ``conflicts`` say what happened.
    """
    if policy not in ("missing", "smallest_numeric_id"):
        raise ValueError(f"unknown policy {policy!r}")
    named = rows.join(aliases.withColumnRenamed("alias", "id"), "id", "left").withColumn("person", F.coalesce("canonical", "id"))
    order = F.struct(numeric_suffix(F.col("id")).isNull(), numeric_suffix(F.col("id")), F.col("id"))
    agree = {f: F.coalesce(F.min(f) == F.max(f), F.lit(True)) & (F.count(f).isin(0) | (F.count(f) == F.count("*"))) for f in fields}
    own = {f: F.min_by(f, order) for f in fields}
    out = named.groupBy("person").agg(*(agree[f].alias(f"_a_{f}") for f in fields), *(own[f].alias(f"_v_{f}") for f in fields), F.count("*").alias("n_copies"))
    value = lambda f: F.col(f"_v_{f}") if policy == "smallest_numeric_id" else F.when(F.col(f"_a_{f}"), F.col(f"_v_{f}"))
    conflicts = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"_a_{f}"), F.lit(f)) for f in fields))), ",")
    return out.select("person", *(value(f).alias(f) for f in fields), "n_copies", conflicts.alias("conflicts"))


def deidentify(tables: dict[str, DataFrame], columns: dict[str, list[str]], id_column: str, secret: str) -> dict[str, DataFrame]:
    """Tables cut to their allowed columns, one token a person across all of them.

    A token is a keyed hash of the id, so that tables agree without a lookup table.
    """
    if len(secret) < 16:
        raise ContractError("the secret needs 16 characters at least")
    token = F.substring(F.sha2(F.concat(F.lit(secret), F.lit(":"), F.col(id_column).cast("string")), 256), 1, 24)
    out = {}
    for name, frame in tables.items():
        missing = [c for c in columns[name] if c not in frame.columns]
        if missing:
            raise ContractError(f"{name}: no columns {missing}")
        out[name] = frame.withColumn("token", token).select("token", *(c for c in columns[name] if c != id_column))
    return out
