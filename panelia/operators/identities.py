"""Logs, mappings and contracts that decide whose a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelia.functions.scalars import finite


def log_intervals(rows: DataFrame, key: str, start: str, elapsed: list[str]) -> DataFrame:
    """(key, start, stop) of logs with one start and an elapsed time; elapsed columns hold seconds as text."""
    seconds = F.greatest(*(F.when(x >= 0, x) for x in (finite(F.col(c)) for c in elapsed))) if len(elapsed) > 1 else F.when(finite(F.col(elapsed[0])) >= 0, finite(F.col(elapsed[0])))
    found = rows.groupBy(key).agg(F.min(F.nullif(F.col(start), F.lit(""))).alias("_a"), F.max(F.nullif(F.col(start), F.lit(""))).alias("_b"), F.max(seconds).alias("_s"))
    begin = F.try_to_timestamp(F.substring_index("_a", " +", 1), F.lit("yyyy-MM-dd HH'h'mm.ss.SSSSSS"))
    return found.where("_a = _b and _s is not null").select(key, begin.alias("start"), F.timestamp_add("MICROSECOND", F.round(F.col("_s") * 1_000_000).cast("long"), begin).alias("stop")).where("start is not null")


def unphased_aliases(files: DataFrame, key: list[str], label: str, stage: str, needs_anchor: Column, aliases: DataFrame) -> DataFrame:
    """``files`` with ``unphased``: label and stage together are a known alias, and the other stage of the pair is missing."""
    stages = F.collect_set(stage).over(Window.partitionBy(*key, label))
    paired = F.array_contains(stages, "E") & F.arrays_overlap(stages, F.array(F.lit("N"), F.lit("C")))
    known = aliases.select(F.col(aliases.columns[0]).alias("_alias")).distinct()
    joined = files.withColumn("_pair", paired).join(known, F.concat(label, stage) == F.col("_alias"), "left")
    return joined.withColumn("unphased", F.coalesce(needs_anchor, F.lit(False)) & F.col("_alias").isNotNull() & ~F.col("_pair")).drop("_pair", "_alias")


def added_mappings(rows: DataFrame, more: DataFrame, key: list[Column], names: list[str]) -> DataFrame:
    """``rows`` and those of ``more`` whose key is new; of equal new keys, the first by ``names``."""
    marks = [f"_k{i}" for i in range(len(key))]
    keyed = lambda f: f.withColumns(dict(zip(marks, key, strict=True)))
    new = keyed(more).join(keyed(rows).select(*marks).distinct(), marks, "left_anti")
    first = F.row_number().over(Window.partitionBy(*marks).orderBy(*names))
    return rows.unionByName(new.withColumn("_n", first).where("_n = 1").select(*rows.columns))


def contract_errors(rows: DataFrame, order: str, subject: str, required: list[str], independent: Column) -> DataFrame:
    """(order, errors): required fields that are empty, subjects that came before, references that are not independent."""
    again = F.row_number().over(Window.partitionBy(subject).orderBy(order)) > 1
    found = F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"{c}_missing") for c in required), F.when(F.col(subject).isNotNull() & again, "duplicate_subject"), F.when(~F.coalesce(independent, F.lit(False)), "reference_not_independent"))
    return rows.select(order, F.array_compact(found).alias("errors"))


def contract_status(errors: DataFrame) -> DataFrame:
    """One row: the contract's status, its rows and errors."""
    out = errors.agg(F.count("*").alias("subjects"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n_errors"))
    status = F.when((F.col("subjects") > 0) & (F.col("n_errors") == 0), "contract_documented_needs_target_review").otherwise("pending_independent_clinical_reference")
    return out.select(status.alias("status"), "subjects", "n_errors")


def pending_zeros(panel: DataFrame, audit: DataFrame) -> DataFrame:
    """(subject_id, time_min, old_first_E_min, new_first_E_min): the two zeros right before a first E that the audit names."""
    chosen = audit.where("E_recorded_support = 'two_preceding_recorded_zeros' and first_marker_min >= 3").select("subject_id", F.col("first_marker_min").alias("f"))
    rows = panel.join(chosen, "subject_id").where("time_min between f - 2 and f - 1 and vas = 0")
    return rows.select("subject_id", "time_min", F.col("f").alias("old_first_E_min"), (F.col("f") - 2).alias("new_first_E_min"))


def group_sizes(sizes: DataFrame, cell: list[str], group: str, size: str) -> DataFrame:
    """By cell: people, groups, and the groups' sizes in order as text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(group, size))), lambda x: x[size].cast("string"))
    return sizes.groupBy(*cell).agg(F.count("*").alias("k"), F.sum(size).alias("n_people"), F.array_join(listed, " / ").alias("group_sizes"))
