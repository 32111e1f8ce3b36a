"""Tables for publication, and checks of one table against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cohort_table(panel: DataFrame) -> DataFrame:
    """(place, characteristic, participants_or_value, scores_or_predictions) of a panel of minutes 1 to 20."""
    seen = F.when(F.col("status") == "observed", F.col("time_min"))
    people = panel.groupBy("subject_id").agg(F.collect_set(seen).alias("m"), F.max("termination_code").alias("code"))
    within = lambda last: F.size(F.filter("m", lambda x: x <= last))
    pairs = F.size(F.filter("m", lambda x: F.array_contains("m", x + 1)))
    prefix = (within(5) == 5) & F.array_contains("m", 10)
    t = people.agg(
        F.count("*").alias("n"), F.sum(F.size("m")).alias("ratings"), F.count_if(F.col("code") == "E").alias("e"), F.count_if(F.col("code") == "T").alias("t"), F.count_if(F.coalesce("code", F.lit("")) == "").alias("none"),
        F.count_if(within(10) == 10).alias("ten"), F.count_if(within(20) == 20).alias("twenty"), F.count_if(pairs > 0).alias("followed"), F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"), F.count_if(prefix).alias("prefix"),
    )
    # fixed values: the published table's labels
    lines = [
        ("Unique analytic participants", "{n}", "{ratings} ratings, minutes 1–20"),
        ("Recorded E / T / neither stopping code", "{e} / {t} / {none}", ""),
        ("Complete minutes 1–10", "{ten}", "{ten0} ratings"),
        ("Complete minutes 1–20", "{twenty}", "{twenty0} ratings"),
        ("Next-rating objective", "{followed}", "{pairs} eligible predictions"),
        ("Minutes 1–5 to minute 10 objective", "{prefix}", "{prefix} eligible predictions"),
    ]
    t = t.withColumns({"ratings": F.coalesce("ratings", F.lit(0)), "ten0": F.col("ten") * 10, "twenty0": F.col("twenty") * 20})

    def filled(text: str) -> F.Column:
        for name in t.columns:
            text = text.replace("{" + name + "}", f"\0{name}\0")
        parts = text.split("\0")
        return F.concat(*(F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))

    rows = [F.struct(F.lit(i).alias("place"), F.lit(a).alias("characteristic"), filled(b).alias("participants_or_value"), filled(c).alias("scores_or_predictions")) for i, (a, b, c) in enumerate(lines, 1)]
    return t.select(F.inline(F.array(*rows)))


def selected_results(results: DataFrame, where: dict[str, object], keys: list[str], model: str, order: list[str], repeats: str, complete: int, values: list[str]) -> DataFrame:
    """One cell's rows with their models' places, and a status: whether a row is complete and alone under its key.

    Models outside ``order`` have no place and the status unknown_model.
    """
    rows = results
    for name, value in where.items():
        rows = rows.where(F.col(name) == value)
    place = F.create_map(*(F.lit(x) for pair in enumerate(order) for x in pair[::-1]))[F.col(model)]
    by_key = rows.groupBy(*keys, model).agg(F.count("*").alias("_n"), F.min(repeats).alias(repeats), *(F.min(v).alias(v) for v in values))
    status = F.when(place.isNull(), "unknown_model").when(F.col("_n") > 1, "repeated_key").when(F.coalesce(F.col(repeats) != complete, F.lit(True)), "incomplete_repeats").otherwise("")
    return by_key.select(*keys, model, place.alias("place"), repeats, *values, status.alias("status"))


def rule_table(spark: SparkSession, rules: dict[str, dict[str, list[str]]], counts: DataFrame, code: str, count: str, people: str) -> DataFrame:
    """Every rule's parts beside its count; a rule without counts or counts without a rule get a status."""
    parts = ("required_all", "required_any", "required_region_any", "supportive", "supportive_region_any")
    rows = [F.struct(F.lit(name).alias("rule"), *(F.lit("; ".join(rule.get(p, []))).alias(p) for p in parts)) for name, rule in rules.items()]
    defined = spark.range(1).select(F.inline(F.array(*rows)))
    both = defined.join(counts.select(F.col(code).alias("rule"), F.col(count).alias("count"), F.col(people).alias("denominator_people")).withColumn("_c", F.lit(True)), "rule", "full_outer")
    status = F.when(F.col("_c").isNull(), "no_counts").when(F.col(parts[0]).isNull(), "no_definition").otherwise("")
    return both.select("rule", *parts, "count", "denominator_people", F.try_divide(F.col("count").cast("double"), "denominator_people").alias("proportion"), status.alias("status"))


def module_table(modules: DataFrame, module: str, planned: str, run: str, attempts: DataFrame, target: str, attempted: str, targets: list[str]) -> DataFrame:
    """Modules with their planned replicates as history, and by target the replicates that all sources name alike.

    Sources that disagree leave the cell empty and name it in ``disagreeing``.
    """
    one = attempts.groupBy(module).agg(*(e for t in targets for e in (F.min(F.when(F.col(target) == t, F.col(attempted))).alias(f"_lo_{t}"), F.max(F.when(F.col(target) == t, F.col(attempted))).alias(f"_hi_{t}"))))
    rows = modules.withColumnsRenamed({planned: "historical_planned_replicates", run: "historical_run_reference"}).join(one, module, "left")
    kept = [c for c in rows.columns if not c.startswith(("_lo_", "_hi_"))]
    same = {t: F.col(f"_lo_{t}") == F.col(f"_hi_{t}") for t in targets}
    apart = F.array_join(F.array_compact(F.array(*(F.when(~s, t) for t, s in same.items()))), "; ")
    return rows.select(*kept, *(F.when(s, F.col(f"_lo_{t}")).alias(t) for t, s in same.items()), apart.alias("disagreeing"))


def cell_differences(actual: DataFrame, expected: DataFrame, keys: list[str], relative: float = 1e-12, absolute: float = 1e-12) -> DataFrame:
    """(keys, cell, actual, expected, reason) of the expected table's cells that differ; numbers within the tolerance are equal.

    NULL equals NULL only. A row on one side only is one difference, with the cell NULL. Keys must not be NULL or repeat.
    """
    cells = [c for c in expected.columns if c not in keys]
    numbers = {f.name for f in expected.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    a = actual.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in cells), F.lit(True).alias("_a"))
    both = a.join(expected.withColumn("_e", F.lit(True)), keys, "full_outer")
    found = []
    for c in cells:
        x, y = F.col(f"_a_{c}"), F.col(c)
        near = F.abs(x - y) <= absolute + relative * F.abs(y) if c in numbers else x == y
        reason = F.when(x.isNull() != y.isNull(), "defined_on_one_side").when(x.isNotNull() & ~near, "number" if c in numbers else "value")
        found.append(F.when(reason.isNotNull(), F.struct(F.lit(c).alias("cell"), x.cast("string").alias("actual"), y.cast("string").alias("expected"), reason.alias("reason"))))
    side = F.when(F.col("_a").isNull(), "absent").when(F.col("_e").isNull(), "unexpected")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("cell"), F.lit(None).cast("string").alias("actual"), F.lit(None).cast("string").alias("expected"), side.alias("reason")))
    return both.select(*keys, F.inline(F.when(side.isNotNull(), whole).otherwise(F.array_compact(F.array(*found)))))


def scenario_checks(rows: DataFrame, keys: list[str], scenario: str, scenarios: list[int], first: str, second: str, matched: str, agreement: str, tolerance: float = 1e-12) -> DataFrame:
    """By key: scenarios missing, rows beyond one a scenario, matches beyond either count, and agreements that aren't 2m / (a + b)."""
    a, b, m = F.col(first), F.col(second), F.col(matched)
    due = F.try_divide((2 * m).cast("double"), a + b)
    wrong = F.when(due.isNull(), F.col(agreement).isNotNull()).otherwise(F.coalesce(F.abs(F.col(agreement) - due) > tolerance, F.lit(True)))
    known = F.col(scenario).isin(scenarios)
    out = rows.groupBy(*keys).agg(
        (F.lit(len(scenarios)) - F.count_distinct(F.when(known, F.col(scenario)))).alias("n_missing"), (F.count("*") - F.count_distinct(scenario)).alias("n_repeated"), F.count_if(F.coalesce(~known, F.lit(True))).alias("n_unknown"),
        F.count_if(F.coalesce((m < 0) | (m > F.least(a, b)), F.lit(True))).alias("n_bad_matched"), F.count_if(wrong).alias("n_bad_agreement"),
    )
    return out.withColumn("valid", sum(F.col(c) for c in ("n_missing", "n_repeated", "n_unknown", "n_bad_matched", "n_bad_agreement")) == 0)


def sparse_curves(panel: DataFrame, first: int, last: int) -> DataFrame:
    """(subject_id, minutes, scores, reason): each person's observed scores of an interval as ordered lists, none filled in.

    People without a score have no row; a repeated minute or a score that isn't finite gives the reason and empty lists.
    """
    rows = panel.where((F.col("status") == "observed") & F.col("time_min").between(first, last))
    bad = F.max((F.col("vas").isNull() | F.isnan("vas") | (F.abs("vas") == float("inf"))).cast("int")) == 1
    out = rows.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("time_min", "vas"))).alias("x"), bad.alias("bad"), F.count_distinct("time_min").alias("n"))
    reason = F.when(F.size("x") > F.col("n"), "duplicate_minute").when(F.col("bad"), "invalid_score").otherwise("")
    fine = lambda c: F.when(reason == "", F.col("x")[c]).otherwise(F.slice(F.col("x")[c], 1, 0))
    return out.select("subject_id", fine("time_min").alias("minutes"), fine("vas").alias("scores"), reason.alias("reason"))
