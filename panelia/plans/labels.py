"""Queries of labels, times and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.functions import labels, timing
from panelia.functions.scalars import path_key
from panelia.operators import identities, stopping
from panelia.plans.common import panel, table, with_panel


def choice(key: str, options: list[str | None]) -> F.Column:
    """The option at the key's remainder."""
    return F.get(F.array(*map(F.lit, options)), (F.col(key) % len(options)).cast("int"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_custkey") % 1000).cast("string")).otherwise("")
    name = F.concat(F.when(F.col("o_orderkey") % 11 == 0, "._").otherwise(""), F.date_format("o_orderdate", "yyyyMMdd"), code, choice("o_orderkey", ["N", "abcdE", "abcP", "wxyz", "ab", "abcdNE", "abC"]), choice("o_orderkey", ["_x.csv", "acq.acq", ".acq"]))
    return o.select("o_orderkey", name.alias("name"))


def extended_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir).select("o_orderkey", labels.extended_name(F.col("name")).alias("x")).select("o_orderkey", "x.*")


def phase_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_names(spark, sf_dir).select("o_orderkey", labels.phase_name(F.col("name")).alias("x")).select("o_orderkey", "x.*")


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("name", choice("c_custkey", ["张三", "张三健康", "张三辣椒素组", "张三四", "张三（备注）健康2"]))
    line = F.concat((F.col("c_custkey") % 100).cast("string"), F.lit(" "), F.col("name"))
    identity = F.concat(choice("c_custkey", ["SUBJECT", "SUBJ"]), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", labels.person_name(F.col("name")).alias("plain"), labels.own_name(F.col("name")).alias("own"), labels.named_code(line, F.lit("张三")).alias("code"), labels.subject_label(identity).alias("label"))


def mapping_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    label = choice("c_custkey", ["abcd", "abce", "zzzz", "ABCD"])
    r = labels.mapping_resolution(choice("c_custkey", ["张三", "", "李四"]), choice("c_custkey", ["张三", ""]), label, F.array(F.lit("ABCD"), F.lit("WXYZ")))
    e = labels.evidence(F.concat(choice("c_custkey", ["no ", "none", "0"]), F.when(F.col("c_custkey") % 3 != 1, F.col("c_custkey").cast("string")).otherwise("")), F.concat(F.lit(" "), choice("c_custkey", ["abcd", "abc", "ab1d", "wxyz ", ""])))
    return c.select("c_custkey", r.alias("r"), e.alias("e")).select("c_custkey", "r.*", "e.code", "e.label")


def rating_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tokens = [F.concat(F.lit(" "), F.col("p_name")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")), F.col("p_size")]
    return p.select("p_partkey", F.array_join(labels.rating_signature(tokens, False), "|").alias("signature"), F.array_join(labels.rating_signature(tokens), "|").alias("folded"))


def start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH'h'mm.ss.SSSSSS"), F.lit(" +0000")))
    marker = F.when(F.col("o_orderkey") % 5 == 1, "no date").otherwise(F.concat(F.lit("x date_created_utc: "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 y")))
    return o.select("o_orderkey", F.unix_micros(timing.start_time(start)).alias("start"), F.unix_seconds(timing.marker_time(marker)).alias("marker"))


def log_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    minute = F.when(F.col("user_id") % 3 == 0, F.lpad((F.col("event_id") % 2).cast("string"), 2, "0")).otherwise("05")
    start = F.concat(F.lit("2024-01-01 10h"), minute, F.lit("."), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"), F.lit(".000000 +0000"))
    rows = e.select("user_id", start.alias("start"), F.col("value").cast("string").alias("a"), choice("event_id", ["NA", "-1", "0.001"]).alias("b"))
    found = identities.log_intervals(rows, "user_id", "start", ["a", "b"])
    return found.select("user_id", F.second("start").alias("second"), (F.unix_micros("stop") - F.unix_micros("start")).alias("micros"))


def time_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    values = F.array(0.5 * F.col("p_size"), F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(0.25))
    x = timing.expanded_times(values, (F.col("p_partkey") % 5).cast("int"))
    return p.select("p_partkey", F.size(x["times"]).alias("n"), F.element_at(x["times"], -1).alias("last"), x["error"].alias("error")).withColumn("n", F.when(F.col("error").isNull(), F.col("n")))


def recording_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("int")).withColumn("n", 100 + F.col("p_size"))
    starts = F.when(F.col("k") % 5 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), 50 * (F.col("k") % 4)))
    s = timing.segment_bounds(F.col("n"), starts, F.when(F.col("k") % 3 > 0, F.col("k") % 3 - 1))
    parts = timing.session_parts(F.col("p_size") * 1000, 100.0)
    return p.select("p_partkey", s["start"].alias("start"), s["stop"].alias("stop"), s["error"].alias("error"), parts["train"].alias("train"), parts["guard"].alias("guard"), parts["validation"].alias("validation"))


def channel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey").cast("int"))
    a = timing.attenuation_class(F.col("p_size") * 0.5, F.col("k") % 3 > 0)
    b = timing.bandwidth(F.col("p_size") / 1000)
    names = F.transform(F.sequence(F.lit(1), 5 + F.col("k") % 2), lambda i: F.concat(F.when((i * F.col("k")) % 3 == 0, "my ecg").otherwise("x"), i.cast("string")))
    leads = F.array_join(F.transform(timing.lead_places(names), lambda i: i.cast("string")), ",")
    return p.select("p_partkey", a["exploratory"].alias("exploratory"), a["legacy"].alias("legacy"), a["status"].alias("status"), *(F.round(b[x], 6).alias(x) for x in ("seconds", "bin", "half", "full")), b["note"].alias("note"), leads.alias("leads"))


def unphased_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", choice("o_orderkey", ["E", "N", "C", "P"]).alias("stage"))
    known = spark.createDataFrame([("OE",), ("FN",), ("PP",)], "alias string")
    return identities.unphased_aliases(o, ["o_custkey"], "o_orderstatus", "stage", F.col("o_orderkey") % 2 == 0, known).select("o_orderkey", "stage", "unphased")


def added_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("dir/"), F.col("s_suppkey").cast("string")).alias("path"))
    more = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("id"), F.concat(F.lit("DIR\\"), (F.col("c_custkey") % 70).cast("string"), F.lit("/")).alias("path"))
    return identities.added_mappings(rows, more, [F.col("id"), path_key(F.col("path"))], ["id", "path"])


def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 400).alias("subject"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("target"), choice("c_custkey", ["", "a", "b", "c", "d"]).alias("assessor"))
    return identities.contract_errors(c, "c_custkey", "subject", ["subject", "target", "assessor"], F.col("c_custkey") % 2 == 0)


def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_rows(spark, sf_dir).select("c_custkey", F.array_join("errors", ",").alias("errors"))


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.contract_status(contract_rows(spark, sf_dir))


def pending_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("vas", F.when(F.col("vas") < 35_000, 0.0).otherwise(F.col("vas")))
    return identities.pending_zeros(p, stopping.audit_stopping(p))


QUERIES = {
    f.__name__: f
    for f in (extended_names, phase_names, person_names, mapping_resolutions, rating_signatures, start_times, log_intervals, time_vectors, recording_segments, channel_rules, unphased_aliases, added_mappings, contract_errors, contract_status, pending_zeros)
}

FILES = "f AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey % 1000 AS VARCHAR) ELSE '' END AS c, o_orderkey % 7 AS m, o_orderkey % 11 = 0 AS hidden FROM orders)"
CONTRACT = """e AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'target_missing' END AS a, CASE WHEN c_custkey % 5 = 0 THEN 'assessor_missing' END AS b,
    CASE WHEN row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY c_custkey) > 1 THEN 'duplicate_subject' END AS c, CASE WHEN c_custkey % 2 <> 0 THEN 'reference_not_independent' END AS d FROM customer)"""
ORACLES = {
    "extended_names": f"""WITH {FILES} SELECT o_orderkey, CASE WHEN ok THEN d END AS date, CASE WHEN ok THEN nullif(c, '') END AS code, CASE WHEN ok THEN l END AS label, CASE WHEN ok THEN s END AS stage,
        CASE WHEN NOT ok THEN NULL WHEN m = 2 THEN 'three_letter_abbreviation_requires_anchor' WHEN c = '' THEN 'missing_code_requires_date_abbreviation_anchor' WHEN m = 0 THEN 'missing_abbreviation_requires_date_code_anchor' ELSE 'explicit_phase' END AS rule
      FROM (SELECT *, NOT hidden AND d LIKE '20%' AND m NOT IN (4, 6) AS ok, CASE m WHEN 0 THEN '' WHEN 2 THEN 'ABC' WHEN 3 THEN 'WXYZ' ELSE 'ABCD' END AS l, CASE m WHEN 0 THEN 'N' WHEN 2 THEN 'P' WHEN 3 THEN '' ELSE 'E' END AS s FROM f)""",
    "phase_names": f"""WITH {FILES} SELECT o_orderkey, CASE WHEN ok THEN d END AS date, CASE WHEN ok THEN nullif(c, '') END AS code, CASE WHEN ok THEN l END AS label, CASE WHEN ok THEN CASE m WHEN 0 THEN 'N' ELSE 'E' END END AS stage,
        CASE WHEN ok THEN d || c || l END AS prefix, CASE WHEN ok THEN 'explicit_phase' END AS status
      FROM (SELECT *, NOT hidden AND d LIKE '20%' AND (m IN (1, 5) OR (m = 0 AND c <> '')) AS ok, CASE m WHEN 0 THEN '' ELSE 'ABCD' END AS l FROM f)""",
    "person_names": """SELECT c_custkey, ['张三', '张三健康', '张三辣椒素组', '张三四', '张三健康'][c_custkey % 5 + 1] AS plain, CASE c_custkey % 5 WHEN 3 THEN '张三四' ELSE '张三' END AS own,
      CASE WHEN c_custkey % 5 <> 3 THEN CAST(c_custkey % 100 AS VARCHAR) END AS code, CASE WHEN c_custkey % 2 = 0 THEN 'sub-' || c_custkey END AS label FROM customer""",
    "mapping_resolutions": """SELECT c_custkey, CASE r WHEN 1 THEN 'source_workbook_code_vas_identity_overrides_stale_legacy_name' WHEN 2 THEN 'same_source_identity_and_abbreviation' WHEN 3 THEN 'same_source_identity_reviewed_one_character_abbreviation_variant' ELSE 'same_source_identity_reviewed_abbreviation_variant' END AS basis,
        CASE WHEN r < 3 THEN 'high' ELSE 'medium' END AS tier, CAST(CASE r WHEN 3 THEN 85 WHEN 4 THEN 80 ELSE 98 END AS INTEGER) AS score, CASE WHEN e THEN CAST(c_custkey AS VARCHAR) END AS code, CASE WHEN e THEN CASE c_custkey % 5 WHEN 0 THEN 'ABCD' ELSE 'WXYZ' END END AS label
      FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN 1 WHEN c_custkey % 4 IN (0, 3) THEN 2 WHEN c_custkey % 4 = 1 THEN 3 ELSE 4 END AS r, c_custkey % 3 <> 1 AND c_custkey % 5 IN (0, 3) AS e FROM customer)""",
    "rating_signatures": "SELECT p_partkey, s AS signature, upper(s) AS folded FROM (SELECT p_partkey, trim(p_name) || '|' || CASE WHEN p_partkey % 3 > 0 THEN trim(p_brand) ELSE '' END || '|' || p_size AS s FROM part)",
    "start_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN epoch_us(o_orderdate) END AS start, CASE WHEN o_orderkey % 5 <> 1 THEN epoch_us(date_trunc('second', o_orderdate)) // 1000000 END AS marker FROM orders",
    "log_intervals": "SELECT user_id, CAST(user_id % 60 AS INTEGER) AS second, CAST(round(greatest(max(value), 0.001) * 1000000) AS BIGINT) AS micros FROM events GROUP BY user_id HAVING user_id % 3 <> 0 OR count(DISTINCT event_id % 2) = 1",
    "time_vectors": """SELECT p_partkey, CASE WHEN error IS NULL THEN n END AS n, CASE WHEN error IS NULL THEN 0.5::DOUBLE * p_size + 0.25::DOUBLE * (n - 1) END AS last, error FROM (SELECT p_partkey, p_size, CAST(p_partkey % 5 AS INTEGER) AS n,
      CASE p_partkey % 5 WHEN 0 THEN 'invalid' WHEN 2 THEN 'not increasing' ELSE CASE WHEN p_size % 7 = 0 THEN 'step' END END AS error FROM part)""",
    "recording_segments": """SELECT p_partkey, CASE WHEN error IS NULL THEN CAST(CASE WHEN k % 3 = 2 THEN 50 * m ELSE 0 END AS INTEGER) END AS start, CASE WHEN error IS NULL THEN CAST(CASE WHEN one OR k % 3 = 2 THEN n ELSE 50 * m END AS INTEGER) END AS stop, error,
        CASE WHEN p_size >= 25 THEN 12000 END AS train, CASE WHEN p_size >= 25 THEN 13000 END AS guard, CASE WHEN p_size >= 25 THEN 25000 END AS validation
      FROM (SELECT *, CASE WHEN NOT one AND (m = 0 OR 50 * m >= n) THEN 'invalid_boundaries' WHEN NOT one AND k % 3 = 0 THEN 'several_segments_need_a_choice' WHEN one AND k % 3 = 2 THEN 'segment_count_changed' END AS error
        FROM (SELECT p_partkey, p_size, p_partkey AS k, p_partkey % 4 AS m, p_partkey % 5 = 0 AS one, 100 + p_size AS n FROM part))""",
    "channel_rules": """SELECT p_partkey, ok AND p_size >= 12 AS exploratory, ok AND p_size >= 30 AS legacy, CASE WHEN ok AND p_size >= 12 THEN 'E05_EXPLORATORY_PASSED' ELSE 'E05_UNRESOLVED' END AS status,
        round(s, 6) AS seconds, round(60 / s, 6) AS bin, round(180 / s, 6) AS "half", round(360 / s, 6) AS "full", CASE WHEN s < 300 THEN 'UNDER_300S_RESOLUTION_CAUTION' ELSE 'RESOLUTION_METADATA_RECORDED' END AS note,
        CASE WHEN NOT ok THEN '0,1,2' WHEN p_partkey % 2 = 0 THEN '2,3,4' ELSE '3,4,5' END AS leads
      FROM (SELECT p_partkey, p_size, p_partkey % 3 > 0 AS ok, 6.0::DOUBLE / (p_size / 1000.0::DOUBLE) AS s FROM part)""",
    "unphased_aliases": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS l, ['E', 'N', 'C', 'P'][o_orderkey % 4 + 1] AS stage FROM orders),
      p AS (SELECT o_custkey, l, bool_or(stage = 'E') AND bool_or(stage IN ('N', 'C')) AS pair FROM o GROUP BY o_custkey, l)
      SELECT o_orderkey, stage, o_orderkey % 2 = 0 AND l || stage IN ('OE', 'FN', 'PP') AND NOT pair AS unphased FROM o JOIN p USING (o_custkey, l)""",
    "added_mappings": r"""SELECT s_suppkey AS id, 'dir/' || s_suppkey AS path FROM supplier
      UNION ALL SELECT DISTINCT c_custkey % 50, 'DIR\' || (c_custkey % 70) || '/' FROM customer WHERE NOT (c_custkey % 50 = c_custkey % 70 AND c_custkey % 50 IN (SELECT s_suppkey FROM supplier))""",
    "contract_errors": f"WITH {CONTRACT} SELECT c_custkey, concat_ws(',', a, b, c, d) AS errors FROM e",
    "contract_status": f"""WITH {CONTRACT} SELECT CASE WHEN count(*) > 0 AND count(a) + count(b) + count(c) + count(d) = 0 THEN 'contract_documented_needs_target_review' ELSE 'pending_independent_clinical_reference' END AS status,
      count(*) AS subjects, count(a) + count(b) + count(c) + count(d) AS n_errors FROM e""",
    "pending_zeros": with_panel(
        """SELECT z.subject_id, z.time_min, m.f AS old_first_E_min, CAST(m.f - 2 AS INTEGER) AS new_first_E_min FROM z JOIN m USING (subject_id) WHERE z.vas = 0 AND z.time_min BETWEEN m.f - 2 AND m.f - 1 AND m.code = 'E'
        AND 2 = (SELECT count(*) FROM z y WHERE y.subject_id = z.subject_id AND y.vas = 0 AND y.time_min BETWEEN m.f - 2 AND m.f - 1)""",
        "z AS (SELECT * REPLACE (CASE WHEN vas < 35000 THEN 0 ELSE vas END AS vas) FROM panel)",
        "m AS (SELECT subject_id, min(time_min) AS f, arg_min(termination_code, time_min) AS code FROM panel WHERE status LIKE 'termination_%' GROUP BY subject_id)",
    ),
}
