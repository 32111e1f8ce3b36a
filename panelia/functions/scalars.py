"""Scalar functions: numbers, clocks, names, paths, rules; all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelia.sources.panel import MISSING_TOKENS, NUMBER


def finite(text: Column) -> Column:
    """A finite decimal number, or NULL."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def hms_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS(.f); NULL unless minutes and seconds are in range."""
    parts = F.split(F.trim(text), ":")
    h, m, s = (finite(F.get(parts, i)) for i in range(3))
    fits = (F.size(parts) == 3) & (h >= 0) & (h == F.floor(h)) & m.between(0, 59) & (m == F.floor(m)) & (s >= 0) & (s < 60)
    return F.when(fits, h * 3600 + m * 60 + s)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Wilson's 95 % interval as struct (low, high); NULL for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.struct(((centre - spread) / scale).alias("low"), ((centre + spread) / scale).alias("high"))


def zero_event_bound(n: Column) -> Column:
    """The 95 % upper bound of a rate after n trials without an event."""
    return 1 - F.pow(F.lit(0.05), F.try_divide(F.lit(1.0), n))


def split_tokens(text: Column) -> Column:
    """Distinct upper-case tokens between ; and spaces, sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.upper(F.trim(text)), r"[;\s]+"), "")))


def clean_code(text: Column) -> Column:
    """The first run of digits without leading zeros; NULL without digits."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d+)", 1), r"^0+(?=\d)", ""), F.lit(""))


def path_key(path: Column) -> Column:
    """A path for comparison: forward slashes, no trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+$", ""))


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def filename_time(name: Column) -> Column:
    """The timestamp of _YYYYMMDD_HHMMSS in a name, or NULL."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"_(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def rating_token(text: Column) -> Column:
    """Canonical rating token: E, T, "" for missing, or the shortest decimal; NULL for anything else."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    x = finite(t)
    return F.when(t.isin("E", "T"), t).when(t.isin(*MISSING_TOKENS), "").when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def strip_notes(name: Column) -> Column:
    """A name without parenthesised notes, spaces and punctuation."""
    return F.regexp_replace(F.regexp_replace(name, r"[(（][^)）]*[)）]", ""), r"[^\p{L}]", "")


def rule_score(symptoms: Column, regions: Column, rule: dict[str, list[str]]) -> Column:
    """Two points for each required match and one for each supportive; 0 where a required group has none."""
    lists = {k: F.array(*map(F.lit, v)).cast("array<string>") for k, v in rule.items()}
    hits = lambda have, k: F.size(F.array_intersect(have, lists[k])) if k in lists else F.lit(0)
    every = hits(symptoms, "required_all") == len(rule.get("required_all", []))
    some = (hits(symptoms, "required_any") > 0) | F.lit(not rule.get("required_any"))
    where = (hits(regions, "required_region_any") > 0) | F.lit(not rule.get("required_region_any"))
    points = 2 * (hits(symptoms, "required_all") + hits(symptoms, "required_any") + hits(regions, "required_region_any")) + hits(symptoms, "supportive") + hits(regions, "supportive_region_any")
    return F.when(every & some & where, points).otherwise(0).cast("double")


def rule_ranking(symptoms: Column, regions: Column, rules: dict[str, dict[str, list[str]]]) -> Column:
    """Structs (score, name) of the rules with points, best first; ties in the order of the rules."""
    scored = F.array(*(F.struct((-rule_score(symptoms, regions, r)).alias("key"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, r) in enumerate(rules.items())))
    ordered = F.array_sort(F.filter(scored, lambda x: x["key"] < 0))
    return F.transform(ordered, lambda x: F.struct((-x["key"]).alias("score"), x["name"].alias("name")))


def relocated_path(path: Column, roots: list[str], root: str) -> Column:
    """(path, reason): a path under a registered old root is placed under ``root``; one that climbs out is refused.

    The first root that is the path or a folder above it counts, in either case; other paths stay, with forward slashes.
    """
    raw = F.regexp_replace(path, r"\\", "/")
    found = F.lit(None).cast("string")
    for old in reversed([r.replace("\\", "/").rstrip("/") for r in roots]):
        under = (F.lower(raw) == old.lower()) | F.startswith(F.lower(raw), F.lit(old.lower() + "/"))
        found = F.when(under, F.regexp_replace(F.substring(raw, len(old) + 1, 1 << 30), "^/+", "")).otherwise(found)
    climbs = F.coalesce(F.array_contains(F.split(found, "/"), ".."), F.lit(False))
    moved = F.regexp_replace(F.concat(F.lit(root.rstrip("/") + "/"), found), "/$", "")
    return F.struct(F.when(~climbs, F.coalesce(moved, raw)).alias("path"), F.when(climbs, "parent_traversal").when(found.isNotNull(), "relocated").otherwise("").alias("reason"))
