"""Identities in file names and lines of text: parsed into structs, NULL where they don't fit; all Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelia.functions.scalars import clean_code

# Stages of a recording, and the endings that mark a person's group.
STAGES = ("E", "N", "C", "P")
GROUP_ENDINGS = ("辣椒素组", "非辣组", "健康2", "治神", "健康", "推拿", "受针", "预")


def subject_label(identity: Column) -> Column:
    """sub-N of SUBJECTN."""
    digits = F.regexp_extract(identity, r"^SUBJECT(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("sub-"), digits))


def rating_signature(tokens: list[Column], fold_case: bool = True) -> Column:
    """The trimmed tokens of a row of ratings, missing ones empty, as an array."""
    found = F.array(*(F.trim(F.coalesce(t.cast("string"), F.lit(""))) for t in tokens))
    return F.transform(found, F.upper) if fold_case else found


def person_name(text: Column) -> Column:
    """A name without notes in brackets, remarks on its state, and what is no CJK character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[（(].*?[）)]", ""), "终止|排除", ""), r"[^\x{3400}-\x{9fff}·]", "")


def own_name(text: Column) -> Column:
    """A person's name without the endings of groups; two characters at least stay."""
    return F.regexp_replace(person_name(text), f"(?<=^.{{2,60}})({'|'.join(GROUP_ENDINGS)})+$", "")


def token_of(file_name: Column) -> Column:
    """What stands before the first underscore of a name without extension and a last 'acq'; NULL for hidden copies."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""), "(?i)acq$", "")
    return F.when(~file_name.startswith("._"), F.substring_index(stem, "_", 1))


def real_day(digits: Column) -> Column:
    """The digits, where they name a day of the calendar."""
    return F.when(F.try_to_date(digits, "yyyyMMdd").isNotNull(), digits)


def extended_name(file_name: Column) -> Column:
    """date, code, label, stage and rule of names such as 20240131017abcdE."""
    token = token_of(file_name)
    pattern = r"^(20\d{6})(\d{1,3})?([A-Za-z]*)$"
    part = lambda i: F.regexp_extract(token, pattern, i)
    letters, number = F.upper(part(3)), F.nullif(part(2), F.lit(""))
    last = F.right(letters, F.lit(1))
    long = letters.rlike("^[A-Z]{4}([NCE]+|P)$")
    lone, short, bare = letters.isin(*STAGES), letters.rlike("^[A-Z]{3}[ENCP]$"), letters.rlike("^[A-Z]{4}$")
    label = F.when(lone, "").when(long | (bare & ~short), F.left(letters, F.lit(4))).when(short, F.left(letters, F.lit(3)))
    stage = F.when(lone | long | short, last).otherwise("")
    rule = (
        F.when(short, "three_letter_abbreviation_requires_anchor")
        .when(number.isNull(), "missing_code_requires_date_abbreviation_anchor")
        .when(label == "", "missing_abbreviation_requires_date_code_anchor")
        .otherwise("explicit_phase")
    )
    date = real_day(part(1))
    return F.when(token.rlike(pattern) & date.isNotNull() & label.isNotNull(), F.struct(date.alias("date"), clean_code(number).alias("code"), label.alias("label"), stage.alias("stage"), rule.alias("rule")))


def phase_name(file_name: Column) -> Column:
    """date, code, label, stage, prefix and status of names that end in an explicit phase."""
    token = token_of(file_name)
    full, plain = r"(?i)^(20\d{6})(\d{1,3})?([A-Z]{3,4}?)([ENC]|NE)$", r"(?i)^(20\d{6})(\d{1,3})()([ENC])$"
    part = lambda i: F.when(token.rlike(full), F.regexp_extract(token, full, i)).otherwise(F.regexp_extract(token, plain, i))
    date, phase, label = real_day(part(1)), part(4), F.upper(part(3))
    prefix = F.upper(F.left(token, F.length(token) - F.length(phase)))
    status = F.when(F.length(label) == 3, "short_abbreviation_ambiguous").otherwise("explicit_phase")
    return F.when(date.isNotNull(), F.struct(date.alias("date"), clean_code(part(2)).alias("code"), label.alias("label"), F.upper(F.right(phase, F.lit(1))).alias("stage"), prefix.alias("prefix"), status.alias("status")))


def named_code(line: Column, name: Column) -> Column:
    """The code right before exactly this person's name in a line."""
    pattern = r"(?:^|[：:\s])([Zz]?\d{1,3})\s*([\x{3400}-\x{9fff}·]{2,8})"
    return F.when(own_name(F.regexp_extract(line, pattern, 2)) == name, clean_code(F.regexp_extract(line, pattern, 1)))


def identity_name(workbook: Column, bridge: Column) -> Column:
    """The workbook's name, else the bridge's, trimmed."""
    return F.trim(F.coalesce(F.nullif(workbook, F.lit("")), bridge, F.lit("")))


def mapping_resolution(workbook: Column, bridge: Column, label: Column, labels: Column) -> Column:
    """(basis, tier, score) of a reviewed label for a person whose other labels are given."""
    label = F.upper(F.coalesce(label, F.lit("")))
    own, old = person_name(identity_name(workbook, bridge)), person_name(bridge)
    near = F.array_min(F.transform(labels, lambda x: F.levenshtein(label, x)))
    kind = lambda basis, tier, score: F.struct(F.lit(basis).alias("basis"), F.lit(tier).alias("tier"), F.lit(score).alias("score"))
    return (
        F.when((own != "") & (old != "") & (own != old), kind("source_workbook_code_vas_identity_overrides_stale_legacy_name", "high", 98))
        .when(F.array_contains(labels, label), kind("same_source_identity_and_abbreviation", "high", 98))
        .when(near == 1, kind("same_source_identity_reviewed_one_character_abbreviation_variant", "medium", 85))
        .otherwise(kind("same_source_identity_reviewed_abbreviation_variant", "medium", 80))
    )


def evidence(code: Column, label: Column) -> Column:
    """(code, label) where there is a code and the label has four letters."""
    number, letters = clean_code(code), F.upper(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(number.isNotNull() & letters.rlike("^[A-Z]{4}$"), F.struct(number.alias("code"), letters.alias("label")))
