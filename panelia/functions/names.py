"""Names in free text and file names: parsed by pattern into structs, NULL where they don't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelia.functions.scalars import clean_code


def parsed(text: Column, pattern: str, *names: str) -> Column:
    """Groups of a pattern as a struct; NULL unless it matches."""
    groups = F.struct(*(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)))
    return F.when(text.rlike(pattern), groups)


def recording_name(name: Column) -> Column:
    """date, code, label and stage of names such as 20240131_017_abc_N.ext."""
    p = parsed(name, r"^(\d{8})[_-](\d+)[_-]([A-Za-z]+)(?:[_-]([A-Za-z]))?\.[^.]+$", "date", "code", "label", "stage")
    return F.when(p.isNotNull(), F.struct(F.try_to_date(p["date"], "yyyyMMdd").alias("date"), clean_code(p["code"]).alias("code"), F.lower(p["label"]).alias("label"), F.upper(p["stage"]).alias("stage")))


def participant_line(line: Column) -> Column:
    """number, name and time of lines such as '12. Name (note) 14:30'."""
    return parsed(F.trim(line), r"^(\d+)[.)、]?\s*([^\d(（]+?)\s*(?:[(（][^)）]*[)）])?\s*(\d{1,2}[:：]\d{2})?$", "number", "name", "time")


def modality(path: Column) -> Column:
    """(modality, level) of a file by its suffix and folders."""
    p = F.lower(path)
    kind = F.when(p.rlike(r"\.(acq|edf)$"), "electrophysiology").when(p.rlike(r"\.(snirf|nirs)$"), "optical").when(p.rlike(r"\.(csv|tsv|txt)$"), "table").otherwise("other")
    level = F.when(p.rlike(r"/(raw|source)/"), "raw").when(p.rlike(r"/(derived|derivatives|export)/"), "derived").otherwise("unknown")
    return F.struct(kind.alias("modality"), level.alias("level"))


def target_date(text: Column, sent: Column, inherited: Column) -> Column:
    """The day that a message speaks of: month and day in it (the year of the message, the next one if that is half a year past), else the inherited day if it is not past, else the message's."""
    month, day = (F.nullif(F.regexp_extract(text, r"(\d{1,2})[/月.](\d{1,2})", i), F.lit("")).try_cast("int") for i in (1, 2))
    year = F.year(sent)
    named = F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), "yyyy-M-d")
    later = F.when(F.datediff(sent, named) > 182, F.add_months(named, 12)).otherwise(named)
    return F.when(month.isNotNull(), later).otherwise(F.when(inherited >= F.to_date(sent), inherited).otherwise(F.to_date(sent)))
