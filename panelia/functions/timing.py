"""Times and segments of recordings: Column expressions with a reason where there is no answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibration:
    """Lengths in seconds of a session's parts, and the bounds of its decisions."""

    train: float = 120.0
    guard: float = 10.0
    validation: float = 120.0
    exploratory_db: float = 6.0
    legacy_db: float = 15.0


def start_time(text: Column) -> Column:
    """The instant of 2024-01-31 13h05.22.123456 +0000."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH'h'mm.ss.SSSSSS xx"))


def marker_time(text: Column) -> Column:
    """The instant after date_created_utc: in a line."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"date_created_utc: (\d{4}-\d\d-\d\dT[^ ]+)", 1), F.lit("")))


def expanded_times(values: Column, n: Column) -> Column:
    """(times, error): n times as given, or from a start and a step; times must grow."""
    step = F.get(values, F.lit(1))
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, F.lit(0)) + i * step)
    packed = (F.size(values) == 2) & (n != 2)
    times = F.when(packed, made).otherwise(values)
    grows = F.forall(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: (F.size(times) < 2) | (F.get(times, i) > F.get(times, i - 1)))
    bad = (n < 1) | (F.size(values) < 1) | F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    error = F.when(F.coalesce(bad, F.lit(True)), "invalid").when(packed & (step <= 0), "step").when(F.size(times) != n, "length").when(~grows, "not increasing")
    return F.struct(F.when(error.isNull(), times).alias("times"), error.alias("error"))


def segment_bounds(n: Column, starts: Column, index: Column) -> Column:
    """(start, stop, error) of the chosen segment; without a choice the whole recording, if it has one segment."""
    last = F.size(starts) - 1
    ordered = (F.size(starts) == 0) | ((F.get(starts, F.lit(0)) == 0) & (F.get(starts, last) < n) & F.forall(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: (i >= last) | (F.get(starts, i) < F.get(starts, i + 1))))
    error = F.when(~ordered, "invalid_boundaries").when(index.isNull() & (last > 0), "several_segments_need_a_choice").when((index < 0) | (index > last), "segment_count_changed")
    start = F.when(index.isNull(), F.lit(0)).otherwise(F.get(starts, index))
    stop = F.when(index.isNull() | (index == last), n).otherwise(F.get(starts, index + 1))
    return F.struct(F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), stop).alias("stop"), error.alias("error"))


def session_parts(n: Column, rate: float, c: Calibration = Calibration()) -> Column:
    """Ends (in samples) of the training, guard and validation parts; NULL where the session is too short."""
    train, guard, validation = (round(x * rate) for x in (c.train, c.guard, c.validation))
    ends = F.struct(F.lit(train).alias("train"), F.lit(train + guard).alias("guard"), F.lit(train + guard + validation).alias("validation"))
    return F.when(n >= train + guard + validation, ends)


def attenuation_class(db: Column, faithful: Column, c: Calibration = Calibration()) -> Column:
    """Whether an attenuation passes the exploratory and the legacy bound."""
    passed = lambda bound: F.coalesce(faithful & (db >= bound), F.lit(False))
    status = F.when(passed(c.exploratory_db), "E05_EXPLORATORY_PASSED").otherwise("E05_UNRESOLVED")
    return F.struct(passed(c.exploratory_db).alias("exploratory"), passed(c.legacy_db).alias("legacy"), status.alias("status"))


def bandwidth(width: Column, nw: float = 3.0, caution_below: float = 300.0) -> Column:
    """From the widest full smoothing (Hz): the shortest run and its widths in cycles per minute."""
    seconds = F.when((width > 0) & (width < float("inf")), 2 * nw / width)
    note = F.when(seconds < caution_below, "UNDER_300S_RESOLUTION_CAUTION").when(seconds.isNotNull(), "RESOLUTION_METADATA_RECORDED")
    return F.struct(seconds.alias("seconds"), (60 / seconds).alias("bin"), (60 * nw / seconds).alias("half"), (120 * nw / seconds).alias("full"), note.alias("note"))


def lead_places(names: Column) -> Column:
    """Places (from 0) of the first three channels whose name holds ECG; else the usual ones of 5 or more channels."""
    marked = F.filter(F.transform(names, lambda x, i: F.when(F.upper(x).contains("ECG"), i)), lambda i: i.isNotNull())
    usual = F.when(F.size(names) == 5, F.array(F.lit(2), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(3), F.lit(4), F.lit(5)))
    return F.when(F.size(marked) >= 3, F.slice(marked, 1, 3)).otherwise(usual)
