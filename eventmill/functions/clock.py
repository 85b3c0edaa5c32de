"""London wall clocks, instants and ISO texts as columns. No function reads the session's time zone or the current time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LONDON


def utc(local: Column) -> Column:
    """The UTC clock at a London wall clock; times in the spring gap are an hour later, in the autumn overlap the first."""
    return F.convert_timezone(F.lit(LONDON), F.lit("UTC"), local)


def london(utc_clock: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LONDON), utc_clock)


def localised(local: Column) -> Column:
    """A wall clock that exists: those in the spring gap move on by an hour."""
    return london(utc(local))


def iso(local: Column) -> Column:
    """ISO text with the London offset of a wall clock."""
    real = localised(local)
    summer = F.timestamp_diff("HOUR", utc(local), real) == 1
    return F.concat(F.date_format(real, "yyyy-MM-dd'T'HH:mm:ss"), F.when(summer, F.lit("+01:00")).otherwise(F.lit("+00:00")))


def instant_utc(text: Column) -> Column:
    """UTC clock of an ISO text: with an offset or Z as it says, without one by the London clock."""
    parts = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
    day, hm, sec, off = (F.regexp_extract(text, parts, i) for i in (1, 2, 3, 4))
    clock = F.when(hm == "", F.lit("00:00")).otherwise(hm)
    second = F.when(sec == "", F.lit(":00")).otherwise(sec)
    wall = F.try_to_timestamp(F.concat(day, F.lit(" "), clock, second, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall.cast("timestamp_ntz"))
    digits = F.regexp_replace(off, "[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(0)
    minutes = F.when(F.startswith(off, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(off == "", utc(wall)).otherwise(F.timestamp_add("MINUTE", -minutes, wall))


def shift(local: Column, unit: str, n) -> Column:
    """Wall-clock arithmetic: a day later is the same time of day, whatever the clocks do between."""
    return localised(F.timestamp_add(unit, n if isinstance(n, Column) else F.lit(n), local))


def roll_year(local: Column, yearless: Column, now: Column, allowed: bool = True, days: int = 90) -> Column:
    """A date printed without a year, more than `days` before now, is next year's (29 February becomes the 28th)."""
    old = local < F.timestamp_add("DAY", F.lit(-days), now)
    return F.when(F.lit(allowed) & yearless & old, local + F.expr("INTERVAL 1 YEAR")).otherwise(local)


def epoch(utc_clock: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc_clock)


def older(local: Column, now: Column, hours: int) -> Column:
    """More than so many hours before now, to the last fraction of a second."""
    return local < F.timestamp_add("HOUR", F.lit(-hours), now)


def is_weekend(local: Column) -> Column:
    return F.weekday(local) >= 5


def when_label(start: Column, end: Column, ongoing: Column, all_day: Column, when_text: Column) -> Column:
    """Verbatim wording; else a run of over a day by its ends (with years if they differ); else the day, its time, and the end's time."""
    long_run = ongoing & (end > F.timestamp_add("DAY", F.lit(1), start))
    years = F.date_format(start, "yyyy") != F.date_format(end, "yyyy")
    ends = lambda pattern: F.concat_ws(" – ", F.date_format(start, pattern), F.date_format(end, pattern))
    until = F.when(end < F.timestamp_add("DAY", F.lit(1), start), F.concat(F.lit("–"), F.date_format(end, "HH:mm"))).otherwise(F.lit(""))
    single = F.concat(F.date_format(start, "EEE d MMM"), F.when(all_day, F.lit("")).otherwise(F.concat(F.lit(", "), F.date_format(start, "HH:mm"), until)))
    return (
        F.when(F.length(when_text) > 0, when_text)
        .when(start.isNull(), F.lit("Date to be confirmed"))
        .when(F.coalesce(long_run, F.lit(False)), F.when(years, ends("d MMM yyyy")).otherwise(ends("EEE d MMM")))
        .otherwise(single)
    )
