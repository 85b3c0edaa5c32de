"""iCalendar text and values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import localised, london


def unfolded(text: Column) -> Column:
    """Continuation lines joined to the lines before, line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]", "")


def unescaped(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\N"), F.lit("\n"))
    for a, b in (("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def duration_minutes(text: Column) -> Column:
    """Minutes of a duration of days, hours and minutes; null for anything else."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 1440 + part(2) * 60 + part(3))


def local_time(value: Column, zone: Column) -> Column:
    """London wall clock of a DATE or DATE-TIME value: in UTC (Z), in the zone it names, else London's own."""
    day = F.regexp_extract(value, r"^(\d{8})", 1)
    clock = F.coalesce(F.nullif(F.regexp_extract(value, r"T(\d{6})", 1), F.lit("")), F.lit("000000"))
    at = F.try_to_timestamp(F.concat(day, clock, F.lit(" +0000")), F.lit("yyyyMMddHHmmss Z"))
    wall = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    known = F.nullif(zone, F.lit(""))
    return F.when(F.endswith(value, F.lit("Z")), london(wall)).when(known.isNotNull(), F.convert_timezone(known, F.lit("Europe/London"), wall)).otherwise(localised(wall))
