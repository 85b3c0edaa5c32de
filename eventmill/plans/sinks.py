"""What leaves the engine: the snapshot, the table view, calendars, the health panel."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import derive, filters
from .storage import exists, replace


def optional(events: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in events.columns else F.lit(None).cast(kind)


def joined(events: DataFrame, name: str):
    return F.coalesce(F.array_join(name, ", "), F.lit("")) if name in events.columns else F.lit("")


def filled(column):
    return F.nullif(column, F.lit(""))


def table_view(events: DataFrame) -> DataFrame:
    """Eight columns of text for each event."""
    where = F.concat_ws(", ", filled(optional(events, "venue_name")), filled(optional(events, "city")))
    price = F.coalesce(filled(optional(events, "price_text")), F.when(F.col("is_free"), "Free"), F.lit("—"))
    label = clock.when_label(F.col("start_ts"), F.col("end_ts"), F.col("ongoing"), F.coalesce(optional(events, "all_day", "boolean"), F.lit(False)), optional(events, "when_text"))
    return events.select(
        label.alias("when"), F.col("title").alias("event"), where.alias("where"), F.coalesce(filled(optional(events, "age_text")), F.lit("—")).alias("age"),
        price.alias("price"), joined(events, "careers").alias("subject"), joined(events, "work_styles").alias("ways"), F.col("source_name").alias("source"),
    )


def ical_text(column):
    """Escaped as a calendar's text value."""
    out = F.coalesce(column, F.lit(""))
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def calendar_entries(events: DataFrame, stamp: str) -> DataFrame:
    """id, entry: a VEVENT for each event that has a date. stamp: a UTC clock like 19980601T110000Z.

    Runs and all-day events are dates with an exclusive end; a missing end is two hours after the start."""
    e = events.filter(filters.calendar_able(F.col("start_ts"), F.col("anytime")))
    start, end = F.col("start_ts"), F.coalesce("end_ts", F.timestamp_add("HOUR", F.lit(2), F.col("start_ts")))
    utc = lambda c: F.date_format(clock.utc(c), "yyyyMMdd'T'HHmmss'Z'")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    whole = F.coalesce(optional(e, "all_day", "boolean"), F.lit(False)) | F.col("ongoing")
    url = filters.safe_url(F.col("url"))
    about = F.concat_ws("\n", filled(optional(e, "summary")), filled(optional(e, "price_text")), filled(optional(e, "age_text")), url)
    place = F.concat_ws(", ", filled(optional(e, "venue_name")), filled(optional(e, "city")))
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), ical_text(F.col("id")), F.lit("@eventmill")),
        F.lit(f"DTSTAMP:{stamp}"),
        F.when(whole, F.concat(F.lit("DTSTART;VALUE=DATE:"), day(start))).otherwise(F.concat(F.lit("DTSTART:"), utc(start))),
        F.when(whole, F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.timestamp_add("DAY", F.lit(1), end)))).otherwise(F.concat(F.lit("DTEND:"), utc(end))),
        F.concat(F.lit("SUMMARY:"), ical_text(F.col("title"))),
        F.concat(F.lit("LOCATION:"), ical_text(place)),
        F.concat(F.lit("DESCRIPTION:"), ical_text(about)),
        F.concat(F.lit("URL:"), url),
        F.lit("END:VEVENT"),
    ]
    return e.select("id", F.concat_ws("\r\n", *lines).alias("entry"))


def calendar_counts(events: DataFrame) -> DataFrame:
    """One row: events written to a calendar, and those skipped for want of a date."""
    able = filters.calendar_able(F.col("start_ts"), F.col("anytime"))
    return events.agg(F.count_if(able).alias("written"), F.count_if(~F.coalesce(able, F.lit(False))).alias("skipped"))


def write_calendar(events: DataFrame, path: str, stamp: str) -> None:
    """Calendar files, one a partition: each is whole by itself."""
    entries = calendar_entries(events, stamp)

    def wrap(rows):
        import pandas as pd

        for pdf in rows:
            body = "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//eventmill//EN", "CALSCALE:GREGORIAN", *pdf["entry"], "END:VCALENDAR"])
            yield pd.DataFrame({"value": [body]})

    entries.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)


def write_events(events: DataFrame, path: str, compression: str | None = None) -> None:
    """Events as JSON without empty fields; plain, or compressed (gzip) where only an engine reads them."""
    derive.without_empty(events).write.mode("overwrite").option("ignoreNullFields", True).json(path, compression=compression)


def write_snapshot(events: DataFrame, reports: DataFrame, path: str, header: dict, compression: str | None = None) -> None:
    """events/ and sources/ as JSON without empty fields, and header.json, written to one side and then renamed."""
    spark = events.sparkSession
    side = f"{path}.new"
    write_events(events, f"{side}/events", compression)
    reports.write.mode("overwrite").option("ignoreNullFields", True).json(f"{side}/sources")
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{side}/header")
    replace(spark, side, path)


def health_panel(reports: DataFrame) -> DataFrame:
    """A line for each source: its counts, state and freshness, worst first."""
    worst = F.when(F.col("status") == "ok", 1).otherwise(0)
    state = F.when(F.col("status") == "ok", "ok").when(F.col("status") == "blocked", "checked by hand").otherwise(F.replace("status", F.lit("_"), F.lit(" ")))
    return reports.select("key", "name", "count", "candidate_count", state.alias("state"), F.coalesce("last_success", F.lit("never")).alias("last_success"), worst.alias("_w")).orderBy("_w", "key").drop("_w")


def user_ids(spark, path: str) -> DataFrame:
    """A stored table of ids; an empty one where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string").json(path)


def save_user_ids(ids: DataFrame, path: str) -> None:
    ids.select("id").distinct().write.mode("overwrite").json(path)


def exit_code(reports: DataFrame, allow_drop: bool = False) -> int:
    """1 if any source is degraded (blocked ones aren't), unless that is allowed."""
    bad = reports.filter(~F.col("status").isin("ok", "blocked")).limit(1).count()
    return int(bool(bad) and not allow_drop)


