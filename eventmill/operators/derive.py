"""Derived columns of events. Clocks come as arguments: `now` is a London wall clock (timestamp_ntz), `now_iso` an ISO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import older


def stable_id(source: Column, key: Column) -> Column:
    """source, and 12 hex digits of the SHA-1 of source and key."""
    return F.concat(source, F.lit("-"), F.substring(F.sha1(F.concat(source, F.lit("|"), key)), 1, 12))


def range_sane(events: DataFrame) -> DataFrame:
    """An end before the start goes, the run with it, and a note is added. Ends are compared as texts."""
    bad = F.coalesce(F.col("end") < F.col("start"), F.lit(False))
    changed = {"end": F.when(~bad, F.col("end"))}
    if "end_ts" in events.columns:
        changed["end_ts"] = F.when(~bad, F.col("end_ts"))
    if "ongoing" in events.columns:
        changed["ongoing"] = F.col("ongoing") & ~bad
    if "provenance" in events.columns:
        note = F.lit("stated end before start; end dropped")
        changed["provenance"] = F.when(bad, F.concat_ws("; ", F.nullif("provenance", F.lit("")), note)).otherwise(F.col("provenance"))
    return events.withColumns(changed)


def ongoing(start: Column, end: Column) -> Column:
    """The ends' days differ."""
    return F.coalesce(F.substring(start, 1, 10) != F.substring(end, 1, 10), F.lit(False))


def exhibition(is_run: Column, anytime: Column, topics: Column, wanted: Column) -> Column:
    """A run, not a standing offer, with a topic that its source calls an exhibition."""
    return is_run & ~anytime & F.coalesce(F.arrays_overlap(topics, wanted), F.lit(False))


def eligibility(age_min: Column, age_max: Column, audiences: Column, age: int) -> Column:
    """excluded, eligible or unknown, by the first rule that applies."""
    only_children = (F.size(audiences) == 1) & F.array_contains(audiences, "children")
    return (
        F.when((age_min > age) | (age_max < age), "excluded")
        .when(only_children & F.lit(age > 12), "excluded")
        .when(age_min.isNotNull() | age_max.isNotNull(), "eligible")
        .when(F.array_contains(audiences, "teens") & F.lit(13 <= age <= 17), "eligible")
        .when(F.array_contains(audiences, "families"), "eligible")
        .otherwise("unknown")
    )


def runs_over_time(is_run: Column, anytime: Column) -> Column:
    return is_run | anytime


def running_now(start: Column, end: Column, anytime: Column, now: Column) -> Column:
    """A standing offer, or begun and not ended; without an end it isn't running."""
    return anytime | F.coalesce((start <= now) & (end >= now), F.lit(False))


def closes_within(start: Column, end: Column, is_run: Column, anytime: Column, now: Column, days: int) -> Column:
    """Days left (1 at least) of a run that is on now, if no more than `days`; else null."""
    left = F.floor(F.timestamp_diff("SECOND", F.date_trunc("day", now).cast("timestamp_ntz"), end) / 86_400) + 1
    on = is_run & ~anytime & running_now(start, end, anytime, now)
    return F.when(on & (left <= days), F.greatest(left, F.lit(1))).cast("int")


def verification(provenance: Column, verified_on: Column, today: Column, limit: int = 90) -> Column:
    """Of a claim by hand: never, expired (checked over `limit` days ago) or ok; null if it isn't one."""
    return (
        F.when(F.coalesce(provenance, F.lit("")).eqNullSafe("") & verified_on.isNull(), None)
        .when(verified_on.isNull(), "never")
        .when(F.datediff(today, verified_on) > limit, "expired")
        .otherwise("ok")
    )


def is_stale(last_seen: Column, now: Column, hours: int = 48) -> Column:
    return F.coalesce(older(last_seen, now, hours), F.lit(False))


def city_key(online: Column, city: Column) -> Column:
    return F.when(online, "Online").otherwise(F.coalesce(F.nullif(city, F.lit("")), F.lit("Other")))


def price_key(price_from: Column, is_free: Column) -> Column:
    return F.coalesce(price_from, F.when(is_free, 0.0).otherwise(1e9))


def haystack(events: DataFrame) -> Column:
    """What a search looks in: all present text columns and lists, lower-cased."""
    parts = [F.col(c) for c in ("title", "summary", "venue_name", "city", "source_name") if c in events.columns]
    parts += [F.array_join(c, " ") for c in ("careers", "work_styles", "topics") if c in events.columns]
    return F.lower(F.concat_ws(" ", *parts))


def badges(events: DataFrame, age: int, now: Column) -> Column:
    """The ordered badges of a card."""
    c = lambda name, kind="string": F.col(name) if name in events.columns else F.lit(None).cast(kind)
    aud = F.coalesce(c("audiences", "array<string>"), F.array().cast("array<string>"))
    fit = eligibility(c("age_min", "int"), c("age_max", "int"), aud, age) == "eligible"
    left = closes_within(c("start_ts", "timestamp_ntz"), c("end_ts", "timestamp_ntz"), c("ongoing", "boolean"), c("anytime", "boolean"), now, 14)
    young = F.array_contains(aud, "children") & ~F.array_contains(aud, "teens") & F.lit(age >= 13)
    exhib = F.coalesce(c("exhibition", "boolean"), F.lit(False))
    return F.array_compact(F.array(
        F.when(fit, F.coalesce(F.nullif(c("age_text"), F.lit("")), F.lit(f"Suits {age}"))).otherwise("No stated age limit"),
        F.when(young, "aimed at younger children"),
        F.when(c("anytime", "boolean"), "No fixed date").when(c("ongoing", "boolean") & ~exhib, "Runs over several days"),
        F.when(left <= 1, "Last day").when(left.isNotNull(), F.concat(F.lit("Last "), left, F.lit(" days"))),
        F.when(c("is_free", "boolean"), "Free"),
        F.when(c("online", "boolean"), "Online option"),
        F.when(c("status") != "scheduled", F.replace(c("status"), F.lit("_"), F.lit(" "))),
        F.when(c("link_status", "int") != 200, F.concat(F.lit("link "), c("link_status", "int"))),
    ))


def clock_fill(start: Column, end: Column, time_start: Column, time_end: Column) -> tuple[Column, Column]:
    """A midnight start takes the start time of the time text; a missing end its end time, the next day if not after the start.

    time_start and time_end are minutes since midnight."""
    midnight = (F.hour(start) == 0) & (F.minute(start) == 0)
    begin = F.when(midnight & time_start.isNotNull(), F.timestamp_add("MINUTE", time_start, start)).otherwise(start)
    same_day = F.timestamp_add("MINUTE", time_end, F.date_trunc("day", begin).cast("timestamp_ntz"))
    late = F.when(same_day <= begin, F.timestamp_add("DAY", F.lit(1), same_day)).otherwise(same_day)
    return begin, F.coalesce(end, late)


def narrative(*parts: Column) -> Column:
    """Sentences that apply, in order; null if none."""
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def without_empty(events: DataFrame) -> DataFrame:
    """Empty texts and lists as null, so that a JSON writer drops them; false and 0 stay."""
    out = {}
    for name, kind in events.dtypes:
        if kind == "string":
            out[name] = F.nullif(F.col(f"`{name}`"), F.lit(""))
        elif kind.startswith("array"):
            out[name] = F.when(F.size(F.col(f"`{name}`")) > 0, F.col(f"`{name}`"))
    return events.withColumns(out)
