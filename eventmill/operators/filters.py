"""Predicates over events, and joins that filter. Each predicate is one Column, so the optimizer sees them all at once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import is_weekend
from .derive import city_key, eligibility, running_now


def is_current(start: Column, end: Column, anytime: Column, now: Column, grace_hours: int = 6) -> Column:
    """Standing, or an end or a start no more than the grace ago."""
    since = F.timestamp_add("HOUR", F.lit(-grace_hours), now)
    return anytime | F.coalesce(end >= since, F.lit(False)) | F.coalesce(start >= since, F.lit(False))


def within_horizon(start_iso: Column, until_iso: Column) -> Column:
    """Compared as texts; no start is within."""
    return F.coalesce(start_iso, F.lit("")) <= until_iso


def in_window(start: Column, end: Column, since: Column | None, until: Column | None) -> Column:
    """The event overlaps the window; one without a start passes."""
    p = F.lit(True)
    if until is not None:
        p = p & (start <= until)
    if since is not None:
        p = p & (F.coalesce(end, start) >= since)
    return start.isNull() | F.coalesce(p, F.lit(False))


def window_bounds(when: str, now: str, since: str = "", until: str = "") -> tuple[Column, Column | None]:
    """Bounds of `when` (a number of days, all or custom) by the London clock."""
    today = date.fromisoformat(now[:10])
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    begin = at(f"{since} 00:00:00") if when == "custom" and since else at(f"{today} 00:00:00")
    if when == "all":
        return begin, None
    if when == "custom":
        return begin, at(f"{until} 23:59:59") if until else None
    return begin, at(f"{today + timedelta(days=int(when))} 00:00:00")


def kind_is(kind: str, is_run: Column, anytime: Column) -> Column:
    return {"once": ~(is_run | anytime), "running": is_run | anytime}.get(kind, F.lit(True))


def any_of(values: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def in_city(online: Column, city: Column, wanted: list[str]) -> Column:
    return city_key(online, city).isin(wanted) if wanted else F.lit(True)


def age_allows(age_min: Column, age_max: Column, audiences: Column, age: int, eligible_only: bool = False) -> Column:
    state = eligibility(age_min, age_max, audiences, age)
    return state == "eligible" if eligible_only else state != "excluded"


def is_free(free: Column) -> Column:
    """Known to be free: unknown isn't."""
    return free.eqNullSafe(True)


def on_weekend(start: Column, exhibition: Column) -> Column:
    return start.isNull() | exhibition | is_weekend(start)


def has_all_terms(text: Column, query: str) -> Column:
    """Every term of the query, by white space, occurs in the lower-cased text."""
    p = F.lit(True)
    for term in query.lower().split():
        p = p & F.contains(text, F.lit(term))
    return p


def safe_url(url: Column) -> Column:
    """URLs with a scheme that a link may have; else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)


def calendar_able(start: Column, anytime: Column) -> Column:
    return ~anytime & start.isNotNull()


def without_hidden(events: DataFrame, hidden: DataFrame, saved_only: bool = False) -> DataFrame:
    return events if saved_only else events.join(hidden.select("id"), "id", "left_anti")


def only_saved(events: DataFrame, saved: DataFrame) -> DataFrame:
    return events.join(saved.select("id"), "id", "left_semi")


def page(events: DataFrame, name: str) -> DataFrame:
    """One of the two disjoint pages: exhibitions, or all else."""
    own = F.coalesce(F.col("exhibition"), F.lit(False))
    return events.filter(own if name == "exhibitions" else ~own)


def drop_kind(good: Column, n: Column, tolerance: float = 0.5) -> Column:
    """empty, shrunk (under `tolerance` of the baseline) or null."""
    return F.when((good > 0) & (n == 0), "empty").when((good > 0) & (n < good * tolerance), "shrunk")


def on_now(events: DataFrame, now: Column) -> Column:
    return running_now(F.col("start_ts"), F.col("end_ts"), F.col("anytime"), now)
