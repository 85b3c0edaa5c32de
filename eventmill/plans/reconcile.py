"""Reconciliation of a run with the last snapshot, so that a source that fails degrades instead of disappearing.

Everything is per source: counts of the run and the last report meet in one row (`metrics`), one CASE gives the status, and two filtered
joins put together what is published: candidates of sources in order, the last rows of the others.  Sources are few; events are
dealt by source or id, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import derive, filters, resolve

#: Statuses whose last rows are kept, in place of the run's.
KEEPS_LAST = ("empty", "shrunk", "partial", "fetch_error")


def candidates(events: DataFrame, now: Column, horizon_iso: Column) -> DataFrame:
    """Rows of a run that are current and within the horizon."""
    return events.filter(filters.is_current(F.col("start_ts"), F.col("end_ts"), F.col("anytime"), now) & filters.within_horizon(F.col("start"), horizon_iso))


def metrics(sources: DataFrame, fetched: DataFrame, candidate: DataFrame, last: DataFrame) -> DataFrame:
    """A row a source: fetched, candidate counts, and the last report's baseline (last_good_count, else its count if it was ok)."""
    n = lambda df, name: df.groupBy(F.col("source").alias("key")).agg(F.count("*").alias(name))
    good = F.coalesce("last_good_count", F.when(F.col("status") == "ok", F.col("count")), F.lit(0))
    prev = last.select("key", good.alias("good"), F.col("last_success").alias("prev_success"), F.col("count").alias("prev_count"))
    out = sources.join(n(fetched, "fetched"), "key", "left").join(n(candidate, "n"), "key", "left").join(prev, "key", "left")
    return out.fillna(0, ["fetched", "n", "good", "prev_count"])


def status(good: Column, n: Column, error: Column, reachable: Column, expected_missing: Column, complete: Column) -> Column:
    """The first that applies; unknown reachability and completeness count as fine."""
    return (
        F.when(error.isNotNull(), "fetch_error")
        .when(reachable.eqNullSafe(False), "blocked")
        .when(F.coalesce(expected_missing, F.lit(0)) > 0, "unconfirmed")
        .when(filters.drop_kind(good, n).isNotNull(), filters.drop_kind(good, n))
        .when(complete.eqNullSafe(False), "partial")
        .otherwise("ok")
    )


def reports(m: DataFrame, stamp: Column, allow_drop: bool = False) -> DataFrame:
    """Reports of a run from its metrics (with error, reachable, expected_missing, complete)."""
    raw = status(F.col("good"), F.col("n"), F.col("error"), F.col("reachable"), F.col("expected_missing"), F.col("complete"))
    m = m.withColumn("raw_status", raw)
    accepted = F.lit(allow_drop) & F.col("raw_status").isin("empty", "shrunk") & ~F.col("complete").eqNullSafe(False)
    m = m.withColumn("accepted", accepted).withColumn("status", F.when(F.col("accepted"), "ok").otherwise(F.col("raw_status")))
    keeps, fine = F.col("status").isin(*KEEPS_LAST), F.col("status") == "ok"
    warn = F.when(fine | (F.col("status") == "blocked"), None).when(F.col("status") == "partial", F.concat(F.col("key"), F.lit(": pagination incomplete"))).when(
        F.col("status").isin("empty", "shrunk"), F.concat(F.col("key"), F.lit(": returned "), F.col("n"), F.lit(" events, last good count was "), F.col("good"))
    ).when(F.col("status") == "fetch_error", F.concat(F.col("key"), F.lit(": "), "error")).otherwise(F.concat(F.col("key"), F.lit(": the page no longer mentions what it is about")))
    return m.select(
        "key", "status", F.when(keeps, F.col("prev_count")).otherwise(F.col("n")).alias("count"), F.col("n").alias("candidate_count"), "fetched",
        F.when(fine, stamp).otherwise(F.col("prev_success")).alias("last_success"), F.when(fine, F.col("n")).otherwise(F.col("good")).alias("last_good_count"),
        keeps.alias("carried"), "accepted", F.when(F.col("accepted"), F.col("good")).alias("dropped_from"), warn.alias("warning"),
    )


def publish(candidate: DataFrame, last_events: DataFrame, report: DataFrame, now: Column, stamp: Column, sources: DataFrame | None = None) -> DataFrame:
    """What a run publishes: merged candidates of sources in order, and last rows of the others that are still current and not published again.

    sources: key and priority, and exhibition_topics by which carried rows are flagged anew."""
    state = report.select(F.col("key").alias("source"), "carried")
    fresh = candidate.join(state.filter("NOT carried"), "source", "left_semi").withColumn("last_seen", stamp)
    fresh = resolve.merge_duplicates(fresh)
    kept = last_events.join(state.filter("carried"), "source", "left_semi").filter(filters.is_current(F.col("start_ts"), F.col("end_ts"), F.col("anytime"), now))
    kept = kept.join(fresh.select("id"), "id", "left_anti")
    if sources is not None and "exhibition_topics" in sources.columns:
        kept = kept.join(sources.select(F.col("key").alias("source"), "exhibition_topics"), "source", "left")
        kept = kept.withColumn("exhibition", derive.exhibition(F.col("ongoing"), F.col("anytime"), F.col("topics"), F.col("exhibition_topics"))).drop("exhibition_topics")
    return fresh.withColumn("carried", F.lit(False)).unionByName(kept.withColumn("carried", F.lit(True)), allowMissingColumns=True)


def carry_expired(last_events: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    """source, expired: carried rows that are no longer current."""
    rows = last_events.join(report.filter("carried").select(F.col("key").alias("source")), "source", "left_semi")
    old = ~filters.is_current(F.col("start_ts"), F.col("end_ts"), F.col("anytime"), now)
    return rows.groupBy("source").agg(F.count_if(old).alias("expired"))


def warnings(report: DataFrame) -> DataFrame:
    """One row: the warnings, in order of source."""
    return report.agg(F.array_sort(F.collect_list("warning")).alias("build_warnings"))


def freshness(report: DataFrame, generated_at: Column, now: Column, hours: int = 48) -> DataFrame:
    """One row: the oldest success, and whether the page itself is too old."""
    late = clock.older(generated_at, now, hours)
    return report.agg(F.min("last_success").alias("oldest_success"), F.count_if(F.col("status") != "ok").alias("degraded")).withColumn("late", late)


def retag(events: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Careers from a cache of labels by key: no entry keeps the keywords', an empty one clears them."""
    c = cache.select(F.col("key").alias("_ck"), F.col("labels").alias("_labels"))
    return events.withColumn("_k", key).join(c, F.col("_k") == F.col("_ck"), "left").withColumn("careers", F.coalesce("_labels", "careers")).drop("_k", "_ck", "_labels")


def to_classify(events: DataFrame, cache: DataFrame, key: Column, model: str, version: str, most: int | None = None) -> DataFrame:
    """key, title, summary of texts that the cache lacks; entries of other models or prompts don't count. most: a budget."""
    live = cache.filter((F.col("model") == model) & (F.col("prompt_version") == version)).select("key")
    out = events.withColumn("key", key).select("key", "title", "summary").dropDuplicates(["key"]).join(live, "key", "left_anti")
    return out.orderBy("key").limit(most) if most else out


def probe(events: DataFrame, probes: DataFrame) -> DataFrame:
    """Link states of entries by hand. probes: url, http_status, final_url; a URL is probed once however many rows have it."""
    from ..functions.text import to_root

    p = probes.dropDuplicates(["url"]).select("url", F.col("http_status").alias("_st"), F.when(F.col("final_url").isNotNull() & to_root(F.col("url"), F.col("final_url")), "redirects to the site's front page").alias("link_warning"))
    return events.join(p, "url", "left").withColumn("link_status", F.coalesce("_st", "link_status")).drop("_st")
