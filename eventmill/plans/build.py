"""One collection run from raw documents to a published snapshot, and its command line."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import instant_utc, iso, london
from ..schema import EVENT_COLUMNS, REPORT_SCHEMA
from ..sources import scans
from . import reconcile, sinks
from .storage import exists, settle


def with_clocks(events: DataFrame) -> DataFrame:
    """London wall clocks beside the ISO texts of start and end."""
    return events.withColumns({"start_ts": london(instant_utc(F.col("start"))), "end_ts": london(instant_utc(F.col("end")))})


def build(docs: DataFrame, sources: list[dict], last_events: DataFrame, last_reports: DataFrame, now: str, only: set[str] | None = None, allow_drop: bool = False, fetch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and reports of a run. fetch: what is known of each source's fetch (key, error, reachable, expected_missing, complete).

    With `only`, other sources' last rows aren't carried."""
    spark = docs.sparkSession
    used = [s for s in sources if not only or s["key"] in only]
    rows = [(s["key"], s.get("priority", 50), list(s.get("exhibition_topics", []))) for s in used]
    reg = spark.createDataFrame(rows, "key string, priority int, exhibition_topics array<string>")
    known = fetch if fetch is not None else spark.createDataFrame([], "key string, error string, reachable boolean, expected_missing int, complete boolean")
    local = F.lit(now[:19].replace("T", " ")).cast("timestamp_ntz")
    found = settle(with_clocks(scans.scan_all(docs, used, now)).join(F.broadcast(reg.select(F.col("key").alias("source"), "priority", "exhibition_topics")), "source", "left"))
    found = found.withColumn("exhibition", F.col("ongoing") & ~F.col("anytime") & F.arrays_overlap("topics", "exhibition_topics")).drop("exhibition_topics")
    candidate = reconcile.candidates(found, local, iso(F.timestamp_add("DAY", F.lit(400), local)))
    m = reconcile.metrics(reg.select("key").join(known, "key", "left"), found, candidate, last_reports)
    report = settle(reconcile.reports(m, F.lit(now), allow_drop))
    out = reconcile.publish(candidate, with_clocks(last_events), report, local, F.lit(now), reg)
    return out.select(*EVENT_COLUMNS, "carried").orderBy(F.coalesce("start", F.lit("9999")), "title", "id"), report


def clock_now(spark: SparkSession) -> str:
    """The time in London as ISO text, for command lines only: plans take it as an argument."""
    utc = F.lit(datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return spark.range(1).select(iso(london(utc)).alias("now")).first()["now"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Scan staged documents, reconcile with the last snapshot, publish.")
    p.add_argument("--documents", required=True, help="JSON lines of source, page, raw")
    p.add_argument("--registry", required=True)
    p.add_argument("--snapshot", required=True)
    p.add_argument("--only", nargs="*")
    p.add_argument("--allow-drop", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("eventmill").getOrCreate()
    now = clock_now(spark)
    first = not exists(spark, f"{a.snapshot}/sources")
    reports = spark.createDataFrame([], REPORT_SCHEMA) if first else spark.read.schema(REPORT_SCHEMA).json(f"{a.snapshot}/sources")
    docs = spark.read.schema("source string, page int, raw string").json(a.documents)
    events, report = build(docs, scans.registry(spark, a.registry), scans.snapshot(spark, a.snapshot), settle(reports), now, set(a.only or []), a.allow_drop)
    sinks.write_snapshot(settle(events).drop("carried"), report, a.snapshot, {"generated_at": now})
    return sinks.exit_code(report, a.allow_drop)


if __name__ == "__main__":
    raise SystemExit(main())
