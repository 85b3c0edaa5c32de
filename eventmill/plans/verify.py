"""Verification of sources and of entries written by hand."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_date, to_root
from ..operators.derive import verification

#: Fixed rules.
BLOCKED_CODES, LIMIT_DAYS = (401, 403, 429), 90
REQUIRED = ("key", "name", "kind", "homepage", "verify_url", "docs", "terms", "verified")


def entry_state(http_status: Column, to_root: Column, verified_on: Column, today: Column, limit: int = LIMIT_DAYS) -> Column:
    """blocked, broken, redirected (to the site's root), never, expired or ok: the first that applies. Without a probe (null status) only the date counts."""
    return (
        F.when(http_status.isin(*BLOCKED_CODES), "blocked")
        .when(http_status.isNotNull() & (http_status != 200), "broken")
        .when(F.coalesce(to_root, F.lit(False)), "redirected")
        .when(verified_on.isNull(), "never")
        .when(F.datediff(today, verified_on) > limit, "expired")
        .otherwise("ok")
    )


def roll_up(entries: DataFrame, today: Column, limit: int = LIMIT_DAYS) -> DataFrame:
    """Per source: entries, verified, unverified, overdue, ok (all verified)."""
    state = verification(F.lit("claim"), F.col("verified_on"), today, limit)
    fresh = state == "ok"
    return entries.groupBy("source").agg(
        F.count("*").alias("entries"), F.count_if(fresh).alias("verified"), F.count_if(~fresh).alias("unverified"),
        F.count_if(state == "expired").alias("overdue"), F.bool_and(fresh).alias("ok"),
    )


def to_do(entries: DataFrame) -> DataFrame:
    """Entries by state, but those that are ok."""
    return entries.filter("state != 'ok'").groupBy("state").agg(F.count("*").alias("n")).orderBy("state")


def contract(sources: DataFrame) -> DataFrame:
    """key, problems: what a source's registration lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0, F.lit(f"no {c}")) for c in REQUIRED if c in sources.columns]))
    missing = [F.lit(f"no {c}") for c in REQUIRED if c not in sources.columns]
    return sources.select("key", F.concat(lacks, F.array(*missing).cast("array<string>")).alias("problems"))


def verdict(checks: DataFrame) -> DataFrame:
    """PASS, PASS* (only notes) or FAIL. checks: source, problems array<string>, notes array<string>."""
    return checks.select("source", F.when(F.size("problems") > 0, "FAIL").when(F.size("notes") > 0, "PASS*").otherwise("PASS").alias("verdict"), F.array_join("problems", "; ").alias("problems"), F.array_join("notes", "; ").alias("notes"))


def source_checks(sources: DataFrame, scanned: DataFrame, pages: DataFrame, today: Column, limit: int = LIMIT_DAYS) -> DataFrame:
    """source, problems, notes: whether a source's registration is whole, it can be reached, its documents give events, and it was looked at lately.

    sources: key, kind, verified and more, with expect_events and allow_blocked (booleans) where they are set; scanned: source of each event;
    pages: source, http_status."""
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in sources.columns else F.lit(default)
    seen = pages.groupBy("source").agg(F.max(F.when(F.col("http_status") == 200, 1)).alias("_good"), F.max(F.col("http_status").isin(*BLOCKED_CODES)).alias("_barred"), F.max("http_status").alias("_status"))
    events = scanned.groupBy("source").agg(F.count("*").alias("_events"))
    s = sources.join(contract(sources), "key").join(seen.withColumnRenamed("source", "key"), "key", "left").join(events.withColumnRenamed("source", "key"), "key", "left")
    barred = F.coalesce("_barred", F.lit(False)) & F.col("_good").isNull()
    excused = barred & flag("allow_blocked", False)
    verified = F.col("verified").cast("string").try_cast("date") if "verified" in sources.columns else F.lit(None).cast("date")
    missing = F.coalesce(F.concat(F.lit("HTTP "), F.col("_status").cast("string")), F.lit("no answer"))
    problems = F.array_compact(F.array(
        F.when(F.col("_good").isNull() & ~excused, F.concat(F.lit("not reachable: "), missing)),
        F.when(F.col("_events").isNull() & flag("expect_events", True) & ~excused, "no events found"),
    ))
    notes = F.array_compact(F.array(
        F.when(excused, "refuses robots; checked by hand"),
        F.when(F.datediff(today, verified) > limit, F.concat(F.lit("registration last verified "), F.datediff(today, verified), F.lit(" days ago"))),
    ))
    return s.select(F.col("key").alias("source"), F.concat("problems", problems).alias("problems"), notes.alias("notes"))


def checklist(entries: DataFrame) -> list[str]:
    """A line to tick for each entry by hand that isn't ok. entries: title, url, state; they are few, being written by hand."""
    rows = sorted(entries.filter("state != 'ok'").select("title", "url", "state").toLocalIterator(), key=lambda r: (r["state"], r["title"]))
    return [f"- [ ] **{r['title']}** ({r['state']}): open {r['url']}, confirm dates, price and ages, then renew verified_on" for r in rows]


def report_json(checks: DataFrame) -> str:
    rows = sorted((r.asDict() for r in verdict(checks).toLocalIterator()), key=lambda r: r["source"])
    return json.dumps({"ok": all(r["verdict"] != "FAIL" for r in rows), "sources": rows}, indent=1)


def main(argv: list[str] | None = None) -> int:
    from ..sources import scans
    from .build import clock_now

    p = argparse.ArgumentParser(description="Check each source: its registration, its pages, the events in them, and entries by hand.")
    p.add_argument("--registry", required=True)
    p.add_argument("--documents", required=True, help="JSON lines of source, page, raw, http_status")
    p.add_argument("--entries", help="JSON lines of entries by hand: title, url, http_status, final_url, verified_on")
    p.add_argument("--only", nargs="*")
    p.add_argument("--json", action="store_true")
    p.add_argument("--markdown", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("eventmill").getOrCreate()
    now = clock_now(spark)
    today = F.lit(now[:10]).cast("date")
    known = [s for s in scans.registry(spark, a.registry) if not a.only or s["key"] in a.only]
    docs = spark.read.schema("source string, page int, raw string, http_status int").json(a.documents)
    rows = [tuple(str(s.get(c) or "") for c in REQUIRED) + (bool(s.get("expect_events", True)), bool(s.get("allow_blocked", False))) for s in known]
    sources = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in REQUIRED) + ", expect_events boolean, allow_blocked boolean")
    checks = source_checks(sources, scans.scan_all(docs.select("source", "page", "raw"), known, now), docs, today)
    print(report_json(checks) if a.json else report_text(checks, a.markdown))
    if a.entries and not a.json:
        e = spark.read.schema("title string, url string, http_status int, final_url string, verified_on string").json(a.entries)
        e = e.withColumn("state", entry_state(F.col("http_status"), to_root(F.col("url"), F.col("final_url")), iso_date(F.col("verified_on")), today))
        print("\n".join(checklist(e) or ["Nothing to check again."]))
    return int(bool(checks.filter(F.size("problems") > 0).limit(1).count()))


def report_text(checks: DataFrame, markdown: bool = False) -> str:
    """A line for each source. Bounded by the registry, which is a driver-side list."""
    rows = sorted(verdict(checks).toLocalIterator(), key=lambda r: r["source"])
    line = "| {verdict} | {source} | {problems} | {notes} |" if markdown else "{verdict:5} {source}  {problems} {notes}"
    head = ["| verdict | source | problems | notes |", "|-|-|-|-|"] if markdown else []
    return "\n".join([*head, *(line.format(**r.asDict()).rstrip() for r in rows)])


if __name__ == "__main__":
    raise SystemExit(main())
