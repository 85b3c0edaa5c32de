"""Queries over fixed cases: the parsers of prose. Each case states its input and the result expected; the SQL is the table of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import ages, clock, ical, prices, prose, text
from .plans.verify import entry_state
from .taxonomy import careers, work_styles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TODAY = "2026-06-01"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)


def golden(name: str, given: str, result: str, cases: list[tuple], make) -> None:
    """given and result: DDL of the inputs and results; cases: their values in a row; make: DataFrame of inputs -> with the results."""
    names = [f.split()[0] for f in given.split(",")] + [f.split()[0] for f in result.split(",")]
    kinds = [f.split()[1] for f in given.split(",")] + [f.split()[1] for f in result.split(",")]
    sql = {"string": "VARCHAR", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    n = len(given.split(","))

    def run(spark, sf_dir):
        return make(spark.createDataFrame([c[:n] for c in cases], given)).select(*names)

    QUERIES[name] = run
    cast = ", ".join(f"CAST({c} AS {sql[k]}) AS {c}" for c, k in zip(names, kinds, strict=True))
    ORACLE[name] = f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, c)) + ')' for c in cases)}) t({', '.join(names)})"


golden("parse_ages", "text string", "age_min int, age_max int", [
    ("Suitable for ages 11-16", 11, 16), ("Young people 13+", 13, None), ("Children 12 and under", None, 12), ("under 14s", None, 13), ("up to 14", None, 13),
    ("under-14s are not admitted", 14, None), ("no under 16s", 16, None), ("Under 16s must be accompanied by an adult", None, None), ("10-12 June; ages 14+", 14, None),
    ("14+; under 10s only", 14, None), ("Under 16s must be accompanied; under 5s are not admitted", 5, None), ("a lovely evening talk", None, None), ("8 - 12 year olds", 8, 12),
    ("", None, None), (None, None, None),
], lambda d: d.withColumn("r", ages.age_range(F.col("text"))).withColumns({"age_min": F.col("r.low"), "age_max": F.col("r.high")}))

golden("audience_union", "labels string", "age_min int, age_max int, audiences string", [
    ("12+|Adults (18+)|All ages|Families", None, None, "adults|children|families|teens"), ("Adults (18+)", 18, None, "adults"), ("5-11", 5, 11, "children"),
    ("12+", 12, None, "adults|children|teens"), ("", None, None, ""), ("Children 12 and under|Families|Young people 13+", None, None, "children|families|teens"),
], lambda d: d.withColumn("r", ages.audience_union(F.split("labels", r"\|"))).withColumns({"age_min": F.col("r.low"), "age_max": F.col("r.high"), "audiences": F.array_join("r.audiences", "|")}))

golden("map_audience", "label string", "audience string", [
    ("Young  People 13+", "teens"), ("FAMILY", "families"), ("School groups", "schools"), ("Suitable for adults only", "adults"), ("nobody", None), ("", None), ("Youth event", "teens"),
], lambda d: d.withColumn("audience", text.map_audience(F.col("label"))))

golden("parse_times", "text string", "start_min int, end_min int", [
    ("7.00pm - 8.30pm", 1140, 1230), ("11.30am", 690, None), ("7 - 8.30pm", 1140, 1230), ("7.00 - 8.30pm", 1140, 1230), ("Doors 6pm; talk 7pm-8pm", 1140, 1200),
    ("10.00am-4.00pm", 600, 960), ("all afternoon", None, None), ("7 - 8am - 9pm", 420, 480), ("Tuesday 20 October 10.30", 630, None),
    ("Monday 16 18.30 - Monday 23 November 18.30", 1110, 1110), ("12am", 0, None), ("19:00 - 8.30pm", 1140, 1230), ("7", None, None), (None, None, None),
], lambda d: d.withColumn("r", prose.times(F.col("text"))).withColumns({"start_min": F.col("r.start_min"), "end_min": F.col("r.end_min")}))

golden("parse_dates", "text string", "iso string", [
    ("2026-06-01T12:00:00+05:00", "2026-06-01T08:00:00+01:00"), ("17/01/2026", "2026-01-17T00:00:00+00:00"), ("2026-07-01 19:00", "2026-07-01T19:00:00+01:00"),
    ("2026-03-29T01:30:00", "2026-03-29T02:30:00+01:00"), ("2026-10-25T01:30:00", "2026-10-25T01:30:00+01:00"), ("2026-06-01T12:00:00Z", "2026-06-01T13:00:00+01:00"),
    ("Tuesday 20 October 10.30", "2026-10-20T10:30:00+01:00"), ("28th October 2026", "2026-10-28T00:00:00+00:00"), ("Exhibition 10th September 2026", "2026-09-10T00:00:00+01:00"),
    ("Most Fridays at 11.30", None), ("Throughout 2026", None), ("Daily", None), ("not a date", None), ("", None), (None, None), ("17.01.2026", "2026-01-17T00:00:00+00:00"),
], lambda d: d.withColumn("iso", prose.single_dates(F.col("text"), TODAY)))

golden("date_ranges", "text string", "start_iso string, end_iso string", [
    ("10th September–31st October 2026", "2026-09-10T00:00:00+01:00", "2026-10-31T00:00:00+00:00"), ("7 Oct - 14 Feb 2027", "2026-10-07T00:00:00+01:00", "2027-02-14T00:00:00+00:00"),
    ("12 – 30 October 2026", "2026-10-12T00:00:00+01:00", "2026-10-30T00:00:00+00:00"), ("17/01/2026 - 31/12/2026", "2026-01-17T00:00:00+00:00", "2026-12-31T00:00:00+00:00"),
    ("1 October 2026 1.05pm - 2pm", "2026-10-01T13:05:00+01:00", None), ("27 December - 5 January", "2026-12-27T00:00:00+00:00", "2027-01-05T00:00:00+00:00"),
    ("2026-01-01 - 2026-03-01", "2026-01-01T00:00:00+00:00", "2026-03-01T00:00:00+00:00"), ("2027-10-01T09:00:00+01:00", "2027-10-01T09:00:00+01:00", None),
    ("2026-05-01/2026-06-30", "2026-05-01T00:00:00+01:00", "2026-06-30T00:00:00+01:00"), ("On now until Saturday, 28 November 2026", "2026-06-01T00:00:00+01:00", "2026-11-28T00:00:00+00:00"),
    ("28th October 2026", "2026-10-28T00:00:00+00:00", None), ("Monday – Thursday, 2 November 2026 – 18 June 2027, London", None, None),
    ("Wednesday 23 September 2026 6pm - 7.30pm", "2026-09-23T18:00:00+01:00", None), ("", None, None), (None, None, None),
], lambda d: d.withColumn("r", prose.ranges(F.col("text"), TODAY)).withColumns({"start_iso": F.col("r.start"), "end_iso": F.col("r.end")}))

golden("yearless_dates", "text string", "start_iso string, end_iso string", [
    ("Saturday 3 January", "2027-01-03T00:00:00+00:00", None), ("Saturday 3 May", "2026-05-03T00:00:00+01:00", None), ("3 January 2026", "2026-01-03T00:00:00+00:00", None),
    ("2 Jan - 9 Jan", "2027-01-02T00:00:00+00:00", "2027-01-09T00:00:00+00:00"),
], lambda d: d.withColumn("r", prose.ranges(F.col("text"), TODAY, True)).withColumns({"start_iso": F.col("r.start"), "end_iso": F.col("r.end")}))

golden("price_info", "text string", "is_free boolean, price_from double, currency string", [
    ("Free", True, 0.0, None), ("Not free", None, None, None), ("£1,200", False, 1200.0, "GBP"), ("£0 child; £25 adult", False, 0.0, "GBP"), ("£16/£10/£7 Members", False, 7.0, "GBP"),
    ("$15 / £10", False, 10.0, "GBP"), ("Free for under 12s", None, None, None), ("Free entry", True, 0.0, None), ("€9.50", False, 9.5, "EUR"), ("members go free", None, None, None),
    ("", None, None, None), (None, None, None, None), ("£0", True, 0.0, "GBP"), ("donations welcome", None, None, None),
], lambda d: d.withColumn("r", prices.price_info(F.col("text"))).withColumns({c: F.col(f"r.{c}") for c in ("is_free", "price_from", "currency")}))

golden("phrase_confirmed", "text string, phrase string, unless string", "ok boolean", [
    ("The gallery is open to the public on weekdays.", "open to the public", "", True), ("It is no longer open to the public.", "open to the public", "", False),
    ("Tours are free. " + "x " * 100 + "This was suspended.", "Tours are free", "", True), ("Open to all, but closed for works", "open to all", "closed for works", False),
    ("No longer free. " + "y " * 100 + " Entry is free.", "free", "", True), ("nothing here", "free", "", False), (None, "free", "", False),
], lambda d: d.withColumn("ok", text.phrase_confirmed(F.col("text"), F.col("phrase"), F.filter(F.split("unless", r"\|"), lambda x: x != ""))))

golden("career_cases", "text string", "careers string", [
    ("The Operating Theatre: 250 Years of Surgery", "Medicine & health"), ("Stage Design Lab light, sound and theatre design", "Arts & performance|Design, making & architecture"),
    ("A relaxed session for sensory needs", ""), ("AI and the law", "Computing & AI|Law & justice"), ("Start the party", ""), (None, ""), ("", ""),
], lambda d: d.withColumn("careers", F.array_join(careers(F.col("text")), "|")))

golden("work_styles", "text string", "styles string", [
    ("Battery research: designing and modelling new materials", "Data & quantitative analysis|Design & making|Research & discovery"), ("An evening lecture", ""), (None, ""),
    ("Guided tour of the garden", "Fieldwork & outdoors|Working with people"),
], lambda d: d.withColumn("styles", F.array_join(work_styles(F.col("text")), "|")))

golden("localise_dst", "wall string", "iso string", [
    ("2026-03-29 01:30:00", "2026-03-29T02:30:00+01:00"), ("2026-07-01 19:00:00", "2026-07-01T19:00:00+01:00"), ("2026-10-25 01:30:00", "2026-10-25T01:30:00+01:00"), ("2026-12-01 09:00:00", "2026-12-01T09:00:00+00:00"),
], lambda d: d.withColumn("iso", clock.iso(F.col("wall").cast("timestamp_ntz"))))

golden("shift_local", "wall string, days int", "iso string", [
    ("2026-03-28 12:00:00", 1, "2026-03-29T12:00:00+01:00"), ("2026-10-24 12:00:00", 1, "2026-10-25T12:00:00+00:00"), ("2026-03-28 01:30:00", 1, "2026-03-29T02:30:00+01:00"),
], lambda d: d.withColumn("iso", clock.iso(clock.shift(F.col("wall").cast("timestamp_ntz"), "DAY", F.col("days")))))

golden("instants", "text string", "utc string", [
    ("2026-06-01T12:00:00+05:00", "2026-06-01 07:00:00"), ("2026-06-01T12:00:00Z", "2026-06-01 12:00:00"), ("2026-06-01T12:00:00", "2026-06-01 11:00:00"), ("2026-01-01", "2026-01-01 00:00:00"), ("soon", None), (None, None),
], lambda d: d.withColumn("utc", F.date_format(clock.instant_utc(F.col("text")), "yyyy-MM-dd HH:mm:ss")))

golden("roll_year", "wall string, yearless boolean", "rolled string", [
    ("2024-02-29 10:00:00", True, "2025-02-28 10:00:00"), ("2026-05-01 10:00:00", True, "2026-05-01 10:00:00"), ("2024-02-29 10:00:00", False, "2024-02-29 10:00:00"),
], lambda d: d.withColumn("rolled", F.date_format(clock.roll_year(F.col("wall").cast("timestamp_ntz"), F.col("yearless"), F.lit(f"{TODAY} 12:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")))

golden("ical_duration", "text string", "minutes int", [
    ("P1D", 1440), ("PT1H30M", 90), ("P1DT2H", 1560), ("PT45M", 45), ("1 hour", None), ("", None), (None, None),
], lambda d: d.withColumn("minutes", ical.duration_minutes(F.col("text"))))

golden("entry_states", "http_status int, to_root boolean, checked string", "state string", [
    (200, False, "2026-05-01", "ok"), (200, False, None, "never"), (200, False, "2025-12-01", "expired"), (403, False, "2026-05-01", "blocked"), (404, False, "2026-05-01", "broken"),
    (200, True, "2026-05-01", "redirected"), (None, None, "2026-05-01", "ok"), (429, True, None, "blocked"), (200, None, "2026-03-03", "ok"), (200, None, "2026-03-02", "expired"),
], lambda d: d.withColumn("state", entry_state(F.col("http_status"), F.col("to_root"), text.iso_date(F.col("checked")), F.lit(TODAY).cast("date"))))

golden("iso_dates", "text string", "day string", [("2026-05-01T10:00:00", "2026-05-01"), ("2026-02-30", None), ("soon", None), (None, None)], lambda d: d.withColumn("day", text.iso_date(F.col("text")).cast("string")))

golden("links", "base string, link string", "url string", [
    ("https://a.org/x/y?p=1", "/z", "https://a.org/z"), ("https://a.org/x/y", "z", "https://a.org/x/z"), ("https://a.org", "z", "https://a.org/z"), ("https://a.org/x", "//b.org/z", "https://b.org/z"),
    ("https://a.org/x", "http://c.org", "http://c.org"), ("https://a.org/x?q=1", "?page=2", "https://a.org/x?page=2"),
], lambda d: d.withColumn("url", text.absolute(F.col("base"), F.col("link"))))

golden("root_redirects", "asked string, got string", "lost boolean", [
    ("https://a.org/tours", "https://a.org/", True), ("https://a.org/tours", "https://a.org/tours/", False), ("https://a.org/", "https://a.org", False), ("https://a.org/x", "https://www.a.org", True),
], lambda d: d.withColumn("lost", text.to_root(F.col("asked"), F.col("got"))))

golden("model_replies", "reply string", "labels string", [
    ('Sure: ["Law & justice", "Arts & performance - because", "Nonsense"]', "Law & justice|Arts & performance"), ("unclear", None), ('["unclear"]', ""),
    ('[{"label": "Law & justice"}, {"label": "Law & justice"}]', "Law & justice"), ("[]", ""), (None, None),
], lambda d: d.withColumn("labels", F.array_join(text.labels_of_reply(F.col("reply"), ["Law & justice", "Arts & performance", "Engineering"]), "|")))
