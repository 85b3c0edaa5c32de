"""The engine's own operators: every query against its SQL, invariants, and the parts that queries don't reach."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from eventmill import registry
from eventmill.catalogue_queries import events, flagged
from eventmill.operators import filters, resolve
from eventmill.plans import build, query, sinks, verify
from eventmill.run_queries import FEED, HTML, ICS, LISTING, VENUE
from eventmill.schema import EVENT_COLUMNS, EVENT_SCHEMA, REPORT_SCHEMA
from eventmill.sources import scans
from eventmill.sources.markup import pick, tree
from eventmill.streaming import runs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NOW = "2026-06-01T12:00:00+01:00"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


DIGITS = 9  # significant ones of a number that must agree


def plain(v):
    if v is None:
        return "\0null"
    return f"{float(v):.{DIGITS}g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(got.columns)
    cols = sorted(rel.columns)
    want = [tuple(map(plain, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(want)


def test_kinds_and_pages_partition(spark):
    e = flagged(spark, SF)
    run, anytime = F.col("ongoing"), F.col("anytime")
    n = e.count()
    assert e.filter(filters.kind_is("once", run, anytime)).count() + e.filter(filters.kind_is("running", run, anytime)).count() == n
    assert filters.page(e, "exhibitions").count() + filters.page(e, "events").count() == n


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey = 5").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan
    plan = events(spark, SF).select("id", "city")._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan and "l_tax" not in plan


def test_query_text_round_trip():
    q = query.QuerySpec(q="deep sea", age=12, cities=frozenset({"Leeds", "Online"}), flags=frozenset({"free"}))
    assert query.QuerySpec.from_params(q.to_params()) == q and query.QuerySpec().to_params() == ""
    assert query.QuerySpec.from_params("age=x&nothing=1") == query.QuerySpec()


EVENT = {"id": "a-1", "title": "The Talk", "source": "a", "url": "u", "start": "2026-06-05T19:00:00+01:00", "anytime": False, "ongoing": False, "city": "Leeds", "status": "scheduled", "online": False}


def rows(spark, *changes):
    return spark.createDataFrame([tuple({**EVENT, **c}.get(k) for k in EVENT_COLUMNS) for c in changes], EVENT_SCHEMA)


def test_merge_contract(spark):
    e = rows(spark, {"source": "b", "id": "b-1", "price_text": "£5", "is_free": False, "price_from": 5.0, "topics": ["z", "a"], "age_max": 9}, {"topics": ["m"], "age_min": 0}, {"id": "c-1", "title": "Talk (BSL)"}, {"id": "d-1", "start": None}, {"id": "d-2", "start": None})
    got = {r.id: r for r in resolve.merge_duplicates(e, F.when(F.col("source") == "a", 1)).collect()}
    assert sorted(got) == ["a-1", "c-1", "d-1", "d-2"]
    m = got["a-1"]
    assert (m.price_text, m.is_free, m.price_from) == ("£5", False, 5.0) and m.topics == ["a", "m", "z"] and m.provenance == "also listed by b"
    assert (m.age_min, m.age_max) == (0, None)  # a known zero isn't a gap, and bounds aren't mixed
    strict = {r.id: r for r in resolve.merge_duplicates(e, F.when(F.col("source") == "a", 1), strict=True).collect()}["a-1"]
    assert (strict.price_text, strict.is_free) == ("£5", None)


def test_publish_drop_empty(spark, tmp_path):
    e = rows(spark, {"summary": "", "topics": [], "is_free": False, "price_from": 0.0})
    sinks.write_snapshot(e, spark.createDataFrame([("a", "ok")], "key string, status string"), str(tmp_path / "snap"), {"v": 1})
    sinks.write_snapshot(e, spark.createDataFrame([("a", "ok")], "key string, status string"), str(tmp_path / "snap"), {"v": 2})
    line = json.loads(next((tmp_path / "snap" / "events").glob("part*")).read_text())
    assert "summary" not in line and "topics" not in line and line["is_free"] is False and line["price_from"] == 0
    assert scans.snapshot(spark, str(tmp_path / "snap")).count() == 1 and scans.snapshot(spark, str(tmp_path / "none")).count() == 0


def test_selectors():
    t = tree('<div id="m"><p class="a b">1</p><p data-x="one two">2<b>3</b></p><ul><li>x<li>y</ul></div><p class="a">4</p>')
    texts = lambda s: [n.text() for n in t.select(s)]
    assert texts("p.a") == ["1", "4"] and texts("div > p:not(.a)") == ["2 3"] and texts('[data-x~="two"] b') == ["3"] and texts("p:has(b), li") == ["2 3", "x", "y"]
    assert texts("#m p:first-child") == ["1"] and texts("p:-soup-contains('4')") == ["4"] and texts('p[class*="b"]') == ["1"] and texts("ul > li") == ["x", "y"]
    assert pick(t, [".none", "p"]) == "1" and pick(t, "p[data-x]", "data-x") == "one two" and tree("").select("p") == []


def test_replacing_a_snapshot(spark, tmp_path):
    """A move that fails leaves what was there."""
    from eventmill.plans import storage

    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x").write_text("1")
    with pytest.raises(Exception):  # noqa: B017
        storage.replace(spark, str(tmp_path / "missing"), str(tmp_path / "old"))
    assert (tmp_path / "old" / "x").read_text() == "1"


def test_published_rows(spark, tmp_path):
    e = rows(spark, {}, {"id": " "}, {"title": ""}, {"id": "b", "ongoing": True, "exhibition": True})
    sinks.write_events(e, str(tmp_path / "snap" / "events"))
    assert sorted(r.id for r in scans.published(spark, str(tmp_path / "snap")).collect()) == ["a-1", "b"]
    assert scans.published(spark, str(tmp_path / "snap")).first().topics == []


DATES = [  # ranges and single dates beyond the golden ones; today is 2026-06-01
    ("3rd of May 2026", "2026-05-03", None), ("May 3, 2026", "2026-05-03", None), ("3 - 5 May 2026", "2026-05-03", "2026-05-05"), ("3-5 May 2026", "2026-05-03", "2026-05-05"), ("3 May to 5 June 2026", "2026-05-03", "2026-06-05"),
    ("28 Dec 2026 – 3 Jan 2027", "2026-12-28", "2027-01-03"), ("28 Dec – 3 Jan 2027", "2026-12-28", "2027-01-03"), ("1/2/2026", "2026-02-01", None), ("1/13/2026", "2026-01-13", None), ("01-02-2026", "2026-02-01", None),
    ("1.2.2026", "2026-02-01", None), ("until 5 July 2026", "2026-06-01", "2026-07-05"), ("Ends 5 July 2026", "2026-06-01", "2026-07-05"), ("throughout 2026", None, None), ("till 1/8/2026", "2026-06-01", "2026-08-01"),
    ("2026-05-01 to 2026-04-01", "2026-05-01", None), ("2026-05-01 — 2026-05-02", "2026-05-01", "2026-05-02"), ("31 February 2026", None, None), ("Sat 6 June", "2026-06-06", None), ("6 June 2026 - late", "2026-06-06", None),
    ("5 October 2026 – 1 October 2026", "2026-10-05", None), ("10 to 12 August 2026", "2026-08-10", "2026-08-12"), ("9 Nov 2026 7pm to 9pm", "2026-11-09", None), ("1 May / 2 May", None, None), ("   ", None, None),
    ("17/01/2026 – 20/01/2026", "2026-01-17", "2026-01-20"), ("Sept 4 - Sept 6, 2026", "2026-09-04", "2026-09-06"), ("12th–14th March 2027", "2027-03-12", "2027-03-14"), ("every day", None, None), ("2 – 3", None, None),
]


def test_more_dates():
    from datetime import date

    from eventmill.functions import prose

    for given, start, end in DATES:
        got = tuple(x and x[:10] for x in prose.read_range(given, date(2026, 6, 1)))
        assert got == (start, end), given
    assert prose.read_date("29 March 2026 01:30", date(2026, 1, 1)) == "2026-03-29T02:30:00+01:00"
    assert prose.read_range("29 February 2024", date(2024, 7, 1), None, True)[0][:10] == "2024-02-29"


TIMES = [
    ("from 9am", 540, None), ("9am to noon", 540, None), ("9-11am", 540, 660), ("21:15", 1275, None), ("12pm-1pm", 720, 780), ("12.30 - 2pm", 750, 840), ("25:00", None, None), ("Doors open 18:30, film 19:00", 1140, None), ("at 7; then 8pm-9pm", 1200, 1260),
    ("5th May, 6pm", 1080, None), ("May 5 6.15pm", 1095, None), ("10am • 3pm", 600, None), ("11pm - 1am", 1380, 60), ("registration 9.30am, start 10am", 600, None), ("1.5.2026 at 14:00", 840, None),
]


def test_more_times():
    from eventmill.functions import prose

    for given, start, end in TIMES:
        assert prose.read_times(given) == (start, end), given


MORE_AGES = [
    ("Aged 5 to 7", 5, 7), ("years 7-9", 7, 9), ("18 plus", 18, None), ("16 and over", 16, None), ("21 or over", 21, None), ("10 or younger", None, 10), ("below 12", None, 11), ("under-14s", None, None), ("30-40 year olds", None, None),
    ("under 18s not permitted; ages 18-24", 18, 24), ("10 – 12 Oct", None, None), ("8+ and under 12", 8, None), ("For 11–14 yr olds", 11, 14), ("must be over 18", None, None), ("16-14", None, None),
]
MORE_PRICES = [
    ("free", True, 0.0), ("It is free.", True, 0.0), ("Non-free", None, None), ("no free places", None, None), ("Students go free", None, None), ("under 5s are free", None, None), ("under-16s free", None, None), ("free on Fridays", None, None),
    ("freedom", None, None), ("£ 5", False, 5.0), ("£5.5", False, 5.0), ("from €1,250.50", False, 1250.5), ("Free, £0", True, 0.0), ("$3 or $2", False, 2.0), ("concessions free, others pay", None, None),
]


def test_more_ages_and_prices(spark):
    from eventmill.functions import ages, prices

    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(MORE_AGES)], "i int, t string").select("i", ages.age_range(F.col("t")).alias("r")).collect()
    for r in got:
        assert (r.r.low, r.r.high) == MORE_AGES[r.i][1:], MORE_AGES[r.i]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(MORE_PRICES)], "i int, t string").select("i", prices.price_info(F.col("t")).alias("r")).collect()
    for r in got:
        assert (r.r.is_free, r.r.price_from) == MORE_PRICES[r.i][1:], MORE_PRICES[r.i]


def test_source_checks(spark):
    sources = spark.createDataFrame([(k, "n", "html", "h", "v", "d", "t", day, k != "c", k == "b") for k, day in (("a", "2026-05-01"), ("b", "2025-01-01"), ("c", "2026-05-01"), ("d", "2026-05-01"))], ", ".join(f"{c} string" for c in verify.REQUIRED) + ", expect_events boolean, allow_blocked boolean")
    pages = spark.createDataFrame([("a", 200), ("b", 403), ("c", 200), ("d", 500)], "source string, http_status int")
    checks = verify.source_checks(sources, spark.createDataFrame([("a",), ("a",)], "source string"), pages, F.lit("2026-06-01").cast("date"))
    assert {r.source: r.verdict for r in verify.verdict(checks).collect()} == {"a": "PASS", "b": "PASS*", "c": "PASS", "d": "FAIL"}
    assert json.loads(verify.report_json(checks))["ok"] is False


def test_replies_reach_the_published_rows(spark, tmp_path):
    from eventmill.plans import classify

    snap, cache = str(tmp_path / "snap"), str(tmp_path / "cache")
    sinks.write_snapshot(rows(spark, {}, {"id": "b-1", "title": "Other"}), spark.createDataFrame([("a", "ok")], "key string, status string"), snap, {})
    args = ["--snapshot", snap, "--cache", cache, "--model", "m"]
    stop, spark.stop = spark.stop, lambda: None
    try:
        classify.main([*args, "--ask", str(tmp_path / "ask")])
        asked = {r.title: r.key for r in spark.read.json(str(tmp_path / "ask")).collect()}
        (tmp_path / "replies.json").write_text(json.dumps({"key": asked["Other"], "reply": '["Law & justice"]'}))
        classify.main([*args, "--replies", str(tmp_path / "replies.json"), "--ask", str(tmp_path / "ask")])
    finally:
        spark.stop = stop
    assert {r.id: r.careers for r in scans.snapshot(spark, snap).collect()} == {"a-1": [], "b-1": ["Law & justice"]}
    assert [r.title for r in spark.read.json(str(tmp_path / "ask")).collect()] == ["The Talk"]


def test_scan_all_and_unknown_kind(spark):
    docs = spark.createDataFrame([("hall", 1, LISTING), ("talks", 1, FEED), ("other", 1, "x")], "source string, page int, raw string")
    assert scans.scan_all(docs, HTML + ICS, NOW).count() == 5 and scans.scan_all(docs, HTML + ICS, NOW, {"talks"}).count() == 3
    with pytest.raises(KeyError, match="html"):
        scans.scan("xml")
    with pytest.raises(ValueError, match="may not set"):
        scans.scan_venue(docs, [{**VENUE[0], "confirm": [{"phrase": "x", "sets": {"id": 1}}]}], NOW)


def test_bad_documents(spark):
    docs = spark.createDataFrame([("hall", 1, ""), ("hall", 2, None), ("talks", 1, "nothing"), ("hall", 3, "<li class=card")], "source string, page int, raw string")
    assert scans.scan_all(docs, HTML + ICS, NOW).count() == 0


def test_build_degrades(spark):
    docs = spark.createDataFrame([("talks", 1, FEED)], "source string, page int, raw string")
    none = spark.createDataFrame([], EVENT_SCHEMA), spark.createDataFrame([], REPORT_SCHEMA)
    first, report = build.build(docs, ICS + HTML, *none, NOW)
    assert {r.key: r.status for r in report.collect()} == {"talks": "ok", "hall": "ok"} and first.count() == 3
    last = report.select("key", F.lit("").alias("name"), F.lit("").alias("kind"), "status", "count", "candidate_count", "last_success", "last_good_count", F.lit(True).alias("pagination_complete"), "warning")
    again, report = build.build(docs.filter("false"), ICS + HTML, first.select(*EVENT_COLUMNS), last, NOW)
    assert {r.key: r.status for r in report.collect()} == {"talks": "empty", "hall": "ok"}
    assert again.filter("carried").count() == 3 and sinks.exit_code(report) == 1
    dropped, report = build.build(docs.filter("false"), ICS + HTML, first.select(*EVENT_COLUMNS), last, NOW, allow_drop=True)
    assert dropped.count() == 0 and sinks.exit_code(report) == 0


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"source": "talks", "page": 1, "raw": FEED}))
    q = runs.collect(runs.documents(spark, str(tmp_path / "in")), ICS, lambda: NOW, runs.to_versions(str(tmp_path / "out")), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_verification(spark):
    checks = spark.createDataFrame([("a", [], []), ("b", [], ["old"]), ("c", ["gone"], [])], "source string, problems array<string>, notes array<string>")
    assert [r.verdict for r in verify.verdict(checks).orderBy("source").collect()] == ["PASS", "PASS*", "FAIL"]
    assert "| FAIL | c | gone |" in verify.report_text(checks, True)
    src = spark.createDataFrame([("a", "A", "")], "key string, name string, kind string")
    assert "no kind" in verify.contract(src).first().problems and "no homepage" in verify.contract(src).first().problems


def test_user_ids(spark, tmp_path):
    path = str(tmp_path / "saved")
    assert sinks.user_ids(spark, path).count() == 0
    sinks.save_user_ids(spark.createDataFrame([("x",), ("x",)], "id string"), path)
    assert [r.id for r in sinks.user_ids(spark, path).collect()] == ["x"]


def test_calendar_files(spark, tmp_path):
    e = build.with_clocks(rows(spark, {"title": "A; b, c"}, {"id": "x", "anytime": True}))
    sinks.write_calendar(e.coalesce(1), str(tmp_path / "cal"), "20260601T000000Z")
    text = next((tmp_path / "cal").glob("part*")).read_bytes().decode()
    assert text.count("BEGIN:VEVENT") == 1 and "SUMMARY:A\\; b\\, c" in text and "DTEND:20260605T200000Z" in text


def matches_sql(spark, name, folder, table):
    """A query on one table of the test's own, row by row against its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = registry.queries()[name](spark, str(folder))
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(map(repr, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


WORDS = ["dans\u00e9tre", "\u00e9thing", "dans\u0301", "THE\u0663", "the\u3042", "TH\u0130NG", "L\u0130CENCE", "\u212ething \u212aand", "a\u000bthe\u000bb", "the_and", "and", "\u00a0that\u00a0", "other", "", None]


def test_themes_at_the_edge_of_other_scripts(spark, tmp_path):
    from eventmill.taxonomy import careers

    docs = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    matches_sql(spark, "keyword_themes", tmp_path, "documents")
    texts = ["law\u00e9", "\u00e9law", "law\u0301", "law\u0663", "law"]  # the engine's own taxonomies take words of all scripts
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(careers(F.col("t")).alias("c")).orderBy("i").collect()
    assert [bool(r.c) for r in got] == [False, False, True, False, True]


def test_stale_to_the_microsecond(spark, tmp_path):
    from eventmill.plans import reconcile

    times = ["2024-01-05 23:59:59", "2024-01-05 23:59:59.000001", "2024-01-05 23:59:59.999999", "2024-01-06 00:00:00", "2024-01-06 00:00:00.000001", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999", None]
    rows_ = spark.createDataFrame(list(enumerate(times)), "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows_.write.parquet(str(tmp_path / "events.parquet"))
    matches_sql(spark, "row_staleness", tmp_path, "events")
    report = spark.createDataFrame([("a", "ok", "x")], "key string, status string, last_success string")
    late = lambda at: reconcile.freshness(report, F.lit(at).cast("timestamp_ntz"), F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")).first().late
    assert late("2024-01-05 23:59:59.5") is True and late("2024-01-06 00:00:00") is False


def stages(spark):
    """Of each stage that ran: MB shuffled, spilled and written, by its number."""
    sc = spark.sparkContext
    gateway = sc._gateway
    seen = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): (s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes()) / 1e6 for s in map(seen.apply, range(seen.size()))}


def test_retagging_moves_little(spark):
    """Events are written twice, not shuffled with their labels or written between, and worked out once."""
    before = max(stages(spark), default=-1)
    got = registry.queries()["retag_publish"](spark, "/root/testdata/sf0.01")
    n = got.count()
    moved = sum(mb for i, mb in stages(spark).items() if i > before)
    assert n == 15_000 and moved * 1e6 / n < 300  # bytes an event


def test_retagging_by_an_empty_title_and_a_large_cache(spark, tmp_path):
    """A cache that is too large to send to the events gives the same labels; its folder in between goes."""
    from eventmill.plans import classify
    from eventmill.run_queries import MODEL, PROMPT, entries

    path, threshold = str(tmp_path / "snap"), "spark.sql.autoBroadcastJoinThreshold"
    got, was = [], spark.conf.get(threshold)
    for most, form in ((was, None), ("-1", "gzip")):
        sinks.write_snapshot(rows(spark, {"title": "", "careers": ["Law & justice"]}, {"id": "b", "title": "xx", "careers": ["Law & justice"]}, {"id": "c", "title": "x", "careers": ["Law & justice"]}), spark.createDataFrame([("a", "ok")], "key string, status string"), path, {}, form)
        spark.conf.set(threshold, most)
        try:
            out = classify.retag_published(spark, path, entries(scans.snapshot(spark, path)), MODEL, PROMPT, form)
            got.append({r.id: r.careers for r in out.collect()})
        finally:
            spark.conf.set(threshold, was)
    assert got[0] == got[1] == {"a-1": [], "b": ["Engineering"], "c": ["Law & justice"]}
