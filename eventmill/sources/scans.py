"""Scans: raw documents into event rows.

A scan has two halves.  A table function walks the document (HTML tree, JSON tree, calendar lines) and gives the texts it finds, a row
an item, in Arrow batches; documents are rows, so pages and sources parse in parallel.  Then column expressions turn
texts into typed columns: dates, ages, prices, tags (`typed`), the same for every kind of source.

Documents: DataFrame (source string, page int, raw string).  Sources: the registry's entries, a bounded list of dicts that travels with
the task.  `now` is an ISO text of London time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ages, clock, ical, prices, prose, text
from ..operators import derive, filters
from ..operators.resolve import first_wins
from ..plans.storage import exists
from ..schema import EVENT_COLUMNS, EVENT_SCHEMA, LIST_COLUMNS
from ..taxonomy import careers, work_styles
from .markup import field_values, pick, tree

#: What a walk gives for an item. `begin` and `finish` are ISO texts.
FOUND = (
    "source string, page int, pos int, ident string, title string, url string, begin string, finish string, all_day boolean, ongoing boolean, time_text string, "
    "when_text string, status string, summary string, venue_name string, city string, lat double, lon double, online boolean, price_text string, "
    "booking_url string, age_text string, age_labels array<string>, topics array<string>, own_topics array<string>, provenance string, stated_price double, stated_currency string, offers string"
)
NAMES = [f.split()[0] for f in FOUND.split(",")]
Walk = Callable[[str, dict, date], Iterator[dict]]


def walked(docs: DataFrame, sources: list[dict], now: str, walk: Walk) -> DataFrame:
    """The walk over each document of a registered source."""
    known, today = {s["key"]: s for s in sources}, date.fromisoformat(now[:10])

    def run(batches):
        for pdf in batches:
            rows = []
            for source, page, raw in zip(pdf["source"], pdf["page"], pdf["raw"], strict=True):
                if source in known and raw is not None:
                    rows += [{"source": source, "page": int(page), "pos": i, **item} for i, item in enumerate(walk(raw, known[source], today))]
            yield pd.DataFrame(rows, columns=NAMES).astype(object).where(lambda d: d.notna(), None)

    return docs.select("source", "page", "raw").mapInPandas(run, FOUND)


def typed(found: DataFrame, sources: list[dict], union_ages: bool = False, now: str = "", more: tuple[str, ...] = ()) -> DataFrame:
    """Event rows of found items: first of each id in (page, pos) order; registry values fill what an item lacks."""
    spark = found.sparkSession
    fields = "key string, name string, r_venue string, r_city string, r_lat double, r_lon double, r_topics array<string>, r_career string"
    rows = [(s["key"], s.get("name", s["key"]), s.get("venue_name"), s.get("city"), s.get("lat"), s.get("lon"), list(s.get("topics", [])), " ".join(s.get("career_topics", []))) for s in sources]
    registry = spark.createDataFrame(rows, fields)
    e = found.withColumn("id", derive.stable_id(F.col("source"), F.col("ident")))
    e = first_wins(e, "id", "page", "pos").join(F.broadcast(registry), F.col("source") == F.col("key"))  # the registry is a driver-side list
    union = ages.audience_union(F.coalesce("age_labels", F.array().cast("array<string>")))
    prose_age = ages.age_range(F.concat_ws(" ", "age_text", *([] if union_ages else ["title", "summary"])))
    labelled = F.size(F.coalesce("age_labels", F.array().cast("array<string>"))) > 0
    e = e.withColumns({"_age": F.when(labelled, F.struct(union["low"].alias("low"), union["high"].alias("high"))).otherwise(prose_age), "_price": prices.price_info(F.col("price_text")), "_aud": F.when(labelled, union["audiences"])})
    none = F.array().cast("array<string>")
    made = {
        "source_name": F.col("name"), "start": F.col("begin"), "end": F.col("finish"), "anytime": F.lit(False), "exhibition": F.lit(False),
        "ongoing": F.coalesce("ongoing", derive.ongoing(F.col("begin"), F.col("finish"))),
        "status": F.coalesce("status", F.lit("scheduled")), "venue_name": F.coalesce("venue_name", "r_venue"), "city": F.coalesce("city", "r_city"),
        "lat": F.coalesce("lat", "r_lat"), "lon": F.coalesce("lon", "r_lon"), "online": F.coalesce("online", F.lit(False)),
        "is_free": F.when(F.col("stated_price").isNotNull(), F.col("price_text") == "Free").otherwise(F.col("_price.is_free")),
        "price_from": F.coalesce("stated_price", "_price.price_from"), "currency": F.coalesce("stated_currency", "_price.currency"),
        "booking": F.when(F.col("booking_url").isNotNull(), "required"), "accompanied": F.lit(None).cast("boolean"),
        "audiences": F.coalesce("_aud", none), "age_min": F.col("_age.low"), "age_max": F.col("_age.high"),
        "topics": F.array_sort(F.array_distinct(F.concat("r_topics", F.coalesce("topics", none), F.coalesce("own_topics", none)))),
        "careers": careers(F.col("title"), F.col("summary"), F.concat_ws(" ", F.coalesce("own_topics", none)), F.col("r_career")),
        "work_styles": work_styles(F.col("title"), F.col("summary")),
        "link_status": F.lit(None).cast("int"), "verified_on": F.lit(None).cast("string"), "last_seen": F.lit(None).cast("string"),
    }
    return derive.range_sane(e.withColumns(made)).select(*EVENT_COLUMNS, *more)


# ---- HTML listings ----


def html_items(raw: str, cfg: dict, today: date) -> Iterator[dict]:
    """An item a row that the listing's selectors find; without a title or a date it is none."""
    sel, page = cfg["selectors"], tree(raw)
    base = cfg.get("site") or cfg.get("url", "")
    for node in page.select(sel["item"]):
        title = pick(node, sel.get("title"))
        dated = pick(node, sel.get("date"), sel.get("date_attr")) or pick(node, sel.get("date"))
        times = pick(node, sel.get("time"))
        opens, closes = prose.read_times(times)
        start, end = prose.read_range(dated, today, None if opens is None else at_minute(opens), bool(cfg.get("assume_future_dates")))
        if not title or not start:
            continue
        stated = prose.read_date(pick(node, sel.get("end"), sel.get("end_attr")) or pick(node, sel.get("end")), today)
        end = (stated if stated and stated >= start else None) or end
        if end is None and closes is not None:
            end = prose.read_date(f"{start[:10]}T{closes // 60:02}:{closes % 60:02}", today)
        said = (pick(node, sel.get("status")) or "").lower()
        status = next((v for k, v in (("cancel", "cancelled"), ("sold out", "sold_out"), ("postponed", "postponed")) if k in said), "scheduled")
        href = pick(node, sel.get("link") or sel.get("title"), "href")
        url = resolve(base, href) if href else base
        yield {
            "ident": url if href else f"{title}|{start}", "title": title, "url": url, "begin": start, "finish": end, "all_day": opens is None, "time_text": times, "status": status,
            "when_text": dated if dated and re.match(r"(?i)\s*(?:on now\s+)?(?:until|till|through(?:out)?|ends?)\b", dated) else None,
            "summary": pick(node, sel.get("summary")), "venue_name": pick(node, sel.get("venue")), "price_text": pick(node, sel.get("price")), "age_text": pick(node, sel.get("age")),
        }


def at_minute(m: int):
    from datetime import time

    return time(m // 60, m % 60)


def resolve(base: str, link: str) -> str:
    from urllib.parse import urljoin

    return urljoin(base, link)


def scan_html(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    found = typed(walked(docs, sources, now, html_items), sources, more=("page",))
    return with_page_claims(found, docs, sources).select(*EVENT_COLUMNS)


def rules_of(spark: SparkSession, sources: list[dict], key: str) -> DataFrame:
    """The registry's phrase rules: source, rule_no, phrase, unless, sets (JSON)."""
    rows = [(s["key"], i, r["phrase"], list(r.get("unless", [])), json.dumps(r.get("sets", {}))) for s in sources for i, r in enumerate(s.get(key, []))]
    return spark.createDataFrame(rows, "source string, rule_no int, phrase string, unless array<string>, sets string")


def confirmed_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """source, page, and its rules in order with whether the page says so. The rules are few and broadcast: each page meets its own source's."""
    plain = pages.select("source", "page", text.html_text(F.col("raw")).alias("_said"))
    met = plain.join(F.broadcast(rules), "source").withColumn("ok", text.phrase_confirmed(F.col("_said"), F.col("phrase"), F.col("unless")))
    return met.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("rule_no", "phrase", "ok", "sets"))).alias("rules"))


def with_page_claims(events: DataFrame, docs: DataFrame, sources: list[dict]) -> DataFrame:
    """What a page of a listing says of all its rows, while it says so; else a note that the claim was dropped. events: with their page."""
    if not any(s.get("page_confirm") for s in sources):
        return events
    rules = rules_of(events.sparkSession, sources, "page_confirm")
    state = confirmed_rules(docs, rules).select("source", "page", F.explode("rules").alias("r")).groupBy("source", "page").agg(
        F.first(F.when(F.col("r.ok"), F.get_json_object("r.sets", "$.age_min").cast("int")), True).alias("_min"),
        F.first(F.when(F.col("r.ok"), F.get_json_object("r.sets", "$.age_max").cast("int")), True).alias("_max"),
        F.first(F.when(F.col("r.ok"), F.get_json_object("r.sets", "$.age_text")), True).alias("_text"),
        F.first(F.when(F.col("r.ok"), F.from_json(F.get_json_object("r.sets", "$.audiences"), "array<string>")), True).alias("_aud"),
        F.array_sort(F.collect_set(F.when(~F.col("r.ok"), F.concat(F.lit("“"), "r.phrase", F.lit("”"))))).alias("_gone"),
    )
    note = F.when(F.size("_gone") > 0, F.concat(F.lit("the listing page no longer says "), F.array_join("_gone", "; "), F.lit(", so that claim was dropped")))
    out = events.join(state, ["source", "page"], "left").withColumns({
        "age_min": F.coalesce("_min", "age_min"), "age_max": F.coalesce("_max", "age_max"), "age_text": F.coalesce("age_text", "_text"),
        "audiences": F.coalesce("_aud", "audiences"), "provenance": F.coalesce("provenance", note),
    })
    return out.select(*events.columns)


def page_keys(docs: DataFrame, sources: list[dict]) -> DataFrame:
    """source, page, keys: the identities of each page's rows, to recognise a repeated page."""
    known = {s["key"]: s["selectors"] for s in sources}

    def run(batches):
        for pdf in batches:
            rows = []
            for source, page, raw in zip(pdf["source"], pdf["page"], pdf["raw"], strict=True):
                sel = known[source]
                keys = {pick(n, sel.get("link") or sel.get("title"), "href") or pick(n, sel.get("title")) or "" for n in tree(raw).select(sel["item"])} - {""}
                rows.append((source, int(page), sorted(keys)))
            yield pd.DataFrame(rows, columns=["source", "page", "keys"])

    return docs.select("source", "page", "raw").mapInPandas(run, "source string, page int, keys array<string>")


def pagination(pages: DataFrame, max_pages: int) -> DataFrame:
    """source, last_page, complete: where a walk over numbered pages ends. pages: source, page, keys, missing (no such page).

    It ends whole at a missing page or one with no new rows, and cut short at the second blank page in a row or after `max_pages`."""
    by = Window.partitionBy("source").orderBy("page")
    first = pages.select("source", F.explode("keys").alias("k"), "page").groupBy("source", "k").agg(F.min("page").alias("page"))
    fresh = first.groupBy("source", "page").agg(F.count("*").alias("fresh"))
    p = pages.join(fresh, ["source", "page"], "left").withColumn("blank", ~F.col("missing") & (F.size("keys") == 0))
    kind = (
        F.when(F.col("missing"), "whole").when(F.col("blank") & F.lag("blank").over(by), "cut")
        .when(~F.col("blank") & (F.col("page") > 1) & F.col("fresh").isNull(), "whole").when(F.col("page") >= max_pages, "cut")
    )
    stops = p.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("source").agg(F.min_by(F.struct("page", "kind"), "page").alias("s"))
    last = pages.groupBy("source").agg(F.max("page").alias("seen"))
    return last.join(stops, "source", "left").select("source", F.coalesce("s.page", "seen").alias("last_page"), F.coalesce(F.col("s.kind") == "whole", F.lit(False)).alias("complete"))


DETAIL = "url string, ages array<string>, prices array<string>, topics_found array<string>, summaries array<string>, times_found array<string>"


def details(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Labelled fields of detail pages. pages: url, raw (null where the fetch failed)."""
    names = ("age", "price", "topics", "summary", "time")

    def run(batches):
        for pdf in batches:
            rows = []
            for url, raw in zip(pdf["url"], pdf["raw"], strict=True):
                if raw is not None:
                    page = tree(raw)
                    rows.append((url, *(field_values(page, selectors.get(n)) for n in names)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in DETAIL.split(", ")])

    return pages.select("url", "raw").mapInPandas(run, DETAIL)


def to_enrich(events: DataFrame, most: int = 200) -> DataFrame:
    """source, url: the pages to fetch, of each source the `most` first by start, then URL; an address once however many rows have it."""
    first = events.filter(F.length("url") > 0).groupBy("source", "url").agg(F.min(F.coalesce("start", F.lit("9999"))).alias("_start"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("_start", "url"))
    return first.withColumn("_place", place).filter(F.col("_place") <= most).select("source", "url")


def enrichment_counts(asked: DataFrame, found: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per source: pages attempted, enriched (with a field in it), failed (no page), and events that got an age. asked: `to_enrich`; found: `details`."""
    lists = [c for c in found.columns if c != "url"]
    state = found.select("url", F.lit(True).alias("_read"), (sum((F.size(c) for c in lists), F.lit(0)) > 0).alias("_some"))
    pages = asked.join(state, "url", "left").groupBy("source").agg(F.count("*").alias("attempted"), F.count_if("_some").alias("enriched"), F.count_if(F.col("_read").isNull()).alias("failed"))
    ageless = lambda e: F.col(f"{e}.age_min").isNull() & F.col(f"{e}.age_max").isNull()
    gained = before.alias("b").join(after.alias("a"), F.col("a.id") == F.col("b.id")).groupBy(F.col("b.source").alias("source")).agg(F.count_if(ageless("b") & ~ageless("a")).alias("ages_added"))
    return pages.join(gained, "source", "left").select("source", "attempted", "enriched", "failed", F.coalesce("ages_added", F.lit(0)).alias("ages_added"))


def enrich(events: DataFrame, found: DataFrame, today: str, sources: list[dict] = ()) -> DataFrame:
    """Events with gaps filled from their own pages (matched by URL); topics are united, tags follow the final texts and the registry's
    career topics (`sources`)."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    e = events.join(found, "url", "left")
    union = ages.audience_union(F.col("ages"))
    add_age = some("ages") & F.col("age_min").isNull() & F.col("age_max").isNull()
    add_price = some("prices") & F.coalesce(F.length("price_text") == 0, F.lit(True))
    add_time = some("times_found") & F.coalesce(F.length("time_text") == 0, F.lit(True))
    e = e.withColumns({"_union": union, "_price": prices.price_info(F.array_join("prices", ", ")), "_clock": prose.times(F.array_join("times_found", ", "))})
    midnight = add_time & F.col("_clock.start_min").isNotNull() & (F.substring("start", 12, 5) == "00:00")
    wall = F.timestamp_add("MINUTE", F.col("_clock.start_min"), F.substring("start", 1, 10).cast("timestamp_ntz"))
    e = e.withColumns({
        "age_text": F.when(add_age, F.array_join("ages", ", ")).otherwise(F.col("age_text")),
        "audiences": F.when(add_age, F.array_sort(F.array_union("audiences", "_union.audiences"))).otherwise(F.col("audiences")),
        "age_min": F.when(add_age, F.col("_union.low")).otherwise(F.col("age_min")), "age_max": F.when(add_age, F.col("_union.high")).otherwise(F.col("age_max")),
        "is_free": F.when(add_price, F.col("_price.is_free")).otherwise(F.col("is_free")), "price_from": F.when(add_price, F.col("_price.price_from")).otherwise(F.col("price_from")),
        "currency": F.when(add_price, F.col("_price.currency")).otherwise(F.col("currency")), "price_text": F.when(add_price, F.array_join("prices", ", ")).otherwise(F.col("price_text")),
        "topics": F.when(some("topics_found"), F.array_sort(F.array_union("topics", "topics_found"))).otherwise(F.col("topics")),
        "summary": F.when(some("summaries") & F.coalesce(F.length("summary") == 0, F.lit(True)), F.substring(F.array_join("summaries", " "), 1, 420)).otherwise(F.col("summary")),
        "time_text": F.when(add_time, F.array_join("times_found", ", ")).otherwise(F.col("time_text")),
        "start": F.when(midnight, clock.iso(wall)).otherwise(F.col("start")), "all_day": F.col("all_day") & ~F.coalesce(midnight, F.lit(False)),
    })
    known = {s["key"]: " ".join(s["career_topics"]) for s in sources if s.get("career_topics")}
    own = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("source")) if known else F.lit("")
    e = e.withColumns({"careers": careers(F.col("title"), F.col("summary"), own), "work_styles": work_styles(F.col("title"), F.col("summary"))})
    return e.select(*events.columns)


# ---- JSON trees ----

#: Fixed by schema.org: types that are events.
EVENT_TYPES = frozenset((
    "event", "exhibitionevent", "educationevent", "socialevent", "festival", "screeningevent", "theaterevent", "musicevent", "courseinstance",
    "businessevent", "childrensevent", "visualartsevent",
))
DEEPEST = 30
#: Fixed by schema.org: what an offer says.
OFFER = ("price", "lowPrice", "priceCurrency", "url")


def json_blocks(raw: str) -> Iterator[object]:
    """The document if it is JSON, else the JSON in its script elements."""
    body = raw.lstrip()
    candidates = [body] if body[:1] in ("[", "{") else []
    if not candidates:
        for n in tree(raw).select("script[type]"):
            kind, code = n.attrs["type"].lower(), "".join(n.strings(True))
            if kind == "application/ld+json" or kind == "application/json" and '"Event"' in code:
                candidates.append(code)
    for c in candidates:
        try:
            yield json.loads(c)
        except ValueError:
            continue


def event_objects(value: object) -> Iterator[dict]:
    """Objects of an event's type anywhere in a tree of DEEPEST levels at most, in document order."""
    todo = [(value, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, dict):
            kinds = node.get("@type") or node.get("type") or []
            if not EVENT_TYPES.isdisjoint(str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                yield node
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        if depth < DEEPEST:
            todo += [(v, depth + 1) for v in reversed(list(inner))]


def flat(value: object) -> str | None:
    """Text of a JSON value: an object's name or @value, a list's parts joined."""
    if isinstance(value, dict):
        return flat(value.get("name") or value.get("@value"))
    if isinstance(value, list):
        return ", ".join(t for t in map(flat, value) if t) or None
    return None if value is None else str(value).strip() or None


def labels(value: object) -> list[str]:
    out = []
    for v in value if isinstance(value, list) else [value]:
        t = v if isinstance(v, str) else (v.get("label") or v.get("title") or v.get("name")) if isinstance(v, dict) else None
        if isinstance(t, str) and t.strip():
            out.append(t.strip())
    return out


def offered(value: object) -> str | None:
    """The offers of an item as JSON of texts, which `prices.offers` reads."""
    own = [o for o in (value if isinstance(value, list) else [value]) if isinstance(o, dict)]
    return json.dumps([{k: str(v) for k, v in {**o, "priceCurrency": o.get("priceCurrency") or o.get("currency")}.items() if k in OFFER and v is not None} for o in own]) if own else None


def with_offers(found: DataFrame) -> DataFrame:
    """Prices and booking links of found items from the JSON of their offers."""
    of = prices.offers(F.from_json("offers", f"array<struct<{', '.join(f'{k}: string' for k in OFFER)}>>"))
    priced = found.withColumn("_of", F.when(F.col("offers").isNotNull(), of))
    return priced.withColumns({"price_text": F.col("_of.price_text"), "stated_price": F.col("_of.price_from"), "stated_currency": F.col("_of.currency"), "booking_url": F.col("_of.booking_url")}).drop("_of")


def jsonld_items(raw: str, cfg: dict, today: date) -> Iterator[dict]:
    seen = set()
    for block in json_blocks(raw):
        for o in event_objects(block):
            title, start, end = flat(o.get("name")) or flat(o.get("title")), prose.read_date(flat(o.get("startDate")), today), None
            if not start and isinstance(o.get("times"), list):
                sittings = [(prose.read_date(flat(t.get("startDateTime") or t.get("start")), today), t) for t in o["times"] if isinstance(t, dict)]
                start, first = min(((s, t) for s, t in sittings if s), key=lambda p: p[0], default=(None, None))
                end = prose.read_date(flat(first.get("endDateTime") or first.get("end")), today) if first else None
            url = flat(o.get("url"))
            if not url and cfg.get("url_template"):
                try:
                    url = cfg["url_template"].format(**{k: v for k, v in o.items() if isinstance(v, str | int)})
                except (KeyError, IndexError):
                    url = None
            if not title or not start or (not url and cfg.get("require_url")):
                continue
            ident = flat(o.get("@id")) or flat(o.get("id")) or f"{title}|{start}"
            if ident in seen:
                continue
            seen.add(ident)
            place = o.get("location") or {}
            place = (place[0] if place else {}) if isinstance(place, list) else place
            known = place if isinstance(place, dict) else {}
            address, geo = known.get("address"), known.get("geo")
            try:
                spot = (float(geo["latitude"]), float(geo["longitude"]))
            except (TypeError, KeyError, ValueError):
                spot = (None, None)
            said = labels(o.get("audiences") or o.get("audience"))
            status = str(o.get("eventStatus", "")).rsplit("/", 1)[-1].lower()
            yield {
                "ident": ident, "title": title, "url": resolve(cfg.get("site") or cfg.get("url", ""), url or cfg.get("url", "")), "begin": start,
                "finish": prose.read_date(flat(o.get("endDate")), today) or end, "all_day": len(str(o.get("startDate", ""))) <= 10, "summary": flat(o.get("description")),
                "venue_name": flat(known.get("name")) if isinstance(place, dict) else cfg.get("venue_name"), "city": flat(address.get("addressLocality")) if isinstance(address, dict) else None,
                "lat": spot[0], "lon": spot[1], "online": "online" in str(o.get("eventAttendanceMode", "")).lower(),
                "status": {"eventcancelled": "cancelled", "eventpostponed": "postponed", "eventrescheduled": "postponed"}.get(status, "scheduled"),
                "age_text": flat(o.get("typicalAgeRange")) or ", ".join(said) or None, "age_labels": said,
                "own_topics": [t for k in ("format", "series", "interpretations", "eventFormat") for t in labels(o.get(k))], "offers": offered(o.get("offers")),
            }


def scan_jsonld(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    return typed(with_offers(walked(docs, sources, now, jsonld_items)), sources, union_ages=True)


# ---- JSON:API collections ----

COLLECTION = (
    "data array<struct<attributes: string, relationships: map<string, struct<data: string>>>>, included array<struct<id: string, attributes: struct<name: string>>>, "
    "meta struct<pagination_complete: boolean>, links struct<next: string>"
)


def scan_jsonapi(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    """Nodes of JSON:API documents with their terms looked up among the included ones, as expressions over parsed JSON."""
    spark = docs.sparkSession
    names = {"date_field": "field_dates", "time_field": "field_times", "price_field": "field_prices", "booking_field": "field_book_tickets", "age_field": "field_age", "topic_field": "field_topic", "type_field": "field_event_type", "location_field": "field_location"}
    cfg = spark.createDataFrame([(s["key"], s.get("site", ""), *(s.get(k, d) for k, d in names.items())) for s in sources], "source string, site string, " + ", ".join(f"{k} string" for k in names))
    d = docs.join(F.broadcast(cfg), "source").withColumn("_doc", F.from_json("raw", COLLECTION))
    d = d.withColumn("_terms", F.map_from_entries(F.transform(F.coalesce("_doc.included", F.array().cast("array<struct<id: string, attributes: struct<name: string>>>")), lambda x: F.struct(x["id"], x["attributes"]["name"]))))
    n = d.select("source", "page", "site", *names, "_terms", F.posexplode("_doc.data").alias("pos", "node"))
    attr = lambda path: F.get_json_object("node.attributes", path)
    attrs = F.from_json("node.attributes", "map<string, string>")  # values stay JSON text
    of = lambda field: F.try_element_at(attrs, F.col(field))

    def terms(field: str):
        data = F.try_element_at("node.relationships", F.col(field))["data"]
        ids = F.when(F.startswith(data, F.lit("[")), F.from_json(data, "array<struct<id: string>>")["id"]).otherwise(F.array_compact(F.array(F.get_json_object(data, "$.id"))))
        return F.array_compact(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.try_element_at(F.col("_terms"), i)))

    n = n.withColumns({"_dates": of("date_field"), "time_text": of("time_field"), "price_text": of("price_field"), "_ages": terms("age_field"), "_topics": terms("topic_field"), "_types": terms("type_field"), "_places": terms("location_field")})
    n = n.withColumns({"_clock": prose.times(F.col("time_text")), "_start": prose.single_dates(F.get_json_object("_dates", "$.value"), now), "_end": prose.single_dates(F.get_json_object("_dates", "$.end_value"), now)})
    wall = lambda c: F.substring(c, 1, 19).cast("timestamp_ntz")
    start, end = derive.clock_fill(wall(F.col("_start")), wall(F.col("_end")), F.col("_clock.start_min"), F.col("_clock.end_min"))
    alias = F.coalesce(F.get_json_object(attr("$.path"), "$.alias"), F.lit(""))
    url = F.when(alias != "", text.absolute(F.col("site"), alias)).otherwise(F.col("site"))
    about = text.shortened(text.html_text(F.get_json_object(attr("$.body"), "$.value")))
    title = F.trim(F.coalesce(attr("$.title"), F.lit("")))
    blob = F.concat_ws(" ", title, about)
    status = F.when(blob.rlike(r"(?i)\b(cancelled|canceled)\b"), "cancelled").when(blob.rlike(r"(?i)\b(postponed|rescheduled)\b"), "postponed").when(blob.rlike(r"(?i)\bsold out\b"), "sold_out").otherwise("scheduled")
    booking = F.get_json_object(of("booking_field"), "$.uri")
    none = lambda kind: F.lit(None).cast(kind)
    found = n.filter(F.col("_start").isNotNull()).select(
        "source", "page", "pos", F.coalesce(attr("$.drupal_internal__nid"), url).alias("ident"), title.alias("title"), url.alias("url"), clock.iso(start).alias("begin"), clock.iso(end).alias("finish"),
        F.lit(False).alias("all_day"), none("boolean").alias("ongoing"), "time_text", none("string").alias("when_text"), status.alias("status"), about.alias("summary"), none("string").alias("venue_name"), none("string").alias("city"),
        none("double").alias("lat"), none("double").alias("lon"), F.exists("_places", lambda p: F.lower(p).rlike("livestream|online")).alias("online"), "price_text", booking.alias("booking_url"),
        F.nullif(F.array_join("_ages", ", "), F.lit("")).alias("age_text"), F.col("_ages").alias("age_labels"), F.col("_types").alias("topics"), F.col("_topics").alias("own_topics"), none("string").alias("provenance"), none("double").alias("stated_price"), none("string").alias("stated_currency"),
    )
    return typed(found, sources, union_ages=True)


# ---- calendars ----


def scan_ics(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    """VEVENTs as expressions: unfolded lines, a map from property to (value, parameters), the last of a name winning."""
    blocks = F.regexp_extract_all(ical.unfolded(F.col("raw")), F.lit(r"(?s)(?:^|\n)BEGIN:VEVENT[ \t]*\n(.*?)\nEND:VEVENT"), 1)
    v = docs.select("source", "page", F.posexplode(blocks).alias("pos", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.contains(x, F.lit(":")))
    head = lambda x: F.substring_index(x, ":", 1)
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.substring_index(head(x), ";", 1)).alias("k"), F.substring(x, F.length(head(x)) + 2, F.length(x)).alias("v"), head(x).alias("h")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    v = v.withColumn("_p", F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.struct(p["v"].alias("v"), p["h"].alias("h"))))))
    raw = lambda name: F.trim(F.try_element_at("_p", F.lit(name))["v"])
    val = lambda name: F.nullif(F.trim(ical.unescaped(raw(name))), F.lit(""))
    zone = lambda name: F.regexp_extract(F.try_element_at("_p", F.lit(name))["h"], r'TZID="?([^;":]+)', 1)
    start = ical.local_time(raw("DTSTART"), zone("DTSTART"))
    ends = F.coalesce(ical.local_time(raw("DTEND"), zone("DTEND")), F.when(raw("DTEND").isNull(), clock.localised(F.timestamp_add("MINUTE", ical.duration_minutes(val("DURATION")), start))))
    about = F.nullif(text.html_text(val("DESCRIPTION")), F.lit(""))
    about = F.when(~F.lower(F.regexp_replace(about, r"\.+$", "")).isin("abstract not available", "no abstract", "tbc", "tba", "n/a"), about)
    state = F.upper(F.coalesce(val("STATUS"), F.lit("CONFIRMED")))
    series = F.try_element_at("_p", F.lit("RRULE")).isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    site = F.coalesce(*[F.when(F.col("source") == s["key"], F.lit(s["site"])) for s in sources if s.get("site")], F.lit(""))
    found = v.select(
        "source", "page", "pos", F.concat_ws("|", F.coalesce(val("UID"), val("SUMMARY")), F.coalesce(val("RECURRENCE-ID"), clock.iso(start))).alias("ident"), val("SUMMARY").alias("title"), F.coalesce(val("URL"), site).alias("url"),
        clock.iso(start).alias("begin"), clock.iso(ends).alias("finish"), raw("DTSTART").rlike(r"^\d{8}$").alias("all_day"), series.alias("ongoing"), none("string").alias("time_text"), none("string").alias("when_text"),
        F.when(state.isin("CANCELLED", "CANCELED"), "cancelled").when(state == "TENTATIVE", "postponed").otherwise("scheduled").alias("status"), about.alias("summary"), val("LOCATION").alias("venue_name"), none("string").alias("city"),
        none("double").alias("lat"), none("double").alias("lon"), none("boolean").alias("online"), none("string").alias("price_text"), none("string").alias("booking_url"), none("string").alias("age_text"), none("array<string>").alias("age_labels"),
        none("array<string>").alias("topics"), none("array<string>").alias("own_topics"), F.when(series, F.lit("recurring series; this is its first date, not necessarily the next: check the venue")).alias("provenance"), none("double").alias("stated_price"), none("string").alias("stated_currency"),
    )
    return typed(found.filter("title IS NOT NULL AND begin IS NOT NULL"), [s for s in sources])


# ---- standing pages and hand-kept lists ----

#: Fixed: what a rule of a standing page may set.
SETTABLE = ("age_min", "age_max", "age_text", "price_text", "booking", "booking_url", "accompanied", "when_text", "audiences", "topics", "summary")


def scan_venue(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    """One standing event for each source's page: what its rules confirm is set, the rest is said not to be. A null page was refused."""
    for s in sources:
        for r in s.get("confirm", []):
            if bad := set(r.get("sets", {})) - set(SETTABLE):
                raise ValueError(f"{s['key']}: a rule may not set {sorted(bad)}")
    known, today = {s["key"]: s for s in sources}, now[:10]
    spark = docs.sparkSession
    fields = ", ".join(f"{c} {k}" for c, k in (("age_min", "int"), ("age_max", "int"), ("age_text", "string"), ("price_text", "string"), ("booking", "string"), ("booking_url", "string"), ("accompanied", "boolean"), ("when_text", "string"), ("summary", "string"), ("audiences", "array<string>"), ("topics", "array<string>")))
    registry = spark.createDataFrame([(k, s.get("title") or s["name"], s["name"], s["homepage"], s.get("venue_name") or s["name"], s.get("city"), s.get("summary"), s.get("schedule"), list(s.get("topics", []))) for k, s in known.items()], "source string, title string, source_name string, homepage string, venue_name string, city string, r_summary string, schedule string, r_topics array<string>")
    rules = rules_of(spark, sources, "confirm")
    expects = rules_of(spark, [{"key": s["key"], "expect": [{"phrase": p} for p in s.get("expect", [])]} for s in sources], "expect")
    none = "array<struct<rule_no: int, phrase: string, ok: boolean, sets: string>>"
    d = docs.join(F.broadcast(registry), "source").join(confirmed_rules(docs, rules), ["source", "page"], "left").join(confirmed_rules(docs, expects).withColumnRenamed("rules", "wanted"), ["source", "page"], "left")
    d = d.withColumns({c: F.coalesce(c, F.array().cast(none)) for c in ("rules", "wanted")})
    ok, no = F.filter("rules", lambda r: r["ok"]), F.filter("rules", lambda r: ~r["ok"])
    quoted = lambda a: F.array_join(F.transform(a, lambda r: F.concat(F.lit("“"), r["phrase"], F.lit("”"))), "; ")
    lost = F.filter("wanted", lambda r: ~r["ok"])
    refused = F.col("raw").isNull() | F.contains("raw", F.lit("unfetchable:"))
    said = F.coalesce(text.meta(F.col("raw"), "og:title"), text.title(F.col("raw")))
    sets = F.transform(ok, lambda r: F.from_json(r["sets"], fields))
    last = lambda c: F.try_element_at(F.array_compact(F.transform(sets, lambda s: s[c])), F.lit(-1))
    lists = lambda c: F.flatten(F.array_compact(F.transform(sets, lambda s: s[c])))
    summary = F.coalesce(last("summary"), text.meta(F.col("raw"), "og:description"), F.col("r_summary"))
    topics = F.array_sort(F.array_distinct(F.concat("r_topics", lists("topics"))))
    audiences = F.array_sort(F.array_distinct(F.array_compact(F.transform(lists("audiences"), text.map_audience))))
    d = d.withColumns({"_age": ages.age_range(last("age_text")), "_price": prices.price_info(last("price_text")), "_summary": summary, "_topics": topics})
    note = derive.narrative(
        F.concat(F.lit("Built from "), "homepage", F.lit(f" as fetched on {today}.")),
        F.when(F.lower(said) != F.lower("title"), F.concat(F.lit("The page calls itself “"), said, F.lit("”."))),
        F.when(F.size(lost) > 0, F.concat(F.lit("The page no longer mentions "), quoted(lost), F.lit(", so it may have been repurposed: check the link."))),
        F.when(F.size(ok) > 0, F.concat(F.lit("Confirmed on the page: "), quoted(ok), F.lit("."))),
        F.when(F.size(no) > 0, F.concat(F.lit("Not found on the page, so not claimed here: "), quoted(no), F.lit("."))),
        F.when(refused, F.lit("Automated access was refused, so nothing was confirmed: open the link and check.")),
    )
    stated = last("age_min").isNotNull() | last("age_max").isNotNull()
    null = lambda kind: F.lit(None).cast(kind)
    made = {
        "id": derive.stable_id(F.col("source"), F.col("homepage")), "url": F.col("homepage"), "start": F.lit(f"{today} 00:00:00").cast("timestamp_ntz"), "anytime": F.lit(True), "all_day": F.lit(True),
        "when_text": F.coalesce(last("when_text"), F.col("schedule")), "summary": F.col("_summary"), "price_text": last("price_text"), "is_free": F.col("_price.is_free"), "price_from": F.col("_price.price_from"), "currency": F.col("_price.currency"),
        "booking": last("booking"), "booking_url": last("booking_url"), "accompanied": last("accompanied"), "audiences": audiences, "age_text": last("age_text"), "topics": F.col("_topics"),
        "age_min": F.when(stated, last("age_min")).otherwise(F.col("_age.low")), "age_max": F.when(stated, last("age_max")).otherwise(F.col("_age.high")),
        "careers": careers(F.col("title"), F.col("_summary"), F.array_join("_topics", " "), last("age_text")), "work_styles": work_styles(F.col("title"), F.col("_summary")),
        "verified_on": F.when(~refused & (F.size(lost) == 0), F.lit(today)), "provenance": note, "status": F.lit("scheduled"), "online": F.lit(False), "ongoing": F.lit(False), "exhibition": F.lit(False),
    }
    kinds = dict(zip(EVENT_COLUMNS, [f.split(maxsplit=1)[1] if " " in f.strip() else "string" for f in EVENT_SCHEMA.replace("\n", " ").split(",")], strict=True))
    made["start"] = clock.iso(made["start"])
    return d.select(*[(made[c] if c in made else F.col(c) if c in d.columns else null(kinds[c].strip())).alias(c) for c in EVENT_COLUMNS])


def scan_curated(docs: DataFrame, sources: list[dict], now: str) -> DataFrame:
    """Hand-kept YAML (or JSON) lists of events: stated ages and tags before parsed ones."""

    def items(raw: str, cfg: dict, today: date) -> Iterator[dict]:
        import yaml

        for e in (yaml.safe_load(raw) or {}).get("events") or []:
            title = str(e.get("title") or "").strip()
            opens, _ = prose.read_times(e.get("time_text"))
            default = None if opens is None else at_minute(opens)
            start = prose.read_date(str(e["start"]) if e.get("start") is not None else None, today, default)
            if title:
                known = [a for a in ((e.get("audiences") or [])) if a]
                yield {
                    "ident": str(e.get("id") or e.get("url") or title), "title": title, "url": e.get("url") or "", "begin": start,
                    "finish": prose.read_date(str(e["end"]) if e.get("end") is not None else None, today, default), "all_day": bool(e.get("all_day", not e.get("time_text"))), "ongoing": bool(e.get("ongoing")),
                    "time_text": e.get("time_text"), "when_text": e.get("when_text"), "summary": e.get("summary"), "venue_name": e.get("venue_name"), "city": e.get("city"), "lat": e.get("lat"), "lon": e.get("lon"),
                    "online": bool(e.get("online")), "price_text": e.get("price_text"), "booking_url": e.get("booking_url"), "age_text": e.get("age_text"), "own_topics": list(e.get("topics") or []),
                    "provenance": json.dumps({"provenance": e.get("provenance"), "verified_on": str(e["verified_on"]) if e.get("verified_on") else None, "anytime": bool(e.get("anytime")), "audiences": known, "age_min": e.get("age_min"), "age_max": e.get("age_max"), "is_free": e.get("is_free"), "careers": e.get("careers"), "work_styles": e.get("work_styles")}),
                }

    e = typed(walked(docs, sources, now, items), sources, union_ages=True)
    j = lambda name, kind: F.from_json("provenance", f"{name} {kind}")[name]
    stated = {c: F.coalesce(j(c, k), F.col(c)) for c, k in (("age_min", "int"), ("age_max", "int"), ("careers", "array<string>"), ("work_styles", "array<string>"))}
    stated |= {"is_free": F.coalesce("is_free", j("is_free", "boolean")), "anytime": F.coalesce(j("anytime", "boolean"), F.lit(False)), "verified_on": j("verified_on", "string")}
    stated["audiences"] = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(j("audiences", "array<string>"), F.array().cast("array<string>")), text.map_audience))))
    return e.withColumns(stated).withColumn("provenance", j("provenance", "string"))


#: By kind; an unknown kind is an error that names the known ones.
SCANS = {"html": scan_html, "jsonld": scan_jsonld, "jsonapi": scan_jsonapi, "ics": scan_ics, "venue": scan_venue, "curated": scan_curated}


def scan(kind: str) -> Callable[[DataFrame, list[dict], str], DataFrame]:
    if kind not in SCANS:
        raise KeyError(f"unknown kind {kind!r}; known: {', '.join(sorted(SCANS))}")
    return SCANS[kind]


def scan_all(docs: DataFrame, sources: list[dict], now: str, only: set[str] | None = None) -> DataFrame:
    """All registered sources: one scan a kind over all its documents, united."""
    out = None
    for kind in sorted({s["kind"] for s in sources}):
        own = [s for s in sources if s["kind"] == kind and (not only or s["key"] in only)]
        if own:
            rows = scan(kind)(docs.filter(F.col("source").isin([s["key"] for s in own])), own, now)
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], EVENT_SCHEMA)


def registry(spark: SparkSession, path: str) -> list[dict]:
    """The registry's entries from YAML or JSON, read by Spark so that any store will do."""
    import yaml

    raw = "\n".join(r["value"] for r in spark.read.text(path).collect())
    doc = yaml.safe_load(raw) or []
    return doc.get("sources", []) if isinstance(doc, dict) else doc


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Events of the last snapshot; none if there is none. Lists that were dropped for being empty are empty again."""
    if not exists(spark, f"{path}/events"):
        return spark.createDataFrame([], EVENT_SCHEMA)
    events = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(f"{path}/events")
    return events.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in LIST_COLUMNS})


def published(spark: SparkSession, path: str, page: str | None = None) -> DataFrame:
    """What the query layer loads of a snapshot: rows with an id and a title, of one page if it is named."""
    events = snapshot(spark, path).filter((F.trim("id") != "") & (F.trim("title") != ""))
    return filters.page(events, page) if page else events
