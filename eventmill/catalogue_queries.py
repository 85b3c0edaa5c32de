"""Queries over the derived catalogue: the query layer, entity resolution, reconciliation, verification.

Each has its SQL beside it; `QUERIES` and `ORACLE` are filled by the decorator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clock
from .operators import derive, facets, filters, orders, resolve
from .sources.catalogue import CATALOGUE_SQL, NOW, NOW_LOCAL, catalogue, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AGE = 14


def now():
    return F.lit(NOW_LOCAL).cast("timestamp_ntz")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue(spark, sf_dir)
    return derive.range_sane(rows.withColumn("ongoing", derive.ongoing(F.col("start"), F.col("end"))))


def query(sql: str | None, name: str | None = None, base: bool = True):
    """Register a query by its function's name. base: the SQL is over the catalogue's CTEs."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            sep = "," if sql.lstrip().startswith("+") else ""
            ORACLE[key] = f"WITH {CATALOGUE_SQL}{sep}{sql.lstrip().lstrip('+')}" if base else sql
        return f

    return add




def S():  # noqa: N802
    return F.col("start_ts")


def E():  # noqa: N802
    return F.col("end_ts")


def ANY():  # noqa: N802
    return F.col("anytime")


def RUN():  # noqa: N802
    return F.col("ongoing")


SQL_NOW = "TIMESTAMP '1998-06-01 12:00:00'"
SQL_RUNNING = f"(anytime OR coalesce(start_ts <= {SQL_NOW} AND end_ts >= {SQL_NOW}, false))"
SQL_CURRENT = "(anytime OR coalesce(end_ts >= TIMESTAMP '1998-06-01 06:00:00', false) OR coalesce(start_ts >= TIMESTAMP '1998-06-01 06:00:00', false))"


@query(f"""SELECT id, title, start, "end" AS end_iso, city FROM cat
WHERE status = 'scheduled' AND {SQL_CURRENT} AND coalesce(start, '') <= '1999-07-06T12:00:00+01:00'""")
def scan_filter_upcoming(spark, sf_dir):
    e = events(spark, sf_dir)
    until = clock.iso(F.timestamp_add("DAY", F.lit(400), now()))
    e = e.filter(filters.is_current(S(), E(), ANY(), now())).filter(filters.within_horizon(F.col("start"), until)).filter("status = 'scheduled'")
    return e.orderBy(*orders.publish_order()).select("id", "title", "start", F.col("end").alias("end_iso"), "city")


def window_query(key: str, when: str, since: str = "", until: str = ""):
    low = f"TIMESTAMP '{since or '1998-06-01'} 00:00:00'"
    high = {"custom": f"TIMESTAMP '{until} 23:59:59'"}.get(when, f"TIMESTAMP '1998-06-01' + INTERVAL {when if when.isdigit() else 0} DAY")
    upper = "true" if when == "all" else f"start_ts <= {high}"

    @query(f"SELECT id, start FROM cat WHERE start_ts IS NULL OR ({upper} AND coalesce(end_ts, start_ts) >= {low})", key)
    def run(spark, sf_dir):
        a, b = filters.window_bounds(when, NOW, since, until)
        return events(spark, sf_dir).filter(filters.in_window(S(), E(), a, b)).select("id", "start")


for _key, _args in {"7": ("7",), "30": ("30",), "90": ("90",), "all": ("all",), "custom": ("custom", "1998-07-01", "1998-08-15")}.items():
    window_query(f"date_window_{_key}", *_args)


@query("SELECT id, source FROM cat WHERE NOT (ongoing OR anytime)")
def kind_once(spark, sf_dir):
    return events(spark, sf_dir).filter(filters.kind_is("once", RUN(), ANY())).select("id", "source")


@query("SELECT id, source FROM cat WHERE ongoing OR anytime")
def kind_running(spark, sf_dir):
    return events(spark, sf_dir).filter(filters.kind_is("running", RUN(), ANY())).select("id", "source")


@query(f"SELECT id, anytime FROM cat WHERE {SQL_RUNNING}")
def running_now(spark, sf_dir):
    return events(spark, sf_dir).filter(derive.running_now(S(), E(), ANY(), now())).select("id", "anytime")


@query(f"""SELECT id, CAST(greatest(floor(epoch(end_ts - TIMESTAMP '1998-06-01') / 86400) + 1, 1) AS INT) AS days_left FROM cat
WHERE ongoing AND NOT anytime AND {SQL_RUNNING} AND floor(epoch(end_ts - TIMESTAMP '1998-06-01') / 86400) + 1 <= 14""")
def closing_within(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("days_left", derive.closes_within(S(), E(), RUN(), ANY(), now(), 14))
    return e.filter("days_left IS NOT NULL").select("id", "days_left")


SQL_ELIGIBLE = """CASE WHEN 14 < age_min OR 14 > age_max THEN 'excluded' WHEN audiences = ['children'] THEN 'excluded'
  WHEN age_min IS NOT NULL OR age_max IS NOT NULL THEN 'eligible' WHEN list_contains(audiences, 'teens') THEN 'eligible'
  WHEN list_contains(audiences, 'families') THEN 'eligible' ELSE 'unknown' END"""


@query(f"SELECT id, {SQL_ELIGIBLE} AS state FROM cat")
def eligibility_by_age(spark, sf_dir):
    return events(spark, sf_dir).select("id", derive.eligibility(F.col("age_min"), F.col("age_max"), F.col("audiences"), AGE).alias("state"))


@query(f"SELECT id, age_min, age_max FROM cat WHERE {SQL_ELIGIBLE} = 'eligible'")
def eligible_only(spark, sf_dir):
    e = events(spark, sf_dir).filter(filters.age_allows(F.col("age_min"), F.col("age_max"), F.col("audiences"), AGE, True))
    return e.select("id", "age_min", "age_max")


@query(f"SELECT id FROM cat WHERE {SQL_ELIGIBLE} <> 'excluded'")
def age_not_excluded(spark, sf_dir):
    return events(spark, sf_dir).filter(filters.age_allows(F.col("age_min"), F.col("age_max"), F.col("audiences"), AGE)).select("id")


@query("SELECT id, CASE WHEN online THEN 'Online' ELSE coalesce(nullif(city, ''), 'Other') END AS place FROM cat WHERE place IN ('ASIA', 'Online')")
def city_filter(spark, sf_dir):
    place = derive.city_key(F.col("online"), F.col("city")).alias("place")
    return events(spark, sf_dir).filter(filters.in_city(F.col("online"), F.col("city"), ["ASIA", "Online"])).select("id", place)


@query("SELECT id, array_to_string(topics, '|') AS topics FROM cat WHERE list_has_any(topics, ['Brand#11', 'Brand#23', 'ECONOMY'])")
def topic_overlap(spark, sf_dir):
    e = events(spark, sf_dir).filter(filters.any_of(F.col("topics"), ["Brand#11", "Brand#23", "ECONOMY"]))
    return e.select("id", F.array_join("topics", "|").alias("topics"))


@query("SELECT id, price_from FROM cat WHERE is_free IS NOT DISTINCT FROM true")
def free_only(spark, sf_dir):
    return events(spark, sf_dir).filter(filters.is_free(F.col("is_free"))).select("id", "price_from")


@query("SELECT id, start FROM cat WHERE isodow(start_ts) >= 6")
def weekend_london(spark, sf_dir):
    return events(spark, sf_dir).filter(filters.on_weekend(S(), F.lit(False))).select("id", "start")


SQL_HAY = "lower(concat_ws(' ', title, summary, city, source_name, array_to_string(topics, ' ')))"


@query(f"SELECT id, title FROM cat WHERE contains({SQL_HAY}, 'brand#1') AND contains({SQL_HAY}, 'asia')")
def search_all_terms(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.filter(filters.has_all_terms(derive.haystack(e), "Brand#1 Asia")).select("id", "title")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(coalesce(text, '')), 'licen') AND contains(lower(coalesce(text, '')), 'apache')", base=False)
def search_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(filters.has_all_terms(F.lower(F.coalesce("text", F.lit(""))), "licen apache")).select("doc_id", "source")


@query("SELECT id, title FROM cat WHERE id IN (SELECT id FROM cat WHERE order_key % 11 = 0)")
def saved_semi(spark, sf_dir):
    e = events(spark, sf_dir)
    return filters.only_saved(e, e.filter("order_key % 11 = 0")).select("id", "title")


@query("SELECT id, title FROM cat WHERE id NOT IN (SELECT id FROM cat WHERE order_key % 13 = 0)")
def hidden_anti(spark, sf_dir):
    e = events(spark, sf_dir)
    return filters.without_hidden(e, e.filter("order_key % 13 = 0")).select("id", "title")


SQL_EXHIBITION = "(ongoing AND NOT anytime AND list_has_any(topics, ['Brand#11', 'Brand#12', 'Brand#13']))"


def flagged(spark, sf_dir) -> DataFrame:
    wanted = F.array(*map(F.lit, ("Brand#11", "Brand#12", "Brand#13")))
    return events(spark, sf_dir).withColumn("exhibition", derive.exhibition(RUN(), ANY(), F.col("topics"), wanted))


@query(f"SELECT id, {SQL_EXHIBITION} AS exhibition FROM cat")
def exhibition_flag(spark, sf_dir):
    return flagged(spark, sf_dir).select("id", "exhibition")


@query(f"SELECT CASE WHEN {SQL_EXHIBITION} THEN 'exhibitions' ELSE 'events' END AS page, count(*) AS n, min(start) AS first_start FROM cat GROUP BY 1")
def page_split(spark, sf_dir):
    e = flagged(spark, sf_dir)
    both = filters.page(e, "exhibitions").withColumn("page", F.lit("exhibitions")).unionByName(filters.page(e, "events").withColumn("page", F.lit("events")))
    return both.groupBy("page").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


SQL_ORDERS = {
    "date": "coalesce(start, '9999')",
    "closing": "coalesce(\"end\", '9999'), coalesce(start, '9999')",
    "title": "title",
    "price": "coalesce(price_from, CASE WHEN is_free THEN 0 ELSE 1e9 END)",
    "city": "coalesce(city, ''), coalesce(start, '')",
    "source": "source_name, coalesce(start, '')",
    "publish": "coalesce(start, '9999'), title",
}


def sort_query(by: str, order: str):
    @query(f"SELECT id, row_number() OVER (ORDER BY {order}, id) AS place FROM cat", f"sort_{by}")
    def run(spark, sf_dir):
        return orders.ranked(events(spark, sf_dir).select("id", "title", "start", "end", "city", "source_name", "price_from", "is_free"), *orders.order(by, None)).select("id", "place")


for _by, _order in SQL_ORDERS.items():
    sort_query(_by, _order)


@query("SELECT CASE WHEN online THEN 'Online' ELSE coalesce(nullif(city, ''), 'Other') END AS value, count(*) AS n FROM cat GROUP BY 1")
def facet_city(spark, sf_dir):
    return facets.facet_city(events(spark, sf_dir))


@query("""SELECT 0 AS place, 'any' AS value, count(*) AS n FROM cat UNION ALL SELECT 1, 'once', count(*) FILTER (NOT (ongoing OR anytime)) FROM cat
UNION ALL SELECT 2, 'running', count(*) FILTER (ongoing OR anytime) FROM cat""")
def facet_kind(spark, sf_dir):
    return facets.facet_kind(events(spark, sf_dir))


@query("SELECT value, count(*) AS n FROM (SELECT id, unnest(list_distinct(topics)) AS value FROM cat) GROUP BY 1")
def facet_topics(spark, sf_dir):
    return facets.facet_list(events(spark, sf_dir), "topics")


SQL_SHOWN = f"""status = 'scheduled' AND {SQL_ELIGIBLE} <> 'excluded' AND (start_ts IS NULL OR (start_ts <= TIMESTAMP '1998-08-30' AND coalesce(end_ts, start_ts) >= TIMESTAMP '1998-06-01'))"""


def shown(spark, sf_dir) -> DataFrame:
    from .plans.query import QuerySpec, apply

    return apply(events(spark, sf_dir), QuerySpec(age=AGE, when="90"), NOW)


@query(f"SELECT value, count(*) AS n FROM (SELECT id, unnest(list_distinct(topics)) AS value FROM cat WHERE {SQL_SHOWN}) GROUP BY 1")
def facet_live(spark, sf_dir):
    return facets.facet_list(shown(spark, sf_dir), "topics")


@query(f"""SELECT count(*) FILTER ({SQL_SHOWN}) AS shown, count(*) AS total FROM cat""")
def result_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    from .plans.query import QuerySpec, predicate

    return e.agg(F.count_if(predicate(e, QuerySpec(age=AGE, when="90"), NOW)).alias("shown"), F.count("*").alias("total"))


@query(f"""SELECT CAST(dense_rank() OVER (ORDER BY k) AS INT) AS section_no, label, n FROM (
SELECT CASE WHEN {SQL_RUNNING} THEN '' ELSE strftime(start_ts, '%Y-%m') END AS k, CASE WHEN {SQL_RUNNING} THEN 'On now' ELSE strftime(start_ts, '%B %Y') END AS label, count(*) AS n
FROM cat WHERE {SQL_SHOWN} GROUP BY 1, 2)""")
def sections_by_month(spark, sf_dir):
    return facets.sections(shown(spark, sf_dir), now())


@query("SELECT id, source, order_key FROM raw")
def stable_id(spark, sf_dir):
    e = catalogue(spark, sf_dir)
    return e.select(derive.stable_id(F.col("source"), F.col("order_key").cast("string")).alias("id"), "source", "order_key")


SQL_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9()]+', ' ', 'g'), '\b(the|a|an|of|and|for|with|to|in|on)\b', ' ', 'g'), '\s+', ' ', 'g'))"
SQL_KEY = f"""CASE WHEN start IS NULL THEN 'row' || chr(31) || id WHEN anytime THEN 'place' || chr(31) || source || chr(31) || url
  ELSE {SQL_NORM} || chr(31) || substr(start, 1, 16) || chr(31) || lower(coalesce(city, '')) END"""
SQL_RICH = "CAST((summary IS NOT NULL AND summary <> '') AS INT) + CAST((\"end\" IS NOT NULL AND \"end\" <> '') AS INT) + len(audiences) + len(topics)"


@query(f"SELECT id, {SQL_KEY} AS key FROM cat")
def identity_key(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("id", resolve.identity_key(e).alias("key"))


@query(f"SELECT id, CAST({SQL_RICH} AS INT) AS richness FROM cat")
def richness(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("id", resolve.richness(e).cast("int").alias("richness"))


@query(f"""+ m AS (SELECT *, {SQL_KEY} AS key, {SQL_RICH} AS rich FROM cat),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, -rich, id) AS rn FROM m)
SELECT first(id ORDER BY rn) AS id, first(status ORDER BY rn) AS status, first(summary ORDER BY rn) FILTER (summary IS NOT NULL) AS summary,
  first("end" ORDER BY rn) FILTER ("end" IS NOT NULL) AS end_iso,
  first(price_from ORDER BY rn) FILTER (is_free IS NOT NULL OR price_from IS NOT NULL) AS price_from,
  first(is_free ORDER BY rn) FILTER (is_free IS NOT NULL OR price_from IS NOT NULL) AS is_free,
  first(age_min ORDER BY rn) FILTER (age_min IS NOT NULL OR age_max IS NOT NULL) AS age_min,
  first(age_max ORDER BY rn) FILTER (age_min IS NOT NULL OR age_max IS NOT NULL) AS age_max,
  CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list_distinct(flatten(list(topics)))), '|') ELSE array_to_string(first(topics ORDER BY rn), '|') END AS topics,
  CASE WHEN count(*) > 1 THEN 'also listed by ' || array_to_string(list_sort(list_distinct(list(source) FILTER (rn > 1))), ', ') END AS provenance
FROM r GROUP BY key""")
def merge_duplicates(spark, sf_dir):
    m = resolve.merge_duplicates(events(spark, sf_dir))
    return m.select("id", "status", "summary", F.col("end").alias("end_iso"), "price_from", "is_free", "age_min", "age_max", F.array_join("topics", "|").alias("topics"), "provenance")


@query("SELECT title, first(id ORDER BY order_key) AS id, min(order_key) AS order_key FROM cat GROUP BY title")
def first_wins_dedup(spark, sf_dir):
    return resolve.first_wins(events(spark, sf_dir).select("title", "id", "order_key"), "title", "order_key")


@query("""SELECT id, start, CASE WHEN "end" < start THEN NULL ELSE "end" END AS end_iso,
coalesce(NOT ("end" < start) AND substr("end", 1, 10) <> substr(start, 1, 10), false) AS ongoing, coalesce("end" < start, false) AS dropped FROM raw""")
def range_constraint(spark, sf_dir):
    rows = catalogue(spark, sf_dir).withColumns({"ongoing": derive.ongoing(F.col("start"), F.col("end")), "provenance": F.lit(None).cast("string")})
    e = derive.range_sane(rows)
    return e.select("id", "start", F.col("end").alias("end_iso"), "ongoing", F.col("provenance").isNotNull().alias("dropped"))


SQL_WHEN = """CASE WHEN ongoing AND end_ts > start_ts + INTERVAL 1 DAY THEN CASE WHEN year(start_ts) <> year(end_ts) THEN strftime(start_ts, '%-d %b %Y') || ' – ' || strftime(end_ts, '%-d %b %Y')
    ELSE strftime(start_ts, '%a %-d %b') || ' – ' || strftime(end_ts, '%a %-d %b') END
  ELSE strftime(start_ts, '%a %-d %b, %H:%M') || CASE WHEN end_ts < start_ts + INTERVAL 1 DAY THEN '–' || strftime(end_ts, '%H:%M') ELSE '' END END"""


@query(f"SELECT id, {SQL_WHEN} AS label FROM cat")
def when_label(spark, sf_dir):
    return events(spark, sf_dir).select("id", clock.when_label(S(), E(), RUN(), F.lit(False), F.lit(None).cast("string")).alias("label"))


@query(f"""SELECT {SQL_WHEN} AS "when", title AS event, city AS "where", '—' AS age, CASE WHEN is_free THEN 'Free' ELSE '—' END AS price, '' AS subject, '' AS ways, source_name AS source
FROM cat WHERE {SQL_SHOWN}""")
def table_view(spark, sf_dir):
    from .plans.sinks import table_view as view

    return view(shown(spark, sf_dir))


@query("""SELECT id, CASE WHEN verified_on IS NULL THEN 'never' WHEN DATE '1998-06-01' - verified_on > 90 THEN 'expired' ELSE 'ok' END AS state,
  CAST(DATE '1998-06-01' - verified_on AS INT) AS days FROM cat""")
def verification_state(spark, sf_dir):
    e = events(spark, sf_dir)
    today = F.lit(NOW[:10]).cast("date")
    return e.select("id", derive.verification(F.lit("by hand"), F.col("verified_on"), today).alias("state"), F.datediff(today, "verified_on").alias("days"))


@query("""SELECT source, count(*) AS entries, count(*) FILTER (verified_on IS NOT NULL AND DATE '1998-06-01' - verified_on <= 90) AS verified,
  count(*) FILTER (verified_on IS NULL OR DATE '1998-06-01' - verified_on > 90) AS unverified,
  count(*) FILTER (DATE '1998-06-01' - verified_on > 90) AS overdue, bool_and(coalesce(DATE '1998-06-01' - verified_on <= 90, false)) AS ok FROM cat GROUP BY source""")
def verification_rollup(spark, sf_dir):
    from .plans.verify import roll_up

    return roll_up(events(spark, sf_dir), F.lit(NOW[:10]).cast("date"))


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN {SQL_ELIGIBLE} = 'eligible' THEN 'Suits 14' ELSE 'No stated age limit' END,
  CASE WHEN list_contains(audiences, 'children') AND NOT list_contains(audiences, 'teens') THEN 'aimed at younger children' END,
  CASE WHEN anytime THEN 'No fixed date' WHEN ongoing THEN 'Runs over several days' END,
  CASE WHEN ongoing AND NOT anytime AND {SQL_RUNNING} AND floor(epoch(end_ts - TIMESTAMP '1998-06-01') / 86400) + 1 <= 14 THEN
    CASE WHEN floor(epoch(end_ts - TIMESTAMP '1998-06-01') / 86400) + 1 <= 1 THEN 'Last day' ELSE 'Last ' || CAST(floor(epoch(end_ts - TIMESTAMP '1998-06-01') / 86400) + 1 AS INT) || ' days' END END,
  CASE WHEN is_free THEN 'Free' END, CASE WHEN online THEN 'Online option' END, CASE WHEN status <> 'scheduled' THEN status END], lambda x: x IS NOT NULL), '|') AS badges FROM cat""")
def card_badges(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("id", F.array_join(derive.badges(e, AGE, now()), "|").alias("badges"))


@query("""SELECT city, count(*) AS n, count(*) FILTER (list_contains(audiences, 'families')) AS families, CAST(sum(CAST(round(price_from * 100) AS BIGINT)) FILTER (NOT is_free) AS BIGINT) AS paid_pence FROM cat WHERE anytime = false GROUP BY city""")
def city_totals(spark, sf_dir):
    e = events(spark, sf_dir).filter(filters.calendar_able(S(), ANY()))
    return e.groupBy("city").agg(F.count("*").alias("n"), F.count_if(F.array_contains("audiences", "families")).alias("families"), F.sum(F.when(~F.col("is_free"), F.round(F.col("price_from") * 100).cast("long"))).alias("paid_pence"))
