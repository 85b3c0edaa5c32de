"""A catalogue of events derived from the star-schema tables, one per order: the test bed of the query layer.

All expressions are plain arithmetic, so that the same catalogue can be stated in SQL (`CATALOGUE_SQL`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import iso

#: The fixed clock of the test bed, London time.
NOW_LOCAL, NOW = "1998-06-01 12:00:00", "1998-06-01T12:00:00+01:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows before the range constraint; start_ts and end_ts are London wall clocks, start and end their ISO texts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"), F.min("l_partkey").alias("p_partkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    people = table(spark, sf_dir, "customer").join(places, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "r_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    rows = table(spark, sf_dir, "orders").join(people, "o_custkey").join(lines, "o_orderkey", "left").join(parts, "p_partkey", "left")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.timestamp_add("HOUR", (9 + k % 3).cast("int"), F.col("o_orderdate"))
    end = F.when(k % 3 == 0, F.timestamp_add("HOUR", F.lit(2), start)).when(k % 3 == 1, F.col("ship"))
    source = F.concat(F.lit("src_"), k % 5)
    free = k % 5 == 0
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    ages = [(None, None), (13, None), (16, None), (None, 12), (11, 16), (18, None)]
    pick = lambda i: F.coalesce(*[F.when(c % 6 == n, F.lit(a[i])) for n, a in enumerate(ages)]).cast("int")
    out = rows.select(
        F.concat(source, F.lit("-"), F.substring(F.sha1(F.concat(source, F.lit("|"), k.cast("string"))), 1, 12)).alias("id"),
        F.coalesce("p_name", F.lit("untitled")).alias("title"),
        F.concat(F.lit("https://"), source, F.lit(".example.org/e/"), k).alias("url"),
        source.alias("source"),
        F.concat(F.lit("Source "), k % 5).alias("source_name"),
        (10 * (k % 5 + 1)).cast("int").alias("priority"),
        start.alias("start_ts"), end.alias("end_ts"),
        (k % 50 == 0).alias("anytime"),
        F.when(k % 37 == 0, "cancelled").when(k % 41 == 0, "postponed").otherwise("scheduled").alias("status"),
        F.col("r_name").alias("city"), (F.col("c_mktsegment") == "MACHINERY").alias("online"),
        F.when(k % 7 == 0, None).when(free, 0.0).otherwise(F.floor(F.col("o_totalprice") / 10 + 0.5) / 100).alias("price_from"),
        F.when(k % 7 == 0, None).otherwise(free).alias("is_free"),
        pick(0).alias("age_min"), pick(1).alias("age_max"),
        F.when(c % 5 == 0, strings()).when(c % 5 == 1, strings("children")).when(c % 5 == 2, strings("families")).when(c % 5 == 3, strings("teens")).otherwise(strings("adults")).alias("audiences"),
        F.array_compact(F.array("p_type", "p_brand")).alias("topics"),
        F.when(k % 4 != 0, F.concat("p_type", F.lit(" "), "p_brand")).alias("summary"),
        F.when(k % 9 != 0, F.date_sub(F.lit("1998-06-01").cast("date"), (k % 150).cast("int"))).alias("verified_on"),
        k.alias("order_key"),
    )
    return out.withColumns({"start": iso(F.col("start_ts")), "end": iso(F.col("end_ts"))})


#: CTEs `raw` (before the range constraint) and `cat` (after it, with `ongoing`).
CATALOGUE_SQL = """
li AS (SELECT l_orderkey, max(l_shipdate) AS ship, min(l_partkey) AS pk FROM lineitem GROUP BY 1),
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'src_' || (o_orderkey % 5) AS source, r_name, c_mktsegment, o_totalprice, p_name, p_type, p_brand, ship,
    o_orderdate + to_hours(CAST(9 + o_orderkey % 3 AS BIGINT)) AS start_ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk),
timed AS (SELECT *, CASE k % 3 WHEN 0 THEN start_ts + INTERVAL 2 HOUR WHEN 1 THEN ship END AS end_ts FROM base),
raw AS (
  SELECT source || '-' || substr(sha1(source || '|' || k), 1, 12) AS id, coalesce(p_name, 'untitled') AS title,
    'https://' || source || '.example.org/e/' || k AS url, source, 'Source ' || (k % 5) AS source_name, CAST(10 * (k % 5 + 1) AS INT) AS priority,
    start_ts, end_ts, k % 50 = 0 AS anytime, CASE WHEN k % 37 = 0 THEN 'cancelled' WHEN k % 41 = 0 THEN 'postponed' ELSE 'scheduled' END AS status,
    r_name AS city, c_mktsegment = 'MACHINERY' AS online,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 0.0::DOUBLE ELSE floor(o_totalprice / 10 + 0.5) / 100 END AS price_from,
    CASE WHEN k % 7 = 0 THEN NULL ELSE k % 5 = 0 END AS is_free,
    CAST(CASE c % 6 WHEN 1 THEN 13 WHEN 2 THEN 16 WHEN 4 THEN 11 WHEN 5 THEN 18 END AS INT) AS age_min,
    CAST(CASE c % 6 WHEN 3 THEN 12 WHEN 4 THEN 16 END AS INT) AS age_max,
    CASE c % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['children'] WHEN 2 THEN ['families'] WHEN 3 THEN ['teens'] ELSE ['adults'] END AS audiences,
    list_filter([p_type, p_brand], lambda x: x IS NOT NULL) AS topics,
    CASE WHEN k % 4 <> 0 THEN p_type || ' ' || p_brand END AS summary,
    CASE WHEN k % 9 <> 0 THEN CAST(DATE '1998-06-01' - CAST(k % 150 AS INT) AS DATE) END AS verified_on, k AS order_key,
    strftime(start_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (start_ts AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' < start_ts THEN '+01:00' ELSE '+00:00' END AS start,
    strftime(end_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (end_ts AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC' < end_ts THEN '+01:00' ELSE '+00:00' END AS "end"
  FROM timed),
cat AS (
  SELECT * EXCLUDE ("end", end_ts), CASE WHEN "end" < start THEN NULL ELSE "end" END AS "end", CASE WHEN "end" < start THEN NULL ELSE end_ts END AS end_ts,
    coalesce(NOT ("end" < start) AND substr("end", 1, 10) <> substr(start, 1, 10), false) AS ongoing
  FROM raw)
"""
