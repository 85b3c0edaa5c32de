"""Counts for the filters' choices, and sections of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .derive import city_key, running_now


def facet_city(events: DataFrame) -> DataFrame:
    return events.groupBy(city_key(F.col("online"), F.col("city")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def facet_kind(events: DataFrame) -> DataFrame:
    """any, once, running: always three rows, in that order."""
    run = F.coalesce(F.col("ongoing") | F.col("anytime"), F.lit(False))
    one = events.agg(F.count("*").alias("any"), F.count_if(~run).alias("once"), F.count_if(run).alias("running"))
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("value"), F.col(k).alias("n")) for i, k in enumerate(("any", "once", "running"))])
    return one.select(F.inline(rows)).orderBy("place")


def facet_list(events: DataFrame, column: str) -> DataFrame:
    """Values of a list column, commonest first, then by name."""
    return events.select(F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def sections(events: DataFrame, now) -> DataFrame:
    """section_no, label, n: what is on now first, then by the month of the start; without a start last."""
    on = running_now(F.col("start_ts"), F.col("end_ts"), F.col("anytime"), now)
    label = F.when(on, "On now").when(F.col("start_ts").isNull(), "Dates to confirm").otherwise(F.date_format("start_ts", "MMMM yyyy"))
    key = F.when(on, "").otherwise(F.coalesce(F.date_format("start_ts", "yyyy-MM"), F.lit("9999")))
    counts = events.groupBy(key.alias("_k"), label.alias("label")).agg(F.count("*").alias("n"))
    return counts.select(F.dense_rank().over(Window.orderBy("_k")).alias("section_no"), "label", "n")
