"""Orders of a result. Ties end in the id, so an order is total; an unknown name keeps the publishing order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import settle
from .derive import price_key


def publish_order() -> list[Column]:
    return [F.coalesce("start", F.lit("9999")), F.col("title"), F.col("id")]


def order(by: str, collation: str | None = "en") -> list[Column]:
    start, text = F.coalesce("start", F.lit("9999")), F.coalesce("start", F.lit(""))
    named = {
        "date": [start],
        "closing": [F.coalesce("end", F.lit("9999")), start],
        "title": [F.collate("title", collation) if collation else F.col("title")],
        "price": [price_key(F.col("price_from"), F.col("is_free"))],
        "city": [F.coalesce("city", F.lit("")), text],
        "source": [F.col("source_name"), text],
    }
    return [*named[by], F.col("id")] if by in named else publish_order()


def ranked(rows: DataFrame, *by: Column, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in a total order, without a task that holds all of them.

    A range exchange sorts; each partition numbers its rows; partitions follow each other by a running sum over their sizes (a row a partition)."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    there = settle(rows.orderBy(*by).select("*", F.spark_partition_id().alias("_part"), local.alias("_local")))
    sizes = there.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return there.join(before, "_part").withColumn(name, F.col("_before") + F.col("_local") + 1).drop("_part", "_local", "_before")
