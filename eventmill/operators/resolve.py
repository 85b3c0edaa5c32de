"""Entity resolution: duplicates of an event across sources become one row, and gaps are filled, never overwritten.

One exchange by identity key does it: a window ranks a group's rows and takes, for each column, the first known value in rank order; the groups of columns
that belong together (ages, prices) travel as one struct from the first row that has any of them.  Groups are small
(one event in a few sources), so the window is bounded by what publishes an event, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LIST_COLUMNS

#: Fixed rules: columns that are never filled, columns that are filled together, columns whose defaults count as known.
NEVER = {"id", "source", "source_name", "url", "provenance", "link_status", "last_seen", "verified_on"}
TOGETHER = (("age_min", "age_max", "age_text"), ("price_text", "is_free", "price_from", "currency"))
FILLER = "the|a|an|of|and|for|with|to|in|on"
DEFAULT_PRIORITY = 50


def norm_title(title: Column) -> Column:
    """Lower case; anything but letters, digits and parentheses a space; filler words dropped; spaces collapsed."""
    t = F.regexp_replace(F.lower(title), "[^a-z0-9()]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"\b(?:{FILLER})\b", " "), r"\s+", " "))


def identity_key(events: DataFrame) -> Column:
    sep = F.lit("\x1f")
    start = F.nullif(F.col("start"), F.lit(""))
    return (
        F.when(start.isNull(), F.concat(F.lit("row"), sep, "id"))
        .when(F.col("anytime"), F.concat(F.lit("place"), sep, F.col("source"), sep, F.col("url")))
        .otherwise(F.concat(norm_title(F.col("title")), sep, F.substring(start, 1, 16), sep, F.lower(F.coalesce("city", F.lit("")))))
    )


def richness(events: DataFrame) -> Column:
    """Known details: seven texts, the sizes of two lists, a place on the map."""
    texts = [c for c in ("summary", "venue_name", "price_text", "booking_url", "time_text", "age_text", "end") if c in events.columns]
    score = F.lit(0)
    for c in texts:
        score = score + F.coalesce((F.length(F.col(f"`{c}`")) > 0).cast("int"), F.lit(0))
    for c in ("audiences", "topics"):
        if c in events.columns:
            score = score + F.greatest(F.size(c), F.lit(0))
    return score + F.col("lat").isNotNull().cast("int") if "lat" in events.columns else score


def merge_duplicates(events: DataFrame, priority: Column | None = None, strict: bool = False) -> DataFrame:
    """One row for each identity. priority: lower wins; then richness, then id.

    strict: of the columns filled together only the first that a donor has is taken from it, as if each were filled alone and the rest
    refused once one is there."""
    rank = F.coalesce(priority, F.lit(DEFAULT_PRIORITY)) if priority is not None else F.coalesce("priority", F.lit(DEFAULT_PRIORITY)) if "priority" in events.columns else F.lit(DEFAULT_PRIORITY)
    rows = events.withColumns({"_key": identity_key(events), "_rank": rank, "_rich": richness(events)})
    by = Window.partitionBy("_key").orderBy("_rank", F.desc("_rich"), "id")
    group = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c, ignorenulls=True).over(group)
    together = {c for g in TOGETHER for c in g}
    made: dict[str, Column] = {}
    for c in events.columns:
        col = F.col(f"`{c}`")
        if c in LIST_COLUMNS:
            union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(col, F.array().cast(events.schema[c].dataType))).over(group))))
            made[c] = F.when(F.count("*").over(group) > 1, union).otherwise(col)  # sorted only if merged
        elif c not in NEVER and c not in together:
            made[c] = first(col)
    for g in TOGETHER:
        own = [c for c in g if c in events.columns]
        if not own:
            continue
        known = F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in own]).isNotNull()
        donor = first(F.when(known, F.struct(*own)))
        winner_has = F.first(known).over(group)
        for i, c in enumerate(own):
            taken = donor[c]
            if strict:
                earlier = [donor[x].isNull() for x in own[:i]]
                alone = earlier[0] if earlier else F.lit(True)
                for e in earlier[1:]:
                    alone = alone & e
                taken = F.when(winner_has | alone, taken)
            made[c] = taken
    losers = F.collect_set(F.when(F.col("_n") > 1, F.col("source"))).over(group)
    rows = rows.withColumn("_n", F.row_number().over(by)).withColumns({f"_m_{c}": v for c, v in made.items()}).withColumns({"_also": F.array_sort(losers), "_size": F.count("*").over(group)})
    note = F.when(F.col("_size") > 1, F.concat(F.lit("also listed by "), F.array_join("_also", ", ")))
    said = F.nullif(F.col("provenance"), F.lit("")) if "provenance" in events.columns else F.lit(None).cast("string")
    out = [F.col(f"_m_{c}").alias(c) if c in made else F.col(f"`{c}`") for c in events.columns if c != "provenance"]
    return rows.filter("_n = 1").select(*out, F.nullif(F.concat_ws("; ", said, note), F.lit("")).alias("provenance"))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in arrival order; an aggregate, so it needs no sort: the least struct of (order, row)."""
    least = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_k")).agg(least.alias("_r")).select("_r.*")
