"""Labels given by a model: their cache on disk, what is left to ask, and the rewrite of the published rows.

A model isn't called here.  A run takes replies that were staged as JSON lines (key, reply), so it can be repeated and needs no network;
`to_classify` in `reconcile` says which texts to ask about.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, labels_of_reply
from ..sources.scans import snapshot
from ..taxonomy import CAREERS
from . import reconcile
from .storage import exists, replace, settle, stored

CACHE_SCHEMA = "key string, labels array<string>, model string, prompt_version string"
VERSION = "1"


def key_of(model: str, version: str) -> Column:
    return cache_key(F.lit(model), F.lit(version), F.col("title"), F.col("summary"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a cache; none where there is none yet."""
    return spark.read.schema(CACHE_SCHEMA).json(path) if exists(spark, path) else spark.createDataFrame([], CACHE_SCHEMA)


def write_cache(entries: DataFrame, path: str) -> None:
    """All entries in the place of what was there, as a whole."""
    entries.select("key", "labels", "model", "prompt_version").write.mode("overwrite").json(f"{path}.new")
    replace(entries.sparkSession, f"{path}.new", path)


def answered(cache: DataFrame, replies: DataFrame, model: str, version: str) -> DataFrame:
    """The cache with what replies (key, reply) say; a new answer takes the place of an old one, a reply that can't be read changes nothing."""
    new = replies.select("key", labels_of_reply(F.col("reply"), sorted(CAREERS)).alias("labels")).filter("labels IS NOT NULL")
    new = new.groupBy("key").agg(F.min("labels").alias("labels")).select("key", "labels", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"))
    return cache.join(new, "key", "left_anti").select("key", "labels", "model", "prompt_version").unionByName(new)


def retag_published(spark: SparkSession, path: str, cache: DataFrame, model: str, version: str, compression: str | None = None) -> DataFrame:
    """Rewrite a snapshot's events with the cache's labels; sources and header stay. Without entries nothing is touched.

    Only the entries are kept on the way: a cache that fits in memory goes to the events, which then aren't moved. They are read from
    one folder and written to another, which takes the first one's place when it is whole."""
    from .sinks import write_events

    live = cache.filter((F.col("model") == model) & (F.col("prompt_version") == version)).select("key", "labels")
    with stored(live) as entries:
        if entries.limit(1).count():
            write_events(reconcile.retag(snapshot(spark, path), entries, key_of(model, version)), f"{path}/events.new", compression)
            replace(spark, f"{path}/events.new", f"{path}/events")
    return snapshot(spark, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Take staged replies into the cache, list what is left to ask, rewrite the published rows.")
    p.add_argument("--snapshot", required=True)
    p.add_argument("--cache", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--replies", help="JSON lines of key, reply")
    p.add_argument("--ask", help="folder for the texts that are left to ask about")
    p.add_argument("--budget", "--limit", type=int, default=0, help="ask about so many at most (0: all)")
    p.add_argument("--recheck", action="store_true", help="ask about all texts again")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("eventmill").getOrCreate()
    cache = read_cache(spark, a.cache)
    if a.replies:
        cache = settle(answered(cache, spark.read.schema("key string, reply string").json(a.replies), a.model, VERSION))
        write_cache(cache, a.cache)
    if a.ask:
        known = cache.limit(0) if a.recheck else cache
        left = reconcile.to_classify(snapshot(spark, a.snapshot), known, key_of(a.model, VERSION), a.model, VERSION, a.budget or None)
        left.write.mode("overwrite").json(a.ask)
    print(json.dumps({"tagged": retag_published(spark, a.snapshot, cache, a.model, VERSION).filter(F.size("careers") > 0).count()}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
