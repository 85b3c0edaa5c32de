"""Incremental runs on Structured Streaming: raw documents arrive as files, each micro-batch is one collection run.

A micro-batch is scanned and its rows written as a version, named by its batch id, so a batch that is repeated after a failure writes the
same version again.  Reconciling versions with the last snapshot is a batch run's work (`plans.build`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scans

DOCUMENTS = "source string, page int, raw string"


def documents(spark: SparkSession, path: str, files_per_run: int = 1000) -> DataFrame:
    """A stream of raw documents as JSON lines."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_run).json(path)


def collect(stream: DataFrame, sources: list[dict], now: Callable[[], str], publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that scans each micro-batch and hands its event rows to `publish` with the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        publish(scans.scan_all(batch, sources, now()), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_versions(path: str) -> Callable[[DataFrame, int], None]:
    """Publish each run as a version of its own: written once, replaced if the batch is repeated."""

    def publish(events: DataFrame, number: int) -> None:
        events.withColumn("run", F.lit(number)).write.mode("overwrite").parquet(f"{path}/run={number:08d}")

    return publish
