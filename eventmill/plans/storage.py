"""The folder that the cluster shares: cutting a plan's lineage there, and replacing what lies there as a whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and one machine does all the work, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="eventmill_")


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """Rows worked out once, into a file in the shared folder, so that the planner knows their true size; gone in the end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        fs, at = located(spark, path)
        fs.delete(at, True)


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = located(spark, path)
    return fs.exists(at)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder `new` in the place of `path`. What was there comes back if that fails."""
    fs, at = located(spark, path)
    side, old = located(spark, new)[1], located(spark, f"{path}.old")[1]

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"can't move {a} to {b}")

    was = fs.exists(at)
    if was:
        fs.delete(old, True)
        move(at, old)
    try:
        move(side, at)
    except Exception:
        if was:
            move(old, at)
        raise
    fs.delete(old, True)
