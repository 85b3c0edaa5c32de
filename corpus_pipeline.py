"""From documents to training batches: language ID, line dedup, near-duplicate removal, repeat removal, packing.

Each stage takes all that the one before kept; texts change with its decisions, and n_chars with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm import jaccard, language, lines, packing, repeats
from eventmill.llm.common import shared_folder


def like_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters (und) go. A low share of the first language is no reason: texts in several languages stay."""
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    out = language.identify(docs, model, with_spans=False)
    return out.filter(F.col("lang_pred") != language.NO_LETTER).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in the last only."""
    return like_documents(lines.dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without an id stay."""
    gone = jaccard.near_duplicates(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that occur earlier go."""
    out = repeats.remove_repeats(docs, keep=("kept_text",))
    return like_documents(out.withColumnRenamed("kept_text", "text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("packing", pack),
]

#: The language model and the removal of repeats have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
