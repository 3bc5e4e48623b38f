"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

1. quality: failing lines go, and documents that lose too much (or fail the base rule) go.
2. near-duplicates: one document of each group of similar ones stays.
3. repeated passages: words of 50-word windows that an earlier document has go.
4. decontamination: documents with a window like a benchmark item go.
5. pieces: the ids of each remaining text.

All stages but the last return the columns of documents; n_chars follows the text. A table with more columns keeps
them, whatever their names.

Each stage bounds the session's Arrow batches to BATCH bytes (unless the session has its own bound): the default holds
64 MB of texts for each running task, in the JVM outside its heap and again in Python.

Defined results: documents without a text, or with an empty one, fail the base rule of quality and go; of rows with one
doc_id and one text one stays, and different texts under one doc_id are documents of their own; a row with a null doc_id
links with nothing; an empty table gives an empty table of (doc_id, n_tokens, ids).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontam, neardup, passages, pieces, quality
from quarrylight.llm.store import documents, stage

BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _small_batches(step: Callable) -> Callable:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_CONF, None) is None:
            spark.conf.set(BATCH_CONF, str(BATCH))
        return step(spark, docs, sf_dir)

    return run_step


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the present text, and the columns in their first order."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*(F.col(f"`{c}`") for c in like.columns))


@_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(quality.clean(docs), docs)


@_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


@_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(passages.clean(docs), docs)


@_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_small_batches
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("pieces", piece_ids),
]
#: Automata, sketches and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written; the caller's Arrow setting is as it was afterwards."""
    before = spark.conf.get(BATCH_CONF, None)
    docs = documents(spark, sf_dir)
    try:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        if before is None:
            spark.conf.unset(BATCH_CONF)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {}
