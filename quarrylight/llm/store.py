"""Tables between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.sources.scratch import shared

def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names."""
    return shared(spark, name)


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes df once and reads it back: cuts the lineage, and a lost executor costs no recomputation."""
    path = folder_for(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
