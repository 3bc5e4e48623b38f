"""Distinct counts by sketches that are stored and merged.

A sketch of LG registers (a power of two) has a relative standard error of about 1.04 / sqrt(2 ** LG); small sets are
counted exactly. Sketches of parts are merged without looking at their rows again, so a table that grows needs one new
sketch for what was added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 14
ERROR = 1.04 / 2 ** (LG / 2)


def sketched(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, sketch): the distinct values of each group, null ones left out; partial sketches are merged in the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(LG)).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups, or of all."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("n", F.hll_sketch_estimate("sketch")).drop("sketch")
