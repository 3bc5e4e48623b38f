"""Executors that join keyword and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.operators.vectors import rrf

HEAD = 50


def _top(df: DataFrame, n: int) -> DataFrame:
    """(sid, pos): the n best of (sid, score)."""
    rows = df.orderBy(F.desc("score"), "sid").limit(n)
    return rows.select("sid", F.row_number().over(Window.orderBy(F.desc("score"), "sid")).alias("pos"))


def hybrid(keyword: DataFrame, semantic: DataFrame, studies: DataFrame, complete: DataFrame, types: list[str] | None = None, head: int = HEAD, ascending: bool = False) -> DataFrame:
    """(sid, block, pos, matched_by): the fused head, studies with a complete title first, then all other keyword matches.

    keyword and semantic: (sid, score) over all types; studies: (sid, dataset_type) that pass the other filters, which
    what the vectors found has to be among; complete: sids. types narrow the rows, not the head's ranks.
    """
    allowed = studies.select("sid", "dataset_type")
    near = semantic.join(allowed.select("sid"), "sid", "left_semi")
    fused = rrf([_top(keyword, head), _top(near, head)], "sid")
    marked = fused.join(complete.select("sid", F.lit(1).alias("_c")).distinct(), "sid", "left")
    order = Window.orderBy(F.coalesce("_c", F.lit(0)).desc(), "pos")  # a head has at most twice `head` rows
    names = F.transform("matched_by", lambda i: F.when(i == 0, "lexical").otherwise("semantic"))
    first = marked.select("sid", F.lit(0).alias("block"), F.row_number().over(order).cast("double").alias("pos"), names.alias("matched_by"))
    rest = keyword.join(F.broadcast(first.select("sid")), "sid", "left_anti")  # at most twice `head` rows
    # the tail's place is its score: it is as long as the keyword search's result, so nothing numbers it
    rows = first.unionByName(rest.select("sid", F.lit(1).alias("block"), (-F.col("score")).alias("pos"), F.array(F.lit("lexical")).alias("matched_by")))
    rows = rows.join(allowed, "sid")
    if types:
        rows = rows.where(F.col("dataset_type").isin(types))
    sign = -1 if ascending else 1
    return rows.select("sid", (F.col("block") * sign).alias("block"), (F.col("pos") * sign).alias("pos"), "matched_by", "dataset_type")


def type_totals(rows: DataFrame) -> DataFrame:
    """Matches of each type, of rows that no types filter has narrowed."""
    return rows.groupBy("dataset_type").agg(F.count("*").alias("n"))


def agreement(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """What both searches found."""
    return semantic.join(keyword.select("sid"), "sid", "left_semi")


def in_order(df: DataFrame, ids: list[int], key: str) -> DataFrame:
    """The rows of a list of ids, in its order: with `rank` from 1."""
    asked = df.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(ids)], f"{key} long, rank int")
    return df.join(F.broadcast(asked), key)


def summed(keyword: DataFrame, vectors: DataFrame, key: str, boost: float = 0.3) -> DataFrame:
    """(key, score): the keyword score times its boost plus the vector score, of what either search found."""
    a, b = keyword.select(key, F.col("score").alias("_k")), vectors.select(key, F.col("score").alias("_v"))
    zero: Column = F.lit(0.0)
    return a.join(b, key, "full").select(key, (F.coalesce("_k", zero) * boost + F.coalesce("_v", zero)).alias("score"))
