"""Vector search and fusion of ranked lists.

Similarities are built-in array expressions, so a search is one scan with a top-k and no shuffle of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.scalar import positive_int

RRF_K = 60
FLOOR, CUTOFF, WINDOW, PASSAGES = 0.70, 0.94, 50, 5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_of(df: DataFrame, key: str, value: int, column: str = "embedding") -> list[float]:
    """One stored vector."""
    row = df.where(F.col(key) == value).select(column).first()
    if row is None:
        raise ValueError(f"no vector with {key} = {value}")
    return [float(x) for x in row[0]]


def scored(df: DataFrame, query: list[float]) -> DataFrame:
    """Rows with their score on the scale of 0 to 1: half of one plus the cosine."""
    return df.withColumn("score", (1 + cosine(F.col("embedding"), literal(query))) / 2)


def knn(df: DataFrame, query: list[float], k: int, where: Column | None = None, threshold: float | None = None, tie: str = "chunk_id") -> DataFrame:
    """The k nearest rows; filters come before the search, and a threshold after it."""
    rows = scored(df if where is None else df.where(where), query)
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), tie).limit(k)


def semantic_block(df: DataFrame, query: list[float], k: int = 1000, window: int = WINDOW, floor: float = FLOOR, cutoff: float = CUTOFF) -> DataFrame:
    """Studies by their best passage, those near enough to the best one: sid, score."""
    near = knn(df, query, k)
    best = near.groupBy("sid").agg(F.max("score").alias("score"))
    least = F.greatest(F.lit(floor), best.agg(F.max("score")).scalar() * cutoff)
    return best.where(F.col("score") >= least).orderBy(F.desc("score"), "sid").limit(window)


def passages(df: DataFrame, query: list[float], k: int = 1000, per_study: int = PASSAGES) -> DataFrame:
    """Best passage of each (resource, page) of a study, the best few of each study; pages count from 1."""
    near = knn(df.where("qfield = 'passages' AND page >= 0").withColumn("resource", positive_int(F.col("resource_id"))).where("resource IS NOT NULL"), query, k)
    one = Window.partitionBy("sid", "resource", "page").orderBy(F.desc("score"), "chunk_id")
    few = Window.partitionBy("sid").orderBy(F.desc("score"), "resource", "page")
    rows = near.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").withColumn("place", F.row_number().over(few)).where(F.col("place") <= per_study)
    return rows.select("sid", "place", "resource", (F.col("page") + 1).alias("page"), F.round("score", 4).alias("score"))


def rrf(lists: list[DataFrame], key: str, tie_first_seen: bool = False, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, pos from 1): key, score, order. Ties by key, or by first appearance."""
    rows = None
    for n, df in enumerate(lists):
        part = df.select(F.col(key), F.col("pos"), F.lit(n).alias("_list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy(key).agg(F.sum(1 / (k + F.col("pos"))).alias("score"), F.min(F.struct("_list", "pos")).alias("_seen"), F.array_sort(F.collect_set("_list")).alias("matched_by"))
    order = Window.orderBy(F.desc("score"), *(["_seen"] if tie_first_seen else [key]))  # lists are windows of bounded size
    return fused.select(key, "score", "matched_by", F.row_number().over(order).alias("pos"))


def head_and_tail(head: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    """The fused head, then what else the keyword search found: key, block, pos."""
    rest = tail.join(head.select(key), key, "left_anti")
    return head.select(key, F.lit(0).alias("block"), "pos").unionByName(rest.select(key, F.lit(1).alias("block"), "pos"))


def fuse(df: DataFrame, key: str, how: str = "mean") -> DataFrame:
    """One unit vector for each key: element-wise mean or maximum of its vectors."""
    pick = F.avg if how == "mean" else F.max
    parts = df.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(pick(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    fused = parts.groupBy(key).agg(vector.alias("v"))
    length = norm(F.col("v"))
    return fused.select(key, F.when(length == 0, F.col("v")).otherwise(F.transform("v", lambda x: x / length)).alias("embedding"))


def recommend(df: DataFrame, sid: int, k: int, exclude_seed: bool = True) -> DataFrame:
    """Chunks near the mean vector of all of a study's chunks."""
    own = df.where(F.col("sid") == sid)
    query = vector_of(fuse(own, "sid"), "sid", sid)
    return knn(df, query, k, F.col("sid") != sid if exclude_seed else None)
