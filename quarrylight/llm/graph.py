"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import stage

#: Edges (16 bytes each) that one task joins by itself; more are joined by star steps.
AT_ONCE = 500_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.array([find(x) for x in part], np.int64))], names=["node", "root"])


def _is_forest(e: DataFrame) -> bool:
    """Whether every node but the roots has one edge, to a root."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(node, root): every node of edges (a, b) but the roots, with the smallest node it reaches.

    Up to at_once edges, a size that one task holds, are joined by union-find. More of them take alternating
    large-star and small-star steps, whose number grows with the logarithm of the size: shuffles by key with partial
    aggregates and joins that Spark splits where a key is hot. Only counts reach the driver.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "components")
    if e.count() <= at_once:
        return stage(e.coalesce(1).mapInArrow(_union_find, "node long, root long"), "components")
    while not _is_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
