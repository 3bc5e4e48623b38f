"""Vectors in cells: a stored partition of a table by nearest centroid, so that a search reads a few cells.

Centroids are fitted by k-means on at most SAMPLE vectors (by hash of their key), on unit length; every row is then put
to its nearest one, and written by cell. A search reads the cells nearest to the query, under any filter, until it has
enough rows, and ranks these by exact cosine. `exact` goes on: with the k-th distance known, it also reads each cell that
by the triangle inequality could hold a nearer row (its centroid's distance less its radius), so nothing is missed.
Vectors without a length have no cosine and are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.vectors import norm, scored
from quarrylight.sources.commits import Commits, Taken, fingerprint

#: Vectors that centroids are fitted on, at most; rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Rows of candidates for each row asked for, and cells that are read first.
ENOUGH, PROBES = 5, 8
#: Number of this layout.
FORMAT = 2
_CELL = "cell int, centre array<double>, radius double, n long"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(df: DataFrame, key: str, cells: int, column: str = "embedding") -> np.ndarray:
    """Centroids of unit length from a bounded sample, the rows with the smallest hash of their key."""
    rows = df.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(column).collect()
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r[0] for r in rows], np.float64))
    centre = x[: min(cells, len(x))]
    for _ in range(ROUNDS):
        owner = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, owner, x)
        centre = np.where(np.bincount(owner, minlength=len(centre))[:, None] > 0, _unit(sums), centre)
    return centre


class Cells:
    """A stored partition in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Commits(spark, root)
        at = self.log.read()
        self.version, self.state = at if at else (0, {})
        if at:
            rows = sorted(self.spark.read.schema(_CELL).parquet(f"{self.state['path']}/cells").collect())  # a row for each cell
            self.ids = np.array([r.cell for r in rows], int)
            self.centre = np.array([r.centre for r in rows], np.float64)
            self.radius = np.array([r.radius for r in rows], np.float64)
            self.table = self.spark.read.schema(self.state["schema"]).parquet(f"{self.state['path']}/rows")

    def build(self, df: DataFrame, key: str, cells: int = 64, column: str = "embedding") -> Cells:
        kept = df.where(F.col(column).isNotNull()).where(norm(F.col(column)) > 0)
        centre = fit(kept, key, cells, column)
        path = f"{self.root}/v{self.version + 1}"

        def run(batches):
            for batch in batches:
                x = batch.column(column)
                v = _unit(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1))
                near = v @ centre.T
                cell = near.argmax(1)
                far = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(v)), cell]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        placed = kept.mapInArrow(run, f"{schema}, cell int, far double")
        # by ranges of (cell, key): a cell with most of the rows is written by many tasks
        placed.repartitionByRange("cell", key).write.mode("overwrite").partitionBy("cell").option("compression", "zstd").parquet(f"{path}/rows")
        schema = f"{schema}, far double, cell int"
        radius = self.spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(i, c) for i, c in enumerate(centre.tolist())], "cell int, centre array<double>")
        radius.join(F.broadcast(known), "cell").select("cell", "centre", "radius", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        self.log.commit(self.version + 1, {"path": path, "schema": schema})
        return Cells(self.spark, self.root)

    def _far(self, query: list[float]) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(0)
        q = _unit(np.array([query], np.float64))
        return np.sqrt(np.maximum(0, 2 - 2 * (self.centre @ q.T)[:, 0]))

    def _read(self, which: np.ndarray, where: Column | None) -> DataFrame:
        rows = self.table.where(F.col("cell").isin([int(self.ids[i]) for i in which]))
        return rows if where is None else rows.where(where)

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int = PROBES, tie: str = "chunk_id") -> DataFrame:
        """The k nearest rows of the nearest cells; more cells are read until ENOUGH * k rows pass the filter."""
        order = np.argsort(self._far(query), kind="stable")
        while probes < len(order) and self._read(order[:probes], where).limit(ENOUGH * k).count() < ENOUGH * k:
            probes *= 2
        return scored(self._read(order[:probes], where), query).orderBy(F.desc("score"), tie).limit(k)

    def exact(self, query: list[float], k: int, where: Column | None = None, probes: int = PROBES, tie: str = "chunk_id") -> DataFrame:
        """The k nearest rows of all."""
        far = self._far(query)
        order = np.argsort(far, kind="stable")
        scores = [r.score for r in scored(self._read(order[:probes], where), query).orderBy(F.desc("score")).limit(k).select("score").collect()]
        reach = np.sqrt(max(0.0, 4 - 4 * scores[-1])) if len(scores) == k else np.inf  # distance of unit vectors with that score
        able = np.flatnonzero(far - self.radius <= reach + 1e-9)
        return scored(self._read(able, where), query).orderBy(F.desc("score"), tie).limit(k)


def stored(df: DataFrame, key: str, folder: str, cells: int = 64) -> Cells:
    """The cells of a table that files hold, under `folder`; built if they aren't there for just these files."""
    root = f"{folder.rstrip('/')}/cells-{fingerprint(df, FORMAT, key, cells, df.columns)}"
    found = Cells(df.sparkSession, root)
    if found.version:
        return found
    try:
        return found.build(df, key, cells)
    except Taken:
        return Cells(df.sparkSession, root)
