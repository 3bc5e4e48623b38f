"""Stores outside Spark that tasks write to and read from: what they have to offer, and one that keeps files."""

from __future__ import annotations

import hashlib
import math
import uuid
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Unavailable(Exception):
    """The store cannot be reached. No item is to blame: the task fails, and Spark runs it again."""


class Store(Protocol):
    """What `operators.bulk.send` needs."""

    def upsert(self, rows: pa.Table) -> None:
        """Writes all rows, by their key, or raises; writing the same rows twice changes nothing."""

    def close(self) -> None: ...


class VectorFiles:
    """Vectors as Parquet files in a folder that all workers share; a batch with a bad row is refused as a whole.

    Each batch is a file named by its content, moved there when it is whole, so a task that is repeated writes the same
    file again. `run` numbers the writes: of rows with one key those of the greatest run count.
    """

    def __init__(self, root: str, run: int, key: str, vector: str, dimension: int):
        self.system, base = files.FileSystem.from_uri(root)
        self.folder = f"{base.rstrip('/')}/run={run}"
        self.system.create_dir(self.folder, recursive=True)
        self.key, self.vector, self.dimension = key, vector, dimension

    def _fault(self, row: dict) -> str | None:
        vector = row[self.vector]
        if row[self.key] is None:
            return "missing key"
        if vector is None:
            return "missing vector"
        if len(vector) != self.dimension:
            return f"vector has {len(vector)} dimensions, not {self.dimension}"
        return None if all(x is not None and math.isfinite(x) for x in vector) else "vector is not finite"

    def upsert(self, rows: pa.Table) -> None:
        for row in rows.select([self.key, self.vector]).to_pylist():
            if fault := self._fault(row):
                raise ValueError(fault)
        out = pa.BufferOutputStream()
        pq.write_table(rows, out, compression="zstd")
        data = out.getvalue()
        name = f"{self.folder}/{hashlib.sha256(data).hexdigest()}.parquet"
        aside = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(aside) as stream:
            stream.write(data)
        self.system.move(aside, name)

    def close(self) -> None:
        pass


def vector_files(spark: SparkSession, root: str, schema: str, key: str) -> DataFrame:
    """The rows that are in such a folder, one for each key."""
    rows = spark.read.schema(f"{schema}, run int").parquet(root)
    rest = [c for c in rows.columns if c not in (key, "run")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "run").alias("_r")).select(key, "_r.*")


def parquet_records(path: str, key: str, columns: list[str]):
    """A source for `operators.bulk.fetch`: records of a Parquet table by key; its row groups' ranges tell which to read."""

    def opened():
        system, base = files.FileSystem.from_uri(path)
        table = ds.dataset(base, filesystem=system, format="parquet")

        def get(keys: list) -> dict:
            wanted = (ds.field(key) >= min(keys)) & (ds.field(key) <= max(keys)) & ds.field(key).isin(keys)
            return {r.pop(key): r for r in table.to_table(columns=[key, *columns], filter=wanted).to_pylist()}

        return get

    return opened
