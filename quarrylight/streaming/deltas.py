"""A keyed table that is merged when it is read: base and delta files by key bucket, under numbered commits.

A batch writes one delta, its own rows, in the buckets that they touch; the table is never rewritten for it. A reader
takes the last row of each key over a bucket's base and deltas. A bucket with more than DELTAS deltas is compacted: only
its files are read and written. A commit names the files of each bucket and the last batch, so a batch that is repeated
after a failure changes nothing, and files of a batch that died before its commit are never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.commits import Commits

BUCKETS, DELTAS = 32, 8


class DeltaTable:
    """Rows of `schema`, one for each key; of several the one with the greatest `order` counts, the later batch's of equals.
    buckets and deltas are those of the first batch."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: tuple[str, ...], order: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.root, self.schema, self.keys, self.order = spark, root.rstrip("/"), schema, keys, order
        self.columns = spark.createDataFrame([], schema).columns
        self.log = Commits(spark, root)
        self.version, state = self.log.read() or (0, None)
        #: Of each touched bucket its folders in the order in which they were written, the first one a base or the first delta.
        self.state = state or {"last": -1, "count": buckets, "deltas": deltas, "buckets": {}}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.state["count"])).cast("int")

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row of each key of (columns, _n): the greatest by order, then by the number of the file."""
        rest = [c for c in self.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct(self.order, "_n")).alias("_r")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "_r.*").select(*self.columns)

    def _write(self, rows: DataFrame, name: str) -> tuple[str, list[int]]:
        """Writes rows by bucket; the folder, and the buckets that have a file there."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket()).repartition("bucket", *self.keys).sortWithinPartitions("bucket")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(path)
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        return path, [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def apply(self, batch: DataFrame, number: int, facts: dict | None = None) -> bool:
        """Adds a batch, and facts that its commit keeps; False if it, or a later one, is in the table already."""
        if number <= self.state["last"]:
            return False
        path, touched = self._write(self._last(batch.select(*self.columns).withColumn("_n", F.lit(0))), f"delta-{number}")
        buckets = {k: list(v) for k, v in self.state["buckets"].items()}
        for b in touched:
            buckets.setdefault(str(b), []).append(path)
        self._commit({**self.state, **(facts or {}), "last": number, "buckets": buckets})
        full = [b for b, paths in self.state["buckets"].items() if len(paths) > self.state["deltas"]]
        if full:
            self.compact(full)
        return True

    def _commit(self, state: dict) -> None:
        self.log.commit(self.version + 1, state)
        self.version, self.state = self.version + 1, state

    def _rows(self, buckets: dict[str, list[str]]) -> DataFrame:
        """(columns, bucket, _n) of some buckets' files; _n grows with the age of the write."""
        order = {p: i for paths in buckets.values() for i, p in enumerate(paths)}
        out = self.spark.createDataFrame([], f"{self.schema}, bucket int, _n int")
        for path in order:
            inside = [int(b) for b, paths in buckets.items() if path in paths]
            # a bucket's files are in the order of their writes, which is the order of the commits that named them first
            number = F.lit(0)
            for b in inside:
                number = F.when(F.col("bucket") == b, buckets[str(b)].index(path)).otherwise(number)
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).where(F.col("bucket").isin(inside))
            out = out.unionByName(rows.withColumn("_n", number.cast("int")))
        return out

    def read(self) -> DataFrame:
        return self._last(self._rows(self.state["buckets"]))

    def held(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in a table: only those are merged."""
        asked = keys.select(*(F.col(k).alias(f"_{k}") for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        return self._last(self._rows(self.state["buckets"]).join(asked, same, "left_semi"))

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        asked = self.spark.createDataFrame(keys, self.spark.createDataFrame([], self.schema).select(*self.keys).schema)
        which = {str(r[0]) for r in asked.select(self._bucket()).distinct().collect()}
        some = {b: paths for b, paths in self.state["buckets"].items() if b in which}
        return self._last(self._rows(some).join(F.broadcast(asked), list(self.keys), "left_semi"))  # a caller's list

    def compact(self, buckets: list[str] | None = None) -> None:
        """One file folder in place of several, for these buckets or all."""
        some = {b: p for b, p in self.state["buckets"].items() if buckets is None or b in buckets}
        path, _ = self._write(self._last(self._rows(some)), "base")
        self._commit({**self.state, "buckets": self.state["buckets"] | {b: [path] for b in some}})

    def clean(self, keep: int = 2) -> int:
        """Removes folders that none of the last `keep` commits names; readers of older ones have to be done."""
        named = {p for v in self.log.versions()[-keep:] for paths in self.log.read(v)[1]["buckets"].values() for p in paths}
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(self.root)
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        old = [n for n in names if n.startswith(("delta-", "base-")) and f"{self.root}/{n}" not in named]
        for n in old:
            self.log.delete(f"{self.root}/{n}")
        return len(old)
