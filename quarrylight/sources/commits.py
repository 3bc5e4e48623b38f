"""Numbered commits of a table folder: which of its files count.

A commit is a small JSON file. It is written aside and renamed to its number, which fails if that number is taken; so of
two writers who start from one commit only one succeeds, and a reader sees a commit whole or not at all. Files that no
commit names are leftovers of stopped writers; nobody reads them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Taken(Exception):
    """Somebody else has made this commit."""


class Commits:
    """The commits under `root`/_commits, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._at = self._fs.Path(f"{self.root}/_commits")
        self._context = self._fs.FileContext.getFileContext(self._at.toUri(), spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._context.util().exists(self._at):
            return []
        names = [s.getPath().getName() for s in self._context.util().listStatus(self._at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int | None = None) -> tuple[int, dict] | None:
        """The last commit (or one given), with its number."""
        known = self.versions()
        if version is None and not known:
            return None
        version = known[-1] if version is None else version
        stream = self._context.open(self._fs.Path(self._at, f"{version:08d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, what: dict) -> None:
        """Makes `what` commit number `version`, or raises Taken."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        aside = self._fs.Path(self._at, f".{uuid.uuid4().hex}.tmp")
        fs = aside.getFileSystem(self.spark._jsc.hadoopConfiguration())
        stream = fs.create(aside, False)
        try:
            jvm.org.apache.commons.io.IOUtils.write(json.dumps(what), stream, "UTF-8")
        finally:
            stream.close()
        kinds = getattr(self._fs, "Options$Rename")
        options = gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            self._context.rename(aside, self._fs.Path(self._at, f"{version:08d}.json"), options)
        except Exception as e:
            fs.delete(aside, False)
            if "AlreadyExists" in str(e):
                raise Taken(f"{self.root}: commit {version} is taken") from e
            raise

    def delete(self, path: str) -> None:
        """Removes a folder that no commit names any more."""
        p = self._fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(df: DataFrame, *settings) -> str:
    """A name for what a table is made from: path, length and time of each of its files, and the settings."""
    import hashlib

    files = sorted(df.inputFiles())
    spark = df.sparkSession
    facts = []
    for f in files:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        facts.append((f, s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([facts, settings]).encode()).hexdigest()[:24]
