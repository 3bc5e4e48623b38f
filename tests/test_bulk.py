"""Bulk writes and fetches: who is at fault, what is written, and what a repeated task does."""

import math
import sys
import uuid

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarrylight.operators import bulk
from quarrylight.sources import scratch, stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


class Picky:
    """Refuses batches with a negative number; counts requests in the message of each fault."""

    def __init__(self, log=None):
        self.requests, self.rows = 0, []

    def upsert(self, rows):
        self.requests += 1
        bad = [r for r in rows.to_pylist() if r["n"] is not None and r["n"] < 0]
        if bad:
            raise ValueError(f"negative {bad[0]['n']}")
        self.rows += rows.to_pylist()

    def close(self):
        self.closed = True


def test_halving_finds_the_rows_at_fault():
    store = Picky()
    rows = pa.table({"n": [-5 if i in (17, 90) else i for i in range(128)]})
    errors = list(bulk._errors(store, rows))
    assert [i for i, e in enumerate(errors) if e] == [17, 90] and errors[17] == "negative -5"
    assert sorted(r["n"] for r in store.rows) == [i for i in range(128) if i not in (17, 90)]
    assert store.requests < 32  # one by one would take 129


def test_an_outage_is_no_fault_of_a_row():
    class Down(Picky):
        def upsert(self, rows):
            raise stores.Unavailable("no route")

    with pytest.raises(stores.Unavailable):
        list(bulk._errors(Down(), pa.table({"n": [1, 2]})))


def test_outcomes_of_awkward_rows(spark):
    rows = [("a", 1, 1), ("b", None, -1), (None, 2, 3), ("a", 1, 1), ("", 3, None)]
    df = spark.createDataFrame(rows, "chunk_id string, sid int, n int")
    got = bulk.send(df, Picky, scratch.shared(spark, "t"), size=2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("a", 1, True, None), ("b", None, False, "negative -1"), (None, 2, True, None), ("a", 1, True, None), ("", 3, True, None)]))
    assert bulk.send(df.limit(0), Picky, scratch.shared(spark, "t")).count() == 0


def test_files_of_vectors(spark):
    root = scratch.shared(spark, "vectors")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, math.nan]), (5, [1.0, None]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").withColumn("sid", F.lit(1))

    def store(run):
        return lambda: stores.VectorFiles(root, run, "chunk_id", "embedding", 2)

    for run in (1, 1):  # a repeated task
        got = {r.id: r.error for r in bulk.send(df, store(run), scratch.shared(spark, "t")).collect()}
        assert got == {"1": None, "2": "missing vector", "3": "vector has 1 dimensions, not 2", "4": "vector is not finite", "5": "vector is not finite", None: "missing key"}
    bulk.send(spark.createDataFrame([(1, [7.0, 7.0], 1), (9, [9.0, 9.0], 1)], "chunk_id long, embedding array<double>, sid int"), store(2), scratch.shared(spark, "t"))
    there = stores.vector_files(spark, root, "chunk_id long, embedding array<double>, sid int", "chunk_id")
    assert sorted((r.chunk_id, r.embedding) for r in there.collect()) == [(1, [7.0, 7.0]), (9, [9.0, 9.0])]


def _run(spark, chunks, studies):
    stored = spark.createDataFrame([(1, "a"), (1, "old"), (2, "old2"), (3, "c")], "sid int, chunk_id string")
    chunks = spark.createDataFrame(chunks, "chunk_id string, sid int, n int")
    studies = spark.createDataFrame(studies, "sid int, n int")
    run = bulk.index_run(chunks, studies, stored, Picky, Picky, scratch.shared(spark, "t"))
    return run, sorted(r.chunk_id for r in run.kept.collect()), {r.sid: r.state for r in run.states.collect()}


def test_a_run_prunes_only_what_landed(spark):
    run, kept, states = _run(spark, [("a", 1, 1), ("b", 2, -1), ("b2", 2, 1)], [(1, 1), (2, 1)])
    assert kept == ["a", "c", "old2"] and states == {1: "indexed", 2: "failed"}
    assert {r.sid: (r.n_written, r.n_failed, r.study_written, r.errors) for r in bulk.rollup(run.outcomes).collect()} == {1: (1, 0, True, []), 2: (1, 1, True, ["negative -1"])}


def test_a_study_whose_document_failed_is_failed_but_pruned(spark):
    _, kept, states = _run(spark, [("a", 1, 1)], [(1, -1)])
    assert kept == ["a", "c", "old2"] and states == {1: "failed"}


def test_an_error_of_no_study_prunes_nothing(spark):
    _, kept, states = _run(spark, [("a", 1, 1), ("x", None, -1)], [(1, 1)])
    assert kept == ["a", "c", "old", "old2"] and states == {}


def test_fetch(spark):
    def source():
        def get(ids):
            if 5 in ids:
                raise RuntimeError("cannot build 5")
            return {i: {"title": f"t{i}"} for i in ids if i % 2}

        return get

    keys = spark.createDataFrame([(i,) for i in [1, 2, 3, 5, 5, 7, 0, -3, None]], "sid int")
    got = bulk.fetch(keys, source, scratch.shared(spark, "t"), "title string", size=3)
    assert sorted((r.sid, r.status, r.error, r.body and r.body.title) for r in got.collect()) == [(1, "found", None, "t1"), (2, "missing", None, None), (3, "found", None, "t3"), (5, "error", "cannot build 5", None), (7, "found", None, "t7")]
    assert bulk.fetch(keys.limit(0), source, scratch.shared(spark, f"t{uuid.uuid4().hex[:4]}"), "title string").count() == 0
