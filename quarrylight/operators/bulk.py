"""Bulk writes with an outcome for each item, and what follows from them: pruning, states, counts of a run.

Tasks send their rows to a store in batches. A batch that the store refuses is halved until the rows at fault stand
alone, so each has its own error and the rest is written in as few requests as that allows. The outcomes are a table that
is written once: nothing is sent again when it is read, and no list of errors passes the driver. A task that is lost is
run again and writes the same rows by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylight.operators import ingest, sinks
from quarrylight.sources.stores import Store, Unavailable

BATCH = 128
OUTCOME = "id string, sid long, ok boolean, error string"


def _errors(store: Store, rows: pa.Table) -> Iterator[str | None]:
    """The error of each row, in order; null if it was written."""
    try:
        store.upsert(rows)
        yield from [None] * rows.num_rows
    except Unavailable:
        raise
    except Exception as e:
        if rows.num_rows == 1:
            yield str(e) or type(e).__name__
        else:
            half = rows.num_rows // 2
            yield from _errors(store, rows.slice(0, half))
            yield from _errors(store, rows.slice(half))


def send(rows: DataFrame, open_store: Callable[[], Store], folder: str, key: str = "chunk_id", sid: str = "sid", size: int = BATCH) -> DataFrame:
    """Writes rows to the store that each task opens; (id, sid, ok, error) of each row, kept as Parquet in `folder`.

    Rows of one key are all sent, in no order: make keys unique first. A null key or sid is sent too and has a null id or
    sid in its outcome. `folder` must be new.
    """

    def run(batches):
        store = open_store()
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = pa.Table.from_batches([batch.slice(i, size)])
                    errors = pa.array(list(_errors(store, part)), pa.string())
                    ids, sids = (part.column(c).combine_chunks() for c in (key, sid))
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), sids.cast(pa.int64()), errors.is_null(), errors], names=["id", "sid", "ok", "error"])
        finally:
            store.close()

    rows.mapInArrow(run, OUTCOME).write.parquet(folder)
    return rows.sparkSession.read.schema(OUTCOME).parquet(folder)


@dataclass
class Run:
    """What a run did: the outcomes, the stored chunks that stay, and the state of each study."""

    outcomes: DataFrame
    kept: DataFrame
    states: DataFrame


def index_run(chunks: DataFrame, studies: DataFrame, stored: DataFrame, open_chunks: Callable[[], Store], open_studies: Callable[[], Store], folder: str, size: int = BATCH) -> Run:
    """Sends chunks (chunk_id, sid, ...), then the documents of their studies (sid, ...).

    outcomes: (kind, id, sid, ok, error). kept: rows of stored (sid, chunk_id) without the chunks that the studies no
    longer have; a study with a chunk that failed keeps all. An error of no study leaves open who is to blame, so then
    nothing is pruned and no study is called indexed. states: (sid, state), failed if a chunk or the document failed.
    """
    parts = [send(chunks, open_chunks, f"{folder}/chunks", size=size), send(studies.select("*", F.col("sid").alias("_key")), open_studies, f"{folder}/studies", key="_key", size=size)]
    outcomes = parts[0].withColumn("kind", F.lit("chunk")).unionByName(parts[1].withColumn("kind", F.lit("study"))).select("kind", "id", "sid", "ok", "error")
    failed = outcomes.where("NOT ok")
    unattributed = not failed.where("sid IS NULL").isEmpty()
    lost = failed.where("kind = 'chunk'").select("sid").distinct()
    kept = stored if unattributed else ingest.prune_stale(stored, chunks, lost)
    nothing = failed.select("sid").where(F.lit(False))
    states = sinks.state_report(studies, outcomes.where("ok"), failed, nothing, unattributed)
    return Run(outcomes, kept, states)


def rollup(outcomes: DataFrame) -> DataFrame:
    """(sid, n_written, n_failed, study_written, errors) of each study; written counts chunks alone, errors are distinct."""
    chunk = F.col("kind") == "chunk"
    return outcomes.groupBy("sid").agg(
        F.count_if(chunk & F.col("ok")).alias("n_written"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.max(F.when(~chunk, F.col("ok"))).alias("study_written"),
        F.array_sort(F.collect_set("error")).alias("errors"),
    )


def fetch(keys: DataFrame, open_source: Callable[[], Callable[[list], dict]], folder: str, schema: str, size: int = BATCH, key: str = "sid") -> DataFrame:
    """(key, status, error, body) of each distinct positive key: found, missing or error; kept as Parquet in `folder`.

    `open_source` gives each task a function from at most `size` keys, neighbours in their order, to {key: fields by
    `schema`}; a key that it leaves out is missing. A request that fails is halved as in `send`. `folder` must be new.
    """
    wanted = keys.select(F.col(key).cast("long").alias(key)).where(F.col(key) > 0).distinct()
    out = f"{key} long, status string, error string, body struct<{schema}>"
    kinds = list(to_arrow_schema(StructType.fromDDL(out)).types)

    def ask(get, ids: list) -> Iterator[tuple]:
        try:
            got = get(ids)
            yield from ((i, "found" if i in got else "missing", None, got.get(i)) for i in ids)
        except Unavailable:
            raise
        except Exception as e:
            if len(ids) == 1:
                yield ids[0], "error", str(e) or type(e).__name__, None
            else:
                yield from ask(get, ids[: len(ids) // 2])
                yield from ask(get, ids[len(ids) // 2 :])

    def run(batches):
        get = open_source()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), size):
                got = zip(*ask(get, ids[i : i + size]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, kinds, strict=True)], names=[key, "status", "error", "body"])

    wanted.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, out).write.parquet(folder)
    return keys.sparkSession.read.schema(out).parquet(folder)
