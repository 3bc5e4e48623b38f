"""Token-ID shards in training order.

Documents are encoded, each text followed by an end token, and follow each other by (doc_id, hash of the text) as one
stream of tokens, which is cut into sequences of LENGTH ids: the last one alone is padded, with end tokens. So the
number of a sequence depends on the documents alone, not on how the table is split. A keyed Feistel permutation with
cycle-walking sends each number to a global slot: a bijection on [0, N) that any reader can compute, so a training
order for another key needs no sort and no table. Slots are dealt by range to shards of SLOTS records and written as
fixed-stride binary files: slot s is at byte (s mod SLOTS) * 2 * LENGTH of shard s // SLOTS, as little-endian uint16.

1. `encoded` is written once. A task's documents form runs in the order of the stream. If these are few for each task and
   do not overlap, as in a table that was written in order, a document's place in the stream follows from its run; else
   the encoded documents are dealt by range and sorted first. A few rows for each task reach the driver.
2. `fragments` cuts each document where sequences end and packs, with zstd, what a task has for a shard; `shards` puts the
   fragments to their places in a shard's bytes (128 MB, what a task holds) and writes these.
3. A file gets its name, which holds its SHA-256, when it is whole. A run into the same folder takes the encoded table
   and the whole files that are there, and writes the others; the folder says of which documents (their number, bytes and
   sum of hashes), tokenizer file and settings it is, and any other run is refused.

Defined results: a null or empty text is an end token alone; a null doc_id counts as -1; rows that repeat a doc_id
follow each other in the order of their texts' hashes, equal ones are written each; an empty table has no slots and no
shards. Very long texts are encoded whole, and cut where sequences end. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import blocks
from quarrylight.llm.store import documents, folder_for

#: Ids of a sequence; sequences of a shard (128 MB).
LENGTH, SLOTS, KEY, ROUNDS = 1024, 65_536, 0x5DEECE66D, 6
#: Bytes of ids that a task packs at a time on their way to the shards.
PACK = 32 << 20
END = 50_256
#: A run of documents ends where the next doc_id is further off than so many usual steps.
_FAR = 64
#: Runs for each task up to which they come to the driver.
RUNS_A_TASK = 4


def _rank_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str = "byte_bpe_50k.tiktoken", path: str | None = None):
    """Byte-level BPE from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or _rank_file(name)) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("shards", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_loaded: dict[tuple, object] = {}


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed bijection of [0, n): balanced Feistel rounds on the next even number of bits, walked until within n."""
    x = np.array(x, np.uint64)
    if n <= 1:
        return x
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.frombuffer(hashlib.sha256(str(key).encode()).digest() * ((rounds + 3) // 4), "<u8")[:rounds]
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            v = out[todo]
            left, right = v >> half, v & mask
            for i, k in enumerate(keys):
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                left, right = right, left ^ (f & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= n]
    return out


def unfeistel(y: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The number that has a slot: the inverse of feistel."""
    y = np.array(y, np.uint64)
    if n <= 1:
        return y
    half = np.uint64(((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.frombuffer(hashlib.sha256(str(key).encode()).digest() * ((rounds + 3) // 4), "<u8")[:rounds]
    out, todo = y.copy(), np.arange(len(y))
    with np.errstate(over="ignore"):
        while len(todo):
            v = out[todo]
            left, right = v >> half, v & mask
            for i in range(rounds - 1, -1, -1):
                f = (left ^ keys[i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                left, right = right ^ (f & mask), left
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= n]
    return out


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """(part, run, at, doc_id, tag, n, ids): documents, their run within the task, and the tokens before them in it. ids: little-endian uint16."""

    def run(batches):
        from pyspark import TaskContext

        part, number, at, last = TaskContext.get().partitionId(), 0, 0, None
        if (name, path) not in _loaded:
            _loaded[name, path] = load(name, path)
        encoding = _loaded[name, path]
        for batch in batches:
            ids_ = np.asarray(batch.column("doc_id").cast(pa.int64()).fill_null(-1))
            far = _FAR * max(1, int(np.median(np.abs(np.diff(ids_))))) if len(ids_) > 1 else _FAR
            for i, _, flat, ends in blocks(batch.column("text")):
                data = flat.tobytes()
                out: list[tuple] = []
                for r, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), i):
                    text = data[a:b]
                    key = int(ids_[r]), xxhash.xxh3_64_intdigest(text) - (1 << 63)
                    ids = np.array([*encoding.encode_ordinary(text.decode()), END], "<u2")
                    if last is not None and (key < last or key[0] - last[0] > far):
                        number, at = number + 1, 0
                    out.append((part, number, at, *key, len(ids), ids.tobytes()))
                    at, last = at + len(ids), key
                types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=_ENCODED)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


_ENCODED = ["part", "run", "at", "doc_id", "tag", "n", "ids"]
_SCHEMA = "part int, run int, at long, doc_id long, tag long, n long, ids binary"


def offsets(table: DataFrame) -> tuple[dict[tuple[int, int], int] | None, int]:
    """Tokens before each run (part, run) of an encoded table, or None if runs overlap or are many; and the number of tokens.

    To the driver come a row for each task, and its runs only if there are at most RUNS_A_TASK of them for each task on
    average: a table that is in order but for where files meet. Any other is sorted, and then each task has one run.
    """
    parts = table.groupBy("part").agg((F.max("run") + 1).alias("runs"), F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in parts)
    if sum(r["runs"] for r in parts) > RUNS_A_TASK * len(parts):
        return None, total
    key = F.struct("doc_id", "tag")
    runs = table.groupBy("part", "run").agg(F.sum("n").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
    runs = sorted(runs, key=lambda r: (tuple(r["low"]), tuple(r["high"])))
    if any(tuple(a["high"]) > tuple(b["low"]) for a, b in zip(runs, runs[1:])):
        return None, total
    out, at = {}, 0
    for r in runs:
        out[r["part"], r["run"]] = at
        at += r["n"]
    return out, total


def in_order(table: DataFrame) -> DataFrame:
    """The encoded table dealt by range and sorted, so that each task has one run."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch.column("n"))
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            zero = np.zeros(len(n), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(zero + part), pa.array(zero), pa.array(before), *(batch.column(c) for c in _ENCODED[3:])], names=_ENCODED)

    return table.repartitionByRange("doc_id", "tag").sortWithinPartitions("doc_id", "tag").mapInArrow(run, _SCHEMA)


def fragments(table: DataFrame, before: dict[tuple[int, int], int], total: int, done: set[int], length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """(shard, at, n, ids): documents cut where sequences of the stream end. A row holds what up to PACK bytes of a task's
    ids have for a shard that is not done: the cuts' places in its file and their bytes, and the ids, packed with zstd."""
    count, stride = -(-total // length), 2 * length

    def run(batches):
        pack = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            at = np.array([before[k] for k in zip(batch.column("part").to_pylist(), batch.column("run").to_pylist(), strict=True)], np.int64) + np.asarray(batch.column("at"))
            n = np.asarray(batch.column("n"))
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            number = at[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(number * length, at[row])
            size = 2 * (np.minimum((number + 1) * length, at[row] + n[row]) - start)
            slot = feistel(number, count, key).astype(np.int64)
            shard, place = slot // slots, slot % slots * stride + 2 * (start - number * length)
            ids = batch.column("ids")
            first = 2 * (start - at[row])
            of = np.append(0, np.cumsum(2 * n))[row] + first
            # in the order of (range of PACK bytes, shard): each run of these is a row
            part = of // PACK
            order = np.lexsort((shard, part))
            order = order[~np.isin(shard[order], list(done))]
            new = np.flatnonzero((np.diff(part[order], prepend=-1) != 0) | (np.diff(shard[order], prepend=-1) != 0))
            for i, j in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=False):  # a batch may have nothing to write
                x = order[i:j]
                cut = [memoryview(ids[r].as_buffer())[a : a + m] for r, a, m in zip(row[x].tolist(), first[x].tolist(), size[x].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[x[:1]], pa.int64()), pa.array([place[x]], pa.list_(pa.int64())), pa.array([size[x]], pa.list_(pa.int64())),
                        pa.array([pack.compress(b"".join(cut), asbytes=True)], pa.binary()),
                    ],
                    names=["shard", "at", "n", "ids"],
                )

    return table.mapInArrow(run, "shard long, at array<long>, n array<long>, ids binary")


MANIFEST = "shard long, first_slot long, n_slots long, n_bytes long, sha256 string"


def shards(rows: DataFrame, total: int, folder: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """Writes the shards that have rows, each by one task, which holds one shard's bytes; returns their manifest rows.

    Slots are ranges by construction: shard s has [s * slots, (s + 1) * slots), so rows go straight to their shard.
    """
    count, stride = -(-total // length), 2 * length
    dealt = rows.repartitionById(max(1, -(-count // slots)), F.col("shard").cast("int"))

    def run(batches):
        system, base = files.FileSystem.from_uri(folder)
        pack = pa.Codec("zstd")
        shard, places, sizes, data = None, [], [], None
        for batch in batches:
            for r in range(batch.num_rows):
                s, at, n = batch.column("shard")[r].as_py(), *(np.asarray(batch.column(c)[r].values) for c in ("at", "n"))
                if shard is None:
                    shard, first, held = s, s * slots, min(slots, count - s * slots)
                    data = np.full(held * length, END, "<u2")
                    view = memoryview(data).cast("B")
                if s != shard:
                    raise ValueError(f"shards {shard} and {s} came to one task")
                ids, a = memoryview(pack.decompress(batch.column("ids")[r].as_buffer(), decompressed_size=int(n.sum()), asbytes=True)), 0
                for to, m in zip(at.tolist(), n.tolist(), strict=True):
                    view[to : to + m] = ids[a : a + m]
                    a += m
                places.append(at)
                sizes.append(n)
        if shard is None:
            return
        # only the last sequence of the stream is not full
        gap = 2 * (count * length - total) if first <= int(feistel(np.array([count - 1]), count, key)[0]) < first + held else 0
        at, n = np.concatenate(places), np.concatenate(sizes)
        order = np.argsort(at)
        if int(n.sum()) != held * stride - gap or (at[order][1:] < (at + n)[order][:-1]).any():
            raise ValueError(f"shard {shard} misses tokens, or has some twice")
        system.create_dir(base, recursive=True)
        name, sha = f"{base}/.{uuid.uuid4().hex}.part", hashlib.sha256(data).hexdigest()
        with system.open_output_stream(name) as out:
            out.write(data)
        system.move(name, f"{base}/shard-{shard:08d}.{sha}.bin")
        row = shard, first, held, held * stride, sha
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (*(pa.int64(),) * 4, pa.string()), strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return dealt.mapInArrow(run, MANIFEST)


def read_slots(folder: str, first: int, n: int = 1, length: int = LENGTH, slots: int = SLOTS) -> np.ndarray:
    """Ids of n slots of one shard from slot `first` on, by one seek into its file; an array of n rows."""
    system, base = files.FileSystem.from_uri(f"{folder.rstrip('/')}/shards")
    found = [i.path for i in system.get_file_info(files.FileSelector(base)) if f"/shard-{first // slots:08d}." in i.path]
    with system.open_input_file(found[0]) as f:
        f.seek((first % slots) * 2 * length)
        return np.frombuffer(f.read(2 * length * n), "<u2").reshape(-1, length)


def _there(folder: str) -> bool:
    """Whether Spark has finished writing a folder."""
    system, base = files.FileSystem.from_uri(folder)
    return system.get_file_info(f"{base}/_SUCCESS").type == files.FileType.File


def _table(df: DataFrame, folder: str) -> DataFrame:
    """df as it is written in the folder, by this run or an earlier one."""
    if not _there(folder):
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _claim(folder: str, run: dict) -> None:
    """Writes the description of the run, or compares it with the one that the folder has."""
    system, base = files.FileSystem.from_uri(folder)
    system.create_dir(f"{base}/shards", recursive=True)
    path = f"{base}/run.json"
    if system.get_file_info(path).type == files.FileType.File:
        with system.open_input_stream(path) as f:
            if json.loads(f.read()) != run:
                raise ValueError(f"{folder} holds another run")
        return
    aside = f"{base}/.{uuid.uuid4().hex}.json"
    with system.open_output_stream(aside) as f:
        f.write(json.dumps(run).encode())
    system.move(aside, path)


def _whole_files(folder: str) -> dict[int, tuple[int, str]]:
    """Files (bytes, SHA-256) by shard: they get their name when they are whole."""
    system, base = files.FileSystem.from_uri(folder)
    out = {}
    for info in system.get_file_info(files.FileSelector(f"{base}/shards")):
        if m := re.fullmatch(r"shard-(\d+)\.([0-9a-f]{64})\.bin", info.base_name):
            out[int(m[1])] = info.size, m[2]
    return out


def fingerprint(docs: DataFrame) -> list:
    """What tells one table of documents from another: its rows, and the sum of their hashes."""
    hashes = F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))
    return [str(x) for x in docs.agg(F.count("*"), hashes, F.sum(F.octet_length("text"))).first()]


def write(docs: DataFrame, folder: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> DataFrame:
    """Writes folder/encoded, folder/shards/*.bin and folder/manifest, or what is missing of them; returns the manifest.
    A folder that was begun with other documents, another tokenizer file or other settings is an error.

    folder: a path or URI of a file system that pyarrow can open (file, hdfs, s3, gs).
    """
    spark, folder = docs.sparkSession, folder.rstrip("/")
    with open(path or _rank_file(name), "rb") as f:
        tokenizer = hashlib.sha256(f.read()).hexdigest()
    _claim(folder, {"length": length, "slots": slots, "key": key, "tokenizer": tokenizer, "documents": fingerprint(docs)})
    table = _table(encoded(docs, name, path), f"{folder}/encoded")
    before, total = offsets(table)
    if before is None:
        table = _table(in_order(table), f"{folder}/in_order")
        before, total = offsets(table)
    stride, count = 2 * length, -(-total // length)
    there = _whole_files(folder)
    size = {s: min(slots, count - s * slots) for s in range(-(-count // slots))}
    whole = {s: sha for s, (n, sha) in there.items() if s in size and n == size[s] * stride}
    new = shards(fragments(table, before, total, set(whole), length, slots, key), total, f"{folder}/shards", length, slots, key)
    old = spark.createDataFrame([(s, s * slots, size[s], size[s] * stride, sha) for s, sha in whole.items()], MANIFEST)
    new.unionByName(old).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def op9_token_shards(spark, sf_dir: str) -> DataFrame:
    return write(documents(spark, sf_dir), folder_for(spark, "token-shards"))


QUERIES = {"op9_token_shards": op9_token_shards}
ORACLES: dict = {}
