"""A stored inverted index: postings in blocks, positions, a dictionary, segments and commits.

Layout of a folder: segments, each of which is never changed, and commits that name the segments that count.

* `postings`: a row for each block of up to BLOCK documents of a (field, term), in the order of their keys: keys, term
  frequencies, lengths of the field, positions, each as the bytes of its numbers, which a search opens in Arrow; the first
  and last key, and the highest frequency and the shortest length in the block, which bound its scores. Rows are dealt by ranges of (term, key), so a word of every document is spread
  over many files, and `files` holds the first and last term of each. The ranges of keys of a word's blocks overlap if the
  table is not in the order of its keys. A task that splits texts makes such blocks of a slice of them, in the order of
  their terms, and deals them out in packs: a row is PACK bytes of neighbouring terms, so that what is dealt and sorted is
  neither words nor documents. The task of a range of terms merges its packs.
* `docs`: length of each field of each document. `terms`: the dictionary, in the order of its terms. A misspelt word's forms
  begin with its first two letters, so it reads that range and checks it by edit distance.

A search opens the files whose range of terms holds one of its words, and of them what Parquet's statistics leave. It
never reads a text. `add` writes a segment for new or changed documents and names in its commit the keys that it replaces
(or deletes) in older ones; `merge` writes all segments as one. Statistics are of live documents.
"""

from __future__ import annotations

import re
import uuid
from functools import cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.scalar import fold
from quarrylight.operators import text as T
from quarrylight.sources.commits import Commits, Taken, fingerprint

BLOCK = 128
#: Number of this layout.
FORMAT = 3
#: Positions between two entries of a field with several, so that no phrase spans two.
GAP = 100
#: Terms that a scan is filtered by; more of them are joined.
LISTED = 1000
#: Bytes of text that a task makes postings of at a time.
SLICE = 16 << 20
#: Bytes of postings in a row while they are dealt, and of those that a task merges at a time.
PACK, MERGED = 256 << 10, 32 << 20
_POSTING = "term string, field string, key long, dl int, tf int, positions array<int>"
_PART = "term string, field string, lo long, keys array<long>, dls array<int>, tfs array<int>, positions array<int>"
_PACK = "term string, lo long, body binary"
_BLOCK = "term string, field string, lo long, hi long, n int, max_tf int, min_dl int, keys array<long>, dls array<int>, tfs array<int>, starts array<int>, positions array<int>"
_STORED = "term string, field string, lo long, hi long, n int, max_tf int, min_dl int, keys binary, dls binary, tfs binary, positions binary"


#: Of each byte of a text, what it is in a token: ASCII letters in lower case, digits and all that is not ASCII; else 0.
_LOW = np.array([ord(chr(b).lower()) if chr(b).isalnum() else 0 for b in range(128)] + [*range(128, 256)], np.uint8)


class Letters(dict):
    """What each code point becomes in tokens; those that are not there part them."""

    def __missing__(self, c: int) -> str:
        return " "


def _spaced(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " ")


@cache
def letters(spark: SparkSession) -> Letters:
    """Spark's own folding and splitting, of every code point by itself.

    Lower case of a sigma depends on its neighbours; nothing else in folding and splitting does.
    """
    one = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = spark.range(128, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.col("id").cast("int"), _spaced(one).alias("to")).where("to <> ' '").toArrow()
    return Letters([*((c, c) for c in range(128)), *zip(known["id"].to_pylist(), known["to"].to_pylist(), strict=True)])


def _tokens(texts, known: Letters) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts in their order, and of each token its number there and that of its text.

    Texts are split where ASCII splits them, and what is not ASCII is folded and split further in distinct pieces only.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = _LOW[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds.astype(np.int64) - bounds[0]
    inside = data != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    begin = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - begin
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, bounds)))
    pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data[inside]))
    coded = pieces.dictionary_encode()
    piece, code = coded.dictionary, coded.indices.to_numpy()
    plain = pc.string_is_ascii(piece)
    held, many = np.arange(len(piece)), np.ones(len(piece), np.int64)
    if not pc.all(plain).as_py():
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        lines = b"\n".join(piece.take(pa.array(other)).cast(pa.binary()).to_pylist()).decode("utf-8", "replace")
        split = [x.split() for x in lines.translate(known).split("\n")]
        many[other] = [len(x) for x in split]
        start = np.cumsum(many) - many
        # the tokens of each piece in turn: its own number, or those of the pieces that it falls into
        held = np.repeat(np.arange(len(piece)), many)
        changed = np.isin(held, other)
        held[changed] = len(piece) + np.arange(changed.sum())
        piece = pa.concat_arrays([piece, pa.array([w for x in split for w in x], pa.string())])
        n = many[code]
        code, text = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(text, n)
    # equal tokens of different pieces are one; terms are numbered in their order
    used = piece.take(pa.array(held)).dictionary_encode()
    order = pc.sort_indices(used.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return used.dictionary.take(order), rank[used.indices.to_numpy()][code], text


def _ends(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of a column of sorted group numbers begin, and these with its length: at a new group, and after BLOCK rows."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    within = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    first = np.flatnonzero(within % BLOCK == 0)
    return first, np.append(first, len(group))


def _lists(bounds: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _bytes(column) -> np.ndarray:
    """Bytes of each row of texts, or of lists of texts."""
    if not pa.types.is_list(column.type):
        return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.append(0, np.cumsum(pc.binary_length(column.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)))
    bounds = np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))
    return np.diff(before[bounds])


def _parts(fields: list[str], known: Letters = Letters()):  # noqa: B008
    """Rows of (key, a column of texts, or of lists of them, for each field) to rows of _PART: up to BLOCK postings of a
    (term, field) from one slice of the texts, in the order of terms and keys. Rows without a term hold the keys and lengths
    of each field's documents, and those without a field too the keys of documents without a token."""

    def row(term, field, keys, dls):
        lists = (pa.array([x], pa.list_(t)) for x, t in ((keys, pa.int64()), (dls, pa.int32()), ([], pa.int32()), ([], pa.int32())))
        return pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array([field], pa.string()), pa.array(keys[:1], pa.int64()), *lists], names=[c.split()[0] for c in _PART.split(", ")])

    def postings(field, column, key):
        several = pa.types.is_list(column.type)
        entries = column.flatten() if several else column
        row_of_entry = np.repeat(np.arange(len(key)), pc.list_value_length(column).to_numpy(zero_copy_only=False)) if several else np.arange(len(key))
        terms, code, entry = _tokens(entries.cast(pa.string()), known)
        row_ = row_of_entry[entry]
        n, dl = len(code), np.bincount(row_, minlength=len(key)).astype(np.int32)
        if not n:
            return dl, None
        # a token's place in its field: tokens before it, and a gap for each entry before it
        place = np.arange(n) - (np.cumsum(dl) - dl)[row_]
        if several:
            place += GAP * (entry - np.searchsorted(row_of_entry, np.arange(len(key)))[row_])
        order = np.sort(code << 32 | np.arange(n))
        code, order = order >> 32, order & 0xFFFFFFFF
        held = row_[order]
        new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(held, prepend=-1) != 0))
        code, held = code[new], held[new]
        tf = np.diff(np.append(new, n)).astype(np.int32)
        first, bounds = _ends(code)
        lists = (_lists(bounds, pa.array(x)) for x in (key[held], dl[held], tf))
        positions = _lists(np.append(new, n)[bounds], pa.array(place[order].astype(np.int32)))
        return dl, pa.RecordBatch.from_arrays([terms.take(pa.array(code[first])), pa.repeat(field, len(first)), pa.array(key[held[first]]), *lists, positions], names=[c.split()[0] for c in _PART.split(", ")])

    def run(batches):
        for batch in batches:
            columns = [batch.column(i + 1) for i in range(len(fields))]
            size = sum((_bytes(c) for c in columns), np.zeros(batch.num_rows, np.int64))
            starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // SLICE, prepend=-1)).tolist()
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=False):  # an empty batch has no slice
                part = batch.slice(at, end - at)
                key = part.column(0).to_numpy()
                if (np.diff(key) < 0).any():
                    part = part.take(pa.array(np.argsort(key, kind="stable")))
                    key = part.column(0).to_numpy()
                empty = np.ones(len(key), bool)
                for i, field in enumerate(fields):
                    dl, rows = postings(field, part.column(i + 1), key)
                    if rows is not None:
                        yield rows
                        yield row(None, field, key[dl > 0], dl[dl > 0])
                        empty &= dl == 0
                if empty.any():
                    yield row(None, None, key[empty], [])

    return run


def _packed(batches):
    """Rows of _PART, in their order, to rows of _PACK: neighbours as one Arrow batch, under its first term and key."""
    for batch in batches:
        size = 48 + 16 * pc.list_value_length(batch.column("keys")).to_numpy() + 4 * pc.list_value_length(batch.column("positions")).to_numpy()
        starts = np.flatnonzero(np.diff((np.cumsum(size) - size) // PACK, prepend=-1))
        bodies = []
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=False):  # an empty batch has no pack
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.slice(at, end - at))
            bodies.append(sink.getvalue().to_pybytes())
        which = pa.array(starts)
        yield pa.RecordBatch.from_arrays([batch.column("term").take(which), batch.column("lo").take(which), pa.array(bodies, pa.binary())], names=["term", "lo", "body"])


def _opened(body) -> pa.Table:
    return pa.ipc.open_stream(body.as_buffer()).read_all()


def _sorted(table: pa.Table) -> pa.RecordBatch:
    """Rows of _PART in the order of their terms, fields and keys."""
    batch = table.combine_chunks().to_batches()[0]
    rank = []
    for c in ("field", "term"):
        coded = batch.column(c).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        rank.append(at[coded.indices.to_numpy()])
    return batch.take(pa.array(np.lexsort((batch.column("lo").to_numpy(), *rank))))


def _merged(batches):
    """Sorted rows of _PACK to rows of _STORED. Packs overlap: what is held waits until packs begin beyond it, but if most
    of it had to wait (a word with more than MERGED bytes of postings) it is let go."""
    held, size = [], 0
    for batch in batches:
        for term, body in zip(batch.column("term").to_pylist(), batch.column("body"), strict=True):
            part = _opened(body)
            if held and size + part.nbytes > MERGED:
                rows = _sorted(pa.concat_tables(held))
                ready = pc.sum(pc.less(rows.column("term"), term)).as_py()
                if 2 * ready < rows.num_rows:
                    ready = rows.num_rows
                yield from map(_flat, _blocks([rows.slice(0, ready)]))
                held = [pa.Table.from_batches([rows.slice(ready)])] if ready < rows.num_rows else []
                size = sum(t.nbytes for t in held)
            held.append(part)
            size += part.nbytes
    if held:
        yield from map(_flat, _blocks([_sorted(pa.concat_tables(held))]))


def _lengths(batches):
    """Rows of _PACK without a term to rows of (key, field, dl)."""
    for batch in batches:
        for body in batch.column("body"):
            part = _opened(body)
            field = part["field"].combine_chunks().take(pc.list_parent_indices(part["keys"].combine_chunks()))
            key, dl = (part[c].combine_chunks().flatten() for c in ("keys", "dls"))
            yield pa.RecordBatch.from_arrays([key, field, dl if len(dl) == len(key) else pa.nulls(len(key), pa.int32())], names=["key", "field", "dl"])


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of _BLOCK as those of _STORED: lists of numbers as their bytes, which Spark carries as they are."""
    columns = []
    for name in (c.split()[0] for c in _STORED.split(", ")):
        column = batch.column(name)
        if pa.types.is_list(column.type):
            values = column.flatten().to_numpy()
            ends = (column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()) * values.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STORED.split(", ")])


def _numbers(column, kind) -> np.ndarray:
    """The numbers of all rows of bytes."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def _postings_of(positions: bool):
    """Rows of (term, field, n, keys, dls, tfs and, if asked for, positions) of _STORED to rows of _POSTING."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row = pa.array(np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy()))
            key, dl, tf = (_numbers(batch.column(c), kind) for c, kind in (("keys", np.int64), ("dls", np.int32), ("tfs", np.int32)))
            at = [_lists(np.append(0, np.cumsum(tf)), pa.array(_numbers(batch.column("positions"), np.int32)))] if positions else []
            names = ["term", "field", "key", "dl", "tf", *(["positions"] if positions else [])]
            yield pa.RecordBatch.from_arrays([batch.column("term").take(row), batch.column("field").take(row), pa.array(key), pa.array(dl), pa.array(tf), *at], names=names)

    return run


def _exploded(rows: DataFrame, positions: bool = False) -> DataFrame:
    columns = ["term", "field", "n", "keys", "dls", "tfs", *(["positions"] if positions else [])]
    return rows.select(*columns).mapInArrow(_postings_of(positions), _POSTING if positions else _POSTING.removesuffix(", positions array<int>"))


def _blocks(batches):
    """Sorted rows of _PART to rows of _BLOCK; a block ends with its (term, field), with BLOCK postings, or with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 13):
            part = batch.slice(at, 1 << 13)
            term, field = part.column("term"), part.column("field")
            coded = [c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (term, field)]
            group = np.cumsum(np.diff(coded[0] * (part.num_rows + 1) + coded[1], prepend=-1) != 0)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("keys")).to_numpy())
            group = group[row]
            key, dl, tf = (part.column(c).flatten().to_numpy() for c in ("keys", "dls", "tfs"))
            flat = part.column("positions").flatten()
            if ((np.diff(key) < 0) & (np.diff(group) == 0)).any():  # slices whose keys are mixed
                order = np.lexsort((key, group))
                start = (np.cumsum(tf) - tf)[order]
                row, key, dl, tf = row[order], key[order], dl[order], tf[order]
                flat = flat.take(pa.array(np.repeat(start - (np.cumsum(tf) - tf), tf) + np.arange(len(flat))))
            first, bounds = _ends(group)
            before = np.append(0, np.cumsum(tf))
            starts = (before[:-1] - np.repeat(before[first], np.diff(bounds))).astype(np.int32)
            which = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [
                    term.take(which), field.take(which), pa.array(key[first]), pa.array(key[bounds[1:] - 1]), pa.array(np.diff(bounds), pa.int32()),
                    pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl, first)),
                    *(_lists(bounds, pa.array(x)) for x in (key, dl, tf, starts)), _lists(before[bounds], flat),
                ],
                names=[c.split()[0] for c in _BLOCK.split(", ")],
            )


class Index:
    """A stored index in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Commits(spark, root)
        at = self.log.read()
        self.version, self.state = at if at else (0, {"segments": [], "fields": {}})

    # writing

    def _segment(self, df: DataFrame, key: str, fields: dict[str, Column]) -> dict:
        """Writes a segment and says what a commit has to know of it."""
        path = f"{self.root}/segment-{uuid.uuid4().hex}"

        def text(c: Column) -> Column:
            c = F.coalesce(c, F.lit(""))
            return F.when(F.contains(c, F.lit("Σ")), F.lower(c)).otherwise(c)  # the only letter whose lower case depends on others

        def entries(f: str, c: Column) -> Column:
            return F.transform(F.coalesce(c, F.array().cast("array<string>")), text) if f.startswith("*") else text(c)

        kept = df.select(F.col(key).cast("long").alias("key"), *(c.alias(f"_f{i}") for i, c in enumerate(fields.values()))).where("key IS NOT NULL")
        texts = kept.select("key", *(entries(f, F.col(f"_f{i}")).alias(f"_f{i}") for i, f in enumerate(fields)))
        parts = _parts([f.removeprefix("*") for f in fields], letters(self.spark))
        # dealing by range looks at its input twice: write it first, so that texts are split once
        texts.mapInArrow(lambda batches: _packed(parts(batches)), _PACK).write.option("compression", "none").parquet(f"{path}/single")
        single = self.spark.read.schema(_PACK).parquet(f"{path}/single")
        docs = single.where("term IS NULL").mapInArrow(_lengths, "key long, field string, dl int")
        out = self._written(single.where("term IS NOT NULL"), docs, path)
        self.log.delete(f"{path}/single")
        return out

    def _written(self, packs: DataFrame, docs: DataFrame, path: str) -> dict:
        """Writes a segment of rows of _PACK and of (key, field, dl)."""
        dealt = packs.repartitionByRange("term", "lo").sortWithinPartitions("term", "lo")
        dealt.mapInArrow(_merged, _STORED).write.option("compression", "zstd").parquet(f"{path}/postings")
        read = self.spark.read.schema(_STORED).parquet(f"{path}/postings")
        ranges = read.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
        ranges.coalesce(1).write.parquet(f"{path}/files")  # a row for each file
        docs.write.parquet(f"{path}/docs")
        terms = read.groupBy("term").agg(F.sum("n").alias("n"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return {"path": path, "replaced": []}

    def _commit(self, segments: list[dict]) -> Index:
        state = {"segments": segments}
        docs = self._docs(segments)
        rows = docs.where(F.col("dl") > 0).groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()
        state["fields"] = {r.field: [r.n, r.total] for r in rows}
        self.log.commit(self.version + 1, state)
        return Index(self.spark, self.root)

    def _docs(self, segments: list[dict]) -> DataFrame:
        """(key, field, dl) of live documents; a document without a token has one row without a field."""
        parts = [self._live(self.spark.read.parquet(f"{s['path']}/docs"), s) for s in segments]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame, segment: dict) -> DataFrame:
        """Rows of a segment without those of keys that later ones replace."""
        for path in segment["replaced"]:
            rows = rows.join(self.spark.read.parquet(path), "key", "left_anti")
        return rows

    def add(self, df: DataFrame, key: str, fields: dict[str, Column], deleted: DataFrame | None = None) -> Index:
        """Adds documents, in place of those with the same keys, and drops those of `deleted` (a column `key`). A field
        whose name begins with * is an array, each entry of which stands by itself. Keys have to be distinct."""
        new = self._segment(df, key, fields)
        segments = [dict(s) for s in self.state["segments"]]
        if segments:
            gone = self.spark.read.parquet(f"{new['path']}/docs").select("key")
            gone = (gone.unionByName(deleted.select(F.col("key").cast("long"))) if deleted is not None else gone).distinct()
            held = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{s['path']}/docs").select("key") for s in segments])
            path = f"{new['path']}/replaced"
            gone.join(held, "key", "left_semi").write.parquet(path)
            if not self.spark.read.parquet(path).isEmpty():
                segments = [s | {"replaced": [*s["replaced"], path]} for s in segments]
        return self._commit([*segments, new])

    def merge(self) -> Index:
        """One segment in place of all, without what was replaced."""
        path = f"{self.root}/segment-{uuid.uuid4().hex}"
        rows = self._postings(None, positions=True).select("term", "field", F.col("key").alias("lo"), *(F.array(c).alias(f"{c}s") for c in ("key", "dl", "tf")), "positions")
        # dealing by range looks at its input twice: write it first
        rows.mapInArrow(lambda batches: _packed(_sorted(pa.Table.from_batches([b])) for b in batches if b.num_rows), _PACK).write.option("compression", "none").parquet(f"{path}/single")
        out = self._written(self.spark.read.schema(_PACK).parquet(f"{path}/single"), self._docs(self.state["segments"]), path)
        self.log.delete(f"{path}/single")
        return self._commit([out])

    # reading

    def _files(self, segment: dict, terms: list[str]) -> list[str]:
        """Files of a segment whose range of terms holds one of them."""
        asked = F.exists(F.array(*map(F.lit, terms)), lambda t: (F.col("lo") <= t) & (F.col("hi") >= t))
        return [r.file for r in self.spark.read.parquet(f"{segment['path']}/files").where(asked).select("file").collect()]

    def _rows(self, segment: dict, terms: list[str] | None, fields: list[str] | None) -> DataFrame | None:
        """Block rows of a segment."""
        if terms is None:
            return self.spark.read.schema(_STORED).parquet(f"{segment['path']}/postings")
        files = self._files(segment, terms) if terms else []
        if not files:
            return None
        rows = self.spark.read.schema(_STORED).parquet(*files)
        if len(terms) <= LISTED:
            rows = rows.where(F.col("term").isin(terms))
        else:
            rows = rows.join(F.broadcast(self.spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        return rows.where(F.col("field").isin(fields)) if fields else rows

    def _postings(self, terms: list[str] | None, fields: list[str] | None = None, positions: bool = False, where: Column | None = None) -> DataFrame:
        """(term, field, key, dl, tf and, if asked for, positions) of live documents."""
        out = None
        for s in self.state["segments"]:
            rows = self._rows(s, terms, fields)
            if rows is None:
                continue
            if where is not None:
                rows = rows.where(where)
            rows = self._live(_exploded(rows, positions), s)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], _POSTING if positions else _POSTING.removesuffix(", positions array<int>"))
        return out

    def forms(self, words: list[str]) -> DataFrame:
        """(query_term, term): the dictionary's forms of each word within its edits, the first two letters alike."""
        exact = [w for w in words if not T.edits(w)]
        near = [w for w in words if T.edits(w)]
        out = self.spark.createDataFrame([], "query_term string, term string")
        for s in self.state["segments"]:
            terms = self.spark.read.parquet(f"{s['path']}/terms")
            if exact:
                out = out.unionByName(terms.where(F.col("term").isin(exact)).select(F.col("term").alias("query_term"), "term"))
            if near:
                found = terms.where(reduce(lambda a, b: a | b, [F.col("term").startswith(p) for p in sorted({w[:2] for w in near})]))
                checks = F.array_compact(F.array(*(F.when((F.substring("term", 1, 2) == w[:2]) & (F.levenshtein("term", F.lit(w), T.edits(w)) >= 0), F.lit(w)) for w in near)))
                out = out.unionByName(found.select(F.explode(checks).alias("query_term"), "term"))
        return out.distinct()

    def expand(self, words: list[str]) -> dict[str, list[str]]:
        """Each word and its forms."""
        out = {w: [w] for w in words}
        if any(map(T.edits, words)):
            for r in self.forms([w for w in words if T.edits(w)]).collect():  # forms of a query's words
                if r.term != r.query_term:
                    out[r.query_term].append(r.term)
        return out

    def stats(self, fields: list[str]) -> DataFrame:
        """(field, _n, _avg): a row for each field."""
        rows = [(f, *self.state["fields"][f]) for f in fields if f in self.state["fields"]]
        return self.spark.createDataFrame([(f, n, total / n) for f, n, total in rows], "field string, _n long, _avg double")

    def counts(self, words: list[str], forms: dict[str, list[str]], fields: list[str], where: Column | None = None) -> DataFrame:
        """(key, field, dl, tf): how often each word, in any of its forms, is in a field; only where one is."""
        pairs = [(t, i) for i, w in enumerate(words) for t in forms[w]]
        named = self.spark.createDataFrame(pairs, "term string, word int")
        rows = self._postings(sorted({t for t, _ in pairs}), fields, where=where).join(F.broadcast(named), "term")  # forms of a query's words
        tf = F.array(*(F.sum(F.when(F.col("word") == i, F.col("tf")).otherwise(0)).cast("int") for i in range(len(words))))
        return rows.groupBy("key", "field").agg(F.first("dl").alias("dl"), tf.alias("tf"))

    def scores(self, words: list[str], fields: list[str], typos: bool = False) -> DataFrame:
        """(key, field, score, matched, tf): BM25 of each field over the words."""
        forms = self.expand(words) if typos else {w: [w] for w in words}
        return T.field_scores(self.counts(words, forms, fields), "key", len(words), self.stats(fields))

    def phrase(self, words: list[str], fields: list[str], slop: int = 0) -> DataFrame:
        """(key, field, score): BM25 of a phrase by its frequency; the words' idf are added up.

        An occurrence of the first word counts 1 / (1 + moves) if the others are near: moves is the smallest spread of
        the words' places, each less the word's number in the phrase, over all choices of one token for each word; more
        than `slop` count nothing. So neighbours that changed places have two moves. No token serves two words.
        """
        terms = list(dict.fromkeys(words))
        rows = self._postings(terms, fields, positions=True)
        held = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)]
        rows = rows.groupBy("key", "field").agg(F.first("dl").alias("dl"), *held)
        have = [F.col(f"p{i}").isNotNull() for i in range(len(terms))]
        df = rows.groupBy("field").agg(*(F.count_if(h).alias(f"d{i}") for i, h in enumerate(have)))
        stats = df.join(F.broadcast(self.stats(fields)), "field")  # a row for each field
        both = rows.where(reduce(lambda a, b: a & b, have))
        at = [F.transform(f"p{terms.index(w)}", _expected(j)) for j, w in enumerate(words)]
        near = both.select("key", "field", "dl", F.explode(F.concat(*at)).alias("t")).select("key", "field", "dl", "t.j", "t.a", F.explode(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(1 << (o + slop)).alias("bit")) for o in range(-slop, slop + 1)))).alias("w"))
        masks = [F.bit_or(F.when(F.col("j") == j, F.col("w.bit")).otherwise(0)).alias(f"m{j}") for j in range(len(words))]
        anchors = near.groupBy("key", "field", (F.col("a") - F.col("w.o")).alias("t")).agg(F.first("dl").alias("dl"), *masks)
        weight = F.lit(0.0)
        for moves in range(slop, -1, -1):
            weight = F.when(_within(words, slop, moves), 1 / (1 + moves)).otherwise(weight)
        anchored = anchors.where(F.col("m0").bitwiseAND(1 << slop) != 0)
        freq = anchored.groupBy("key", "field").agg(F.first("dl").alias("dl"), F.sum(weight).alias("freq")).where("freq > 0")
        idf = reduce(lambda a, b: a + b, [F.ln(1 + (F.col("_n") - F.col(f"d{terms.index(w)}") + 0.5) / (F.col(f"d{terms.index(w)}") + 0.5)) for w in words])
        f = F.col("freq")
        score = idf * f * (T.K1 + 1) / (f + T.K1 * (1 - T.B + T.B * F.col("dl") / F.col("_avg")))
        return freq.join(F.broadcast(stats), "field").select("key", "field", score.alias("score"))

    def lexical(self, boosts: dict[str, float], query: str, all_text: str | None = None, slop: int = 2, bonus: float = 2.0) -> DataFrame:
        """(key, score): the keyword executor.

        Fields with enough of the words are added up, typos allowed; all_text counts if it has every word, without typos.
        Two words or more also score as a phrase of at most `slop` moves in their best field, times the field's boost and
        `bonus`, which never changes what matches. Phrases in quotes have to be in some field or all_text, and their best
        field's score counts.
        """
        words, phrases = T.parse_query(query)
        boost = F.element_at(F.create_map(*(F.lit(x) for pair in {**boosts, **({all_text: 1.0} if all_text else {})}.items() for x in pair)), F.col("field"))
        found = None
        if words:
            rows = self.scores(words, list(boosts), typos=True).where(F.col("matched") >= T.required(len(words))).select("key", (F.col("score") * boost).alias("score"))
            if all_text:
                every = self.scores(words, [all_text]).where(F.col("matched") == len(words))
                rows = rows.unionByName(every.select("key", "score"))
            found = rows.groupBy("key").agg(F.sum("score").alias("score"))
            said = T.query_tokens(T.unquoted(query))
            if len(said) > 1:
                more = self.phrase(said, list(boosts), slop).groupBy("key").agg(F.max(F.col("score") * boost * bonus).alias("more"))
                found = found.join(more, "key", "left").select("key", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        for p in phrases:
            fields = [*boosts, *([all_text] if all_text else [])]
            exact = self.phrase(T.query_tokens(p), fields).groupBy("key").agg(F.max(F.col("score") * boost).alias("more"))
            found = exact.select("key", F.col("more").alias("score")) if found is None else found.join(exact, "key").select("key", (F.col("score") + F.col("more")).alias("score"))
        return found if found is not None else self._docs(self.state["segments"]).select("key", F.lit(1.0).alias("score")).distinct()

    def best_field(self, boosts: dict[str, float], query: str) -> DataFrame:
        """(key, score): documents with any of the words, by their best field."""
        boost = F.element_at(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair)), F.col("field"))
        words = list(dict.fromkeys(T.query_tokens(query)))
        return self.scores(words, list(boosts)).groupBy("key").agg(F.max(F.col("score") * boost).alias("score"))

    def top(self, words: list[str], field: str, k: int) -> DataFrame:
        """(key, score): the k best of one field, reading only blocks that can hold one of them.

        A block's score is bounded by its highest frequency and shortest length. The blocks with the highest bounds give a
        score that k documents reach; blocks that cannot reach it even with the best of all other words are left out.
        """
        words = list(dict.fromkeys(words))
        bounds = self.bounds(words, field)
        if not bounds:
            return self.scores(words, [field]).select("key", "score")
        reached = self._reached(words, field, k, bounds)
        some = self.counts(words, {w: [w] for w in words}, [field], where=self._able(field, bounds, reached))
        n, avg = self.stats([field]).select("_n", "_avg").first()
        # document frequencies are those of whole lists, not of the blocks that were read
        parts = [F.when(F.get("tf", F.lit(i)) > 0, _bm25(F.get("tf", F.lit(i)), F.col("dl"), n, bounds[w][1], avg)).otherwise(0.0) if w in bounds else F.lit(0.0) for i, w in enumerate(words)]
        return some.select("key", reduce(lambda a, b: a + b, parts).alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def bounds(self, words: list[str], field: str) -> dict[str, tuple[float, int]]:
        """The highest bound of a block, and the document frequency, of each word; empty if documents were replaced."""
        if any(s["replaced"] for s in self.state["segments"]) or field not in self.state["fields"]:
            return {}
        n, total = self.state["fields"][field]
        out: dict[str, tuple[float, int]] = {}
        rows = [r for r in (self._rows(s, words, [field]) for s in self.state["segments"]) if r is not None]
        if rows:
            blocks = reduce(DataFrame.unionByName, [r.select("term", "n", "max_tf", "min_dl") for r in rows])
            impact = F.col("max_tf") * (T.K1 + 1) / (F.col("max_tf") + T.K1 * (1 - T.B + T.B * F.col("min_dl") * n / total))
            for r in blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(impact).alias("most")).collect():  # a row for each word
                out[r.term] = float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))) * r.most, r.df
        return out

    def _bound(self, field: str, bounds: dict[str, tuple[float, int]]) -> Column:
        n, total = self.state["fields"][field]
        tf, dl = F.col("max_tf"), F.col("min_dl")
        return reduce(lambda out, w: F.when(F.col("term") == w, _bm25(tf, dl, n, bounds[w][1], total / n)).otherwise(out), bounds, F.lit(0.0))

    def _able(self, field: str, bounds: dict[str, tuple[float, int]], reached: float) -> Column:
        """Blocks whose bound and the best of the other words come up to a score."""
        total = sum(b for b, _ in bounds.values())
        others = reduce(lambda out, w: F.when(F.col("term") == w, total - bounds[w][0]).otherwise(out), bounds, F.lit(0.0))
        return self._bound(field, bounds) + others >= reached * (1 - 1e-9)

    def _reached(self, words: list[str], field: str, k: int, bounds: dict[str, tuple[float, int]]) -> float:
        """A score that k documents have at least: of the blocks with the highest bounds, each word by itself."""
        n, total = self.state["fields"][field]
        rows = reduce(DataFrame.unionByName, [r for r in (self._rows(s, words, [field]) for s in self.state["segments"]) if r is not None])
        best = rows.orderBy(self._bound(field, bounds).desc()).limit(2 * max(1, -(-k // BLOCK)) * len(words))
        each = _exploded(best)
        part = reduce(lambda out, w: F.when(F.col("term") == w, _bm25(F.col("tf"), F.col("dl"), n, bounds[w][1], total / n)).otherwise(out), bounds, F.lit(0.0))
        top = each.groupBy("key").agg(F.sum(part).alias("s")).orderBy(F.desc("s")).limit(k).collect()  # k rows
        return top[-1].s if len(top) == k else 0.0


def _bm25(tf: Column, dl: Column, n: int, df: int, avg: float) -> Column:
    return float(np.log(1 + (n - df + 0.5) / (df + 0.5))) * tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * dl / avg))


def _expected(j: int):
    """A token's place less the number of the word it is."""
    return lambda x: F.struct(F.lit(j).alias("j"), (x - j).alias("a"))


def _within(words: list[str], slop: int, moves: int) -> Column:
    """Whether all words have tokens in some window of `moves` + 1 places that holds the first word's, no token twice.
    m<j> has bit o + slop for each token of word j that is o places from where the first word's token expects it."""
    ways = []
    for low in range(-moves, 1):
        places = range(low, low + moves + 1)
        parts = []
        for w in dict.fromkeys(words):
            slots = [j for j, x in enumerate(words) if x == w]
            if len(slots) == 1:
                j = slots[0]
                parts.append(F.col(f"m{j}").bitwiseAND(sum(1 << (o + slop) for o in ([0] if j == 0 else places))) != 0)
                continue
            choices = [c for c in product(*([0] if j == 0 else places for j in slots)) if len({j + o for j, o in zip(slots, c)}) == len(slots)]
            each = [reduce(lambda a, b: a & b, [F.col(f"m{j}").bitwiseAND(1 << (o + slop)) != 0 for j, o in zip(slots, c)]) for c in choices]
            parts.append(reduce(lambda a, b: a | b, each) if each else F.lit(False))
        ways.append(reduce(lambda a, b: a & b, parts))
    return reduce(lambda a, b: a | b, ways)


def stored(df: DataFrame, key: str, fields: dict[str, Column], folder: str) -> Index:
    """The index of a table that files hold, under `folder`; built if it isn't there for just these files and columns."""
    plan = df.select(key, *(c.alias(f"_f{i}") for i, c in enumerate(fields.values())))
    text = re.sub(r"(_\d+)?#\d+L?", "", plan._jdf.queryExecution().optimizedPlan().toString())
    root = f"{folder.rstrip('/')}/index-{fingerprint(df, FORMAT, key, list(fields), text)}"
    index = Index(df.sparkSession, root)
    if index.version:
        return index
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        df = df.repartition(cores)  # few files or row groups: else a few tasks would split all texts
    try:
        return index.add(df, key, fields)
    except Taken:
        return Index(df.sparkSession, root)
