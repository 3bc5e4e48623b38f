"""Repeated windows across a corpus: what substring operators over words and over bytes share.

A window is L consecutive units of one document. Its minimizer, the smallest hash of the K-grams in it, depends on
nothing but its content, so equal windows meet wherever rows are dealt out by minimizer. Consecutive windows with one
minimizer form a segment, of about (L-K)/2 windows: the corpus is shuffled as one small row per segment, not per unit.
Hashes only decide which texts meet. Whether windows are equal is found by each operator's named method alone, on the
texts themselves, in three places:

1. `segments` cuts texts, a piece (a megabyte or some of documents) at a time. Segments that meet others in a piece go
   through the method at once. Segments that are repeated there as a whole travel no further, so a group of copies
   leaves one segment per piece and content.
2. `judged` deals the other segments by minimizer and drops those that meet no other; `resolved` sends the text of the
   rest, dealt in the same way, to the method. Segments meet if they have one minimizer and, beside it, the same units
   to its left or to its right over half of what a window has beyond it: equal windows share one of the two.
3. `hot_minimizers` has counted beforehand which minimizers too many segments share. Their windows are dealt one by one:
   the first place of each is found by a partial aggregate, every other place is joined to the first one (a join that
   Spark splits where a key is hot), places that follow each other become runs, and each run goes through the method
   beside the text of its first place.

The set of hot minimizers has at most HOT_KEYS entries, so that tasks can hold it, and their counts are from below. What
it misses is found on the segments themselves: a minimizer that still has more than MOST of them has its segments opened,
window by window, and these go the way of step 3 (`opened`). So no task holds the text of more than MOST segments of one
minimizer, and none holds more than MOST rows of it to judge them. Documents are told apart by (doc_id, part): part numbers the different texts of a repeated doc_id, and is 0
else. Where repeats count within a document, one row of each takes part, and what is found holds for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import cover, mix, pair, runs, signed, sliding_min
from quarrylight.llm.store import stage

#: Segments that share a minimizer and a side of it from which on the minimizer is hot, or WIDE times as many that share
#: only the minimizer; of these, how many a task has to have; hot minimizers at most.
HOT, WIDE, LOCAL, HOT_KEYS = 4_096, 16, 4, 100_000
#: Segments of one minimizer that may meet in a task.
MOST = HOT * WIDE
#: Minimizers that a task counts before it reports.
_COUNTED = 1 << 20
#: state: FOUND (repeated windows), SINGLE (a window of a hot minimizer, with hashes a and b), or that of a segment: the
#: sum of INNER (some of its own windows are equal) and WILD (its minimizer has several places), with its sides in a.
FOUND, INNER, SINGLE, WILD = 1, 2, 3, 4
SEGMENT = "m long, a long, b long, doc_id long, part int, start int, n int, state int"
_NAMES = ["m", "a", "b", "doc_id", "part", "start", "n", "state"]
_RUN = "doc_id long, part int, start int, n int"


def keyed(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, part, text (and more). Equal texts share a part; ids are told apart by text only where one repeats."""
    docs = docs.select("doc_id", "text", *more)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id")
    if again.isEmpty():
        return docs.select("doc_id", F.lit(0).alias("part"), "text", *more)
    from pyspark.sql.window import Window

    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    parts = docs.join(again, "doc_id", "left_semi").select("doc_id", tag.alias("tag")).distinct()
    parts = parts.withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("tag")) - 1)
    return docs.withColumn("tag", tag).join(parts, ["doc_id", "tag"], "left").select("doc_id", F.coalesce("part", F.lit(0)).alias("part"), "text", *more)


def once(docs: DataFrame) -> DataFrame:
    """One row of each (doc_id, part) of keyed documents, so that a row that is repeated is not a repeat of itself."""
    again = docs.groupBy("doc_id", "part").agg(F.count("*").alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id", "part")
    if again.isEmpty():
        return docs
    one = docs.join(again, ["doc_id", "part"], "left_semi").dropDuplicates(["doc_id", "part"])
    return docs.join(again, ["doc_id", "part"], "left_anti").unionByName(one)


@dataclass
class Piece:
    """Segments of some whole rows of a batch (from row i on), or of a part of one row (from unit `base` of it on).

    first: place where each row begins; size: places of the piece; whole, second: two hashes of the windows at places;
    at, n, m, state, near: place, windows, minimizer, state and sides (32 bits each) of each segment; text: the bytes of the units from one place to another.
    """

    i: int
    first: np.ndarray
    base: int
    size: int
    whole: Callable[[np.ndarray], np.ndarray]
    second: Callable[[np.ndarray], np.ndarray]
    at: np.ndarray
    n: np.ndarray
    m: np.ndarray
    state: np.ndarray
    near: np.ndarray
    text: Callable[[int, int], bytes]

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def start(self, at: np.ndarray) -> np.ndarray:
        """Units before a place in its row."""
        return at - self.first[self.row(at)] + self.base


@dataclass
class Finder:
    """What an operator brings along.

    scan(text column, inner): the pieces; method(texts, documents): runs (text, first window, end) of windows that are
    repeats, among texts in order; extract(text column)(row, start, n): the texts of segments, in order of rows; resolver(batches of
    segments with text, sorted by m and document): runs as rows; shard: bytes of text that the method takes at once;
    windows(text): the content of each window of a segment's text, in order, equal for equal windows.
    """

    window: int
    across: bool
    scan: Callable
    method: Callable
    extract: Callable
    resolver: Callable
    shard: int
    windows: Callable


def cut(low: np.ndarray, valid: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Segments of the windows at each place: (first place, windows, minimizer).

    low: minimizer of the window at each place; valid: whether it lies in one row; a segment has at most `span` windows.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    key = low[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(at)))
    if size.max() > span:
        more = (size + span - 1) // span
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        rest = np.repeat(size, more) - k * span
        first, size = np.repeat(first, more) + k * span, np.minimum(rest, span)
    return at[first], size, key[first]


def sides(g: np.ndarray, low: np.ndarray, at: np.ndarray, n: np.ndarray, m: np.ndarray, wider: Callable, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment a hash of the minimizer with the units to its left, and one with those to its right (32 bits each, 0 if the row ends before), and whether the minimizer has several places in it.

    g: hash of the anchor from each place on; wider: hashes of the anchor and half the rest of a window, from places on;
    first: n+1 places where rows begin.
    """
    w, half = window - anchor + 1, (window - anchor + 1) // 2
    # an anchor is the smallest one of some window if it is the largest of the windows' minima around it
    above = np.zeros(len(g), np.uint64)
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    above[:] = ~sliding_min(~padded, w)[: len(g)]
    place = np.flatnonzero(above == g)
    value, which = np.unique(g[place], return_inverse=True)
    key = which.astype(np.int64) * (len(g) + 1) + place
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    base = np.searchsorted(value, m) * (len(g) + 1)
    lo, hi = np.searchsorted(key, base + at), np.searchsorted(key, base + at + n + w - 1)
    p = place[lo]
    row = np.searchsorted(first, at, side="right") - 1
    left, right = p - half, p
    some_left, some_right = left >= first[row], right + anchor + half <= first[row + 1]

    def take(x, some):
        out = np.zeros(len(x), np.uint64)
        out[some] = (wider(x[some]) >> np.uint64(32)) | np.uint64(1)
        return out

    return take(left, some_left) << np.uint64(32) | take(right, some_right), hi - lo != 1


def places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the segments, in order."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)


def inner(start: np.ndarray, n: np.ndarray, whole: Callable) -> np.ndarray:
    """Which segments hold two equal windows (as in periodic text)."""
    out = np.zeros(len(start), bool)
    if len(start):
        h, which = whole(places(start, n)), np.repeat(np.arange(len(start)), n)
        by = np.lexsort((h, which))
        h, which = h[by], which[by]
        out[which[1:][(h[1:] == h[:-1]) & (which[1:] == which[:-1])]] = True
    return out


def _several(keys: tuple[np.ndarray, ...], doc: np.ndarray, across: bool, more: np.ndarray | None = None) -> np.ndarray:
    """Which rows have equal keys as one of another document (across) or another row; more: rows whose mark counts for all of their group, if that is asked for."""
    order = np.lexsort((doc, *keys))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(order))
    if more is not None:
        several = np.logical_or.reduceat(more[order], begin)
    else:
        several = doc[order][begin] != doc[order][end - 1] if across else end - begin > 1
    out = np.empty(len(order), bool)
    out[order] = np.repeat(several, end - begin)
    return out


def meets(m: np.ndarray, doc: np.ndarray, state: np.ndarray, near: np.ndarray, across: bool) -> np.ndarray:
    """Which segments may have a window of another document; or else of any other segment, or twice."""
    if not len(m):
        return np.zeros(0, bool)
    out = _several((m,), doc, across)
    at = np.flatnonzero(out)
    if len(at):
        m, doc, wild, near = m[at], doc[at], (state[at] & WILD) > 0, near[at]
        sure = _several((m,), doc, across, wild) if wild.any() else wild.copy()
        for side in (near >> np.uint64(32), near & np.uint64(0xFFFFFFFF)):
            some = np.flatnonzero(side)
            if len(some):
                sure[some] |= _several((m[some], side[some]), doc[some], across)
        out[at] = sure
    return out if across else out | ((state & INNER) > 0)


def hot_minimizers(docs: DataFrame, finder: Finder, hot: int = HOT, local: int = LOCAL, keys: int = HOT_KEYS) -> np.ndarray:
    """Sorted minimizers that too many segments share: at most `keys`, those with the most. Segments with the same sides count once a piece."""

    def run(batches):
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            m, side = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((side, m))
            m, side = m[order], side[order]
            begin = np.flatnonzero(np.append(np.ones(min(len(m), 1), bool), (m[1:] != m[:-1]) | (side[1:] != side[:-1])))
            c = np.diff(np.append(begin, len(m)))
            begin, c = begin[c >= local], c[c >= local]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(m[begin])), pa.array(signed(side[begin])), pa.array(c)], names=["m", "side", "c"])

        for batch in batches:
            for p in finder.scan(batch.column("text"), False):
                order = np.lexsort((p.near, p.m))
                m, near = p.m[order], p.near[order]
                fresh = np.ones(len(m), bool)
                fresh[1:] = (m[1:] != m[:-1]) | (near[1:] != near[:-1])
                m, near = m[fresh], near[fresh]
                seen.append((m, np.zeros(len(m), np.uint64)))
                for k, side in enumerate((near >> np.uint64(32), near & np.uint64(0xFFFFFFFF))):
                    some = side > 0
                    seen.append((m[some], side[some] << np.uint64(1) | np.uint64(k)))
                if sum(len(x) for x, _ in seen) > _COUNTED:
                    yield out()
        if seen:
            yield out()

    counts = docs.select("text").mapInArrow(run, "m long, side long, c long").groupBy("m", "side").agg(F.sum("c").alias("c"))
    most = counts.where(F.col("c") > F.when(F.col("side") == 0, hot * WIDE).otherwise(hot)).groupBy("m").agg(F.max("c").alias("c"))
    return np.sort(np.array([r["m"] for r in most.orderBy(F.desc("c"), "m").limit(keys).collect()], np.int64).view(np.uint64))


def _batches(m, a, b, doc, part, start, n, state) -> Iterator[pa.RecordBatch]:
    columns = (signed(m), signed(a), signed(b), doc, part, start.astype(np.int32), n.astype(np.int32), state.astype(np.int32))
    for i in range(0, len(m), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in columns], names=_NAMES)


def _found_at_once(p: Piece, row: np.ndarray, doc: np.ndarray, part: np.ndarray, some: np.ndarray, at: np.ndarray, n: np.ndarray, finder: Finder) -> np.ndarray:
    """Which windows of a piece the method finds repeated, of the chosen segments' texts."""
    found = np.zeros(p.size + 1, bool)
    begin, end = runs(cover(p.size, at[some], at[some] + n[some]))
    r = p.row(begin) + p.i
    order = np.lexsort((begin, part[r], doc[r]))
    texts, chosen, size = [], [], 0
    for k in [*order.tolist(), None]:
        if texts and (k is None or size > finder.shard):
            for t, x, y in finder.method(texts, doc[r[chosen]]):
                found[begin[chosen[t]] + x : begin[chosen[t]] + y] = True
            texts, chosen, size = [], [], 0
        if k is not None:
            text = p.text(int(begin[k]), int(end[k]) + finder.window - 1)
            if len(text) <= 4 * finder.shard:  # a longer one is left to the shards of its minimizers
                texts.append(text)
                chosen.append(k)
                size += len(text)
    return found


def segments(docs: DataFrame, finder: Finder, hot: np.ndarray) -> DataFrame:
    """Segment rows of keyed documents: repeats found at once, segments to be dealt, and windows of hot minimizers."""

    def rows(p: Piece, known: np.ndarray, doc: np.ndarray, part: np.ndarray):
        row = p.row(p.at) + p.i
        keep = known[row]
        row, at, n, m, state, near = row[keep], p.at[keep], p.n[keep], p.m[keep], p.state[keep], p.near[keep]
        if not len(at):
            return
        some = meets(m, doc[row], state, near, finder.across)
        found = _found_at_once(p, row, doc, part, some, at, n, finder) if some.any() else np.zeros(p.size + 1, bool)
        if found.any():
            begin, end = runs(found)
            r, start = p.row(begin) + p.i, p.start(begin)
            key = mix(pair(doc[r].astype(np.uint64), start.astype(np.uint64)))
            zero = np.zeros(len(begin), np.uint64)
            yield from _batches(key, zero, zero, doc[r], part[r], start, end - begin, np.full(len(begin), FOUND))
        total = np.concatenate(([0], np.cumsum(found)))
        todo = total[at + n] - total[at] < n
        heated = hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m if len(hot) else np.zeros(len(m), bool)
        plain = todo & ~heated
        zero = np.zeros(np.count_nonzero(plain), np.uint64)
        yield from _batches(m[plain], near[plain], zero, doc[row[plain]], part[row[plain]], p.start(at[plain]), n[plain], state[plain])
        if (todo & heated).any():
            x = places(at[todo & heated], n[todo & heated])
            x = x[~found[x]]
            a, b, r, start = p.whole(x), p.second(x), p.row(x) + p.i, p.start(x)
            key = mix(pair(a, mix(pair(doc[r].astype(np.uint64), start.astype(np.uint64)))))
            yield from _batches(key, a, b, doc[r], part[r], start, np.ones(len(x)), np.full(len(x), SINGLE))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            known, doc, part = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0), np.int64), np.asarray(batch.column("part"), np.int32)
            for p in finder.scan(batch.column("text"), not finder.across):
                yield from rows(p, known, doc, part)

    return docs.select("doc_id", "part", "text").mapInArrow(run, SEGMENT)


def judged(found: DataFrame, across: bool, most: int = MOST) -> DataFrame:
    """The segment rows without those segments that meet no other one of their minimizer. Of a minimizer with more than `most` rows all stay."""
    dealt = found.repartition("m").sortWithinPartitions("m")  # one long: a radix sort

    def out(x: list[np.ndarray]):
        m, near, doc, state = x[0], x[1].view(np.uint64), x[3], x[7]
        plain = np.flatnonzero(state % 2 == 0)
        keep = np.ones(len(m), bool)
        keep[plain] = meets(m[plain], doc[plain], state[plain], near[plain], across)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(y[keep]) for y in x], names=_NAMES)

    def run(batches):
        held: list[list[np.ndarray]] = []  # the rows of the last minimizer, which may go on in the next batch
        passed = None  # a minimizer with too many rows
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [np.asarray(batch.column(c)) for c in _NAMES]
            if passed is not None:
                more = int(np.searchsorted(x[0], passed, side="right"))
                if more:
                    yield batch.slice(0, more)
                if more == batch.num_rows:
                    continue
                x, passed = [y[more:] for y in x], None
            if held and held[0][0][0] == x[0][-1]:  # nothing but the held minimizer
                held.append(x)
            else:
                x = [np.concatenate(y) for y in zip(*held, x, strict=True)]
                last = int(np.searchsorted(x[0], x[0][-1]))
                held = [[y[last:] for y in x]]
                yield from out([y[:last] for y in x])
            if sum(len(y[0]) for y in held) > most:
                passed = held[0][0][0]
                yield from (pa.RecordBatch.from_arrays([pa.array(z) for z in y], names=_NAMES) for y in held)
                held = []
        if held:
            yield from out([np.concatenate(y) for y in zip(*held, strict=True)])

    return dealt.mapInArrow(run, SEGMENT)


def _lists(batch: pa.RecordBatch, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Row of each entry of a batch's lists, and the entries' fields."""
    lists = batch.column("list")
    flat = lists.flatten()
    return np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0))), *(np.asarray(flat.field(c)) for c in names)


def _with_text(rows: DataFrame, docs: DataFrame, extract: Callable, keys: tuple[str, ...]) -> DataFrame:
    """Segments (keys, doc_id, part, start, n) and their texts."""
    names = [*keys, "doc_id", "part", "start", "n", "text"]

    def send(batches):
        for batch in batches:
            row, start, n, *own = _lists(batch, ("start", "n", *keys))
            doc, part = np.asarray(batch.column("doc_id"))[row], np.asarray(batch.column("part"))[row]
            get = extract(batch.column("text"))
            for i in range(0, len(row), 4096):
                x = slice(i, i + 4096)
                text = pa.array(get(row[x], start[x], n[x]), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(k[x]) for k in own), pa.array(doc[x]), pa.array(part[x]), pa.array(start[x]), pa.array(n[x]), text], names=names)

    listed = rows.groupBy("doc_id", "part").agg(F.collect_list(F.struct(*keys, "start", "n")).alias("list"))
    return docs.join(listed, ["doc_id", "part"]).select("doc_id", "part", "text", "list").mapInArrow(send, f"{', '.join(f'{k} long' for k in keys)}, {_RUN}, text binary")


def resolved(rows: DataFrame, docs: DataFrame, finder: Finder) -> DataFrame:
    """(doc_id, part, start, n): runs of repeated windows among segments that met others."""
    sent = _with_text(rows, docs, finder.extract, ("m",))
    return sent.repartition("m").sortWithinPartitions("m", "doc_id", "part", "start").mapInArrow(finder.resolver, _RUN)


def opened(rows: DataFrame, docs: DataFrame, finder: Finder) -> DataFrame:
    """The windows of segments as rows of state SINGLE, told apart by 128 bits of their content."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                size, hashes = [], []
                for text in part.column("text").to_pylist():
                    own = [xxhash.xxh3_128_digest(w) for w in finder.windows(text)]
                    size.append(len(own))
                    hashes += own
                a, b = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2).T
                doc, number, start = (np.repeat(np.asarray(part.column(c)), size) for c in ("doc_id", "part", "start"))
                start = start + places(np.zeros(len(size), np.int64), np.array(size, np.int64))
                yield from _batches(a ^ b, a, b, doc, number, start, np.ones(len(a)), np.full(len(a), SINGLE))

    return _with_text(rows, docs, finder.extract, ("m",)).mapInArrow(run, SEGMENT)


def _joined_runs(batches):
    """Single windows of a document that follow each other, as their first places do, as one run."""
    for batch in batches:
        row, start, *lead = _lists(batch, ("start", "lead_doc", "lead_part", "lead_start"))
        order = np.lexsort((start, lead[2] - start, lead[1], lead[0], row))
        row, start, lead = row[order], start[order].astype(np.int64), [x[order].astype(np.int64) for x in lead]
        same = (row, lead[0], lead[1], lead[2] - start, start - np.arange(len(start)))
        fresh = np.any([np.append(np.ones(min(len(x), 1), bool), x[1:] != x[:-1]) for x in same], axis=0)
        at = np.flatnonzero(fresh)
        n = np.diff(np.append(at, len(start)))
        columns = [pa.array(x[at]) for x in lead] + [batch.column(c).take(pa.array(row[at])) for c in ("doc_id", "part")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(start[at].astype(np.int32)), pa.array(n.astype(np.int32))], names=[*_LEAD, "doc_id", "part", "start", "n"])


_LEAD = ("lead_doc", "lead_part", "lead_start")


def resolved_singles(rows: DataFrame, docs: DataFrame, finder: Finder, name: str) -> DataFrame:
    """The same among single windows (a, b, doc_id, part, start): each is held against the first place of its hashes.

    The table of first places is written, so that Spark can split the joins with it where a key is hot.
    """
    own = F.struct("doc_id", "part", "start")
    leads = rows.groupBy("a", "b").agg(F.min(own).alias("lead"), F.max(own).alias("last"))
    leads = stage(leads.where("lead.doc_id < last.doc_id" if finder.across else "lead < last").select("a", "b", "lead"), f"{name}-leads")
    later = rows.join(leads, ["a", "b"]).where("doc_id > lead.doc_id" if finder.across else "struct(doc_id, part, start) > lead")
    place = F.struct("start", *(F.col(f"lead.{c}").alias(k) for c, k in zip(("doc_id", "part", "start"), _LEAD, strict=True)))
    listed = later.groupBy("doc_id", "part").agg(F.collect_list(place).alias("list"))
    pairs = stage(listed.mapInArrow(_joined_runs, "lead_doc long, lead_part long, lead_start long, doc_id long, part int, start int, n int"), f"{name}-pairs")
    first = pairs.select(F.col("lead_doc").alias("doc_id"), F.col("lead_part").cast("int").alias("part"), F.col("lead_start").cast("int").alias("start"), "n").distinct()
    first = _with_text(first.withColumn("k", F.lit(0).cast("long")), docs, finder.extract, ("k",))
    first = first.select(F.col("doc_id").alias("lead_doc"), F.col("part").cast("long").alias("lead_part"), F.col("start").cast("long").alias("lead_start"), "n", F.col("text").alias("lead_text"))
    both = _with_text(pairs, docs, finder.extract, _LEAD).join(first, [*_LEAD, "n"])

    def run(batches):
        for batch in batches:
            size = sum(map(len, batch.column("text").slice(0, 64).to_pylist())) // max(1, min(64, batch.num_rows)) + 1
            step = max(1, finder.shard // (2 * size))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lead = dict(zip(part.column("lead_text").to_pylist(), part.column("lead_doc").to_pylist(), strict=True))
                doc, start = (np.asarray(part.column(c)) for c in ("doc_id", "start"))
                got = finder.method([*lead, *part.column("text").to_pylist()], np.array([*lead.values(), *doc.tolist()], np.int64))
                got = np.array([(k - len(lead), x, y) for k, x, y in got if k >= len(lead)], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[got[:, 0]]), part.column("part").take(pa.array(got[:, 0])), pa.array((start[got[:, 0]] + got[:, 1]).astype(np.int32)), pa.array((got[:, 2] - got[:, 1]).astype(np.int32))],
                    names=["doc_id", "part", "start", "n"],
                )

    return both.mapInArrow(run, _RUN)


def runs_of(docs: DataFrame, finder: Finder, name: str, hot: int = HOT, local: int = LOCAL, most: int = MOST) -> DataFrame:
    """(doc_id, part, list of (start, n)): the repeated windows of each document that has some, as runs."""
    if not finder.across:
        docs = once(docs)
    heated = hot_minimizers(docs, finder, hot, local)
    found = stage(judged(segments(docs, finder, heated), finder.across, most), f"{name}-segments")
    every = found.where(F.col("state") == FOUND).select("doc_id", "part", "start", "n")
    plain, singles = found.where(F.col("state") % 2 == 0), found.where(F.col("state") == SINGLE)
    large = stage(plain.groupBy("m").agg(F.count("*").alias("c")).where(F.col("c") > most).select("m"), f"{name}-large")
    some = not large.isEmpty()
    if some:
        singles = singles.unionByName(stage(opened(plain.join(large, "m", "left_semi"), docs, finder), f"{name}-opened"))
        plain = plain.join(large, "m", "left_anti")
    every = every.unionByName(resolved(plain, docs, finder))
    if some or len(heated):
        every = every.unionByName(resolved_singles(singles, docs, finder, name))
    return every.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", "n")).alias("list"))


def beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed documents with their lists of runs. Rows without a doc_id take no part in the join, so that its shuffle of the texts is the one that `resolved` has made."""
    alone = docs.where("doc_id IS NULL").withColumn("list", F.lit(None).cast(found.schema["list"].dataType))
    return docs.where("doc_id IS NOT NULL").join(found, ["doc_id", "part"], "left").unionByName(alone)


def spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each row's runs, and where each row's runs begin."""
    lists = batch.column("list")
    flat = lists.flatten()
    start, n = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "n"))
    at = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
    return start, n, at
