"""Substring dedup of byte strings: suffix arrays.

Bytes covered by a WINDOW-byte string that also starts earlier (in a document with a smaller doc_id, or before it in
the same one) are removed. The corpus is cut and dealt as windows.py says, so that equal strings meet in one shard. A
shard's texts are one text, whose suffix array is built by Larsson-Sadakane refinement in numpy (only groups that
are still unsorted are sorted again, by the rank a doubled distance away, up to WINDOW bytes), and whose common
prefixes are found as Kasai does, many stretches of the text in step. Runs of suffixes with a common prefix of a
window or more are equal strings, of which all but the first are removed. A minimizer with more text than a shard
spans several, which are merged by binary search: each string's first place in a later shard is looked up in the
sorted strings of the earlier ones.

Defined results: a null or empty text has no bytes; texts shorter than a window lose nothing; a null doc_id is in no
order, so its row loses nothing and takes nothing; different texts under one doc_id follow each other in the order of
their hashes, equal ones are one document; removal may split a character, so what is kept are bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.kernel import blocks, cover, pair, runs, sliding_min
from quarrylight.llm.store import documents
from quarrylight.llm.windows import HOT, INNER, LOCAL, MOST, WILD, Finder, Piece, beside, cut, inner, keyed, runs_of, sides, spans

WINDOW, ANCHOR = 100, 16
#: Bytes of text under one suffix array; bytes of documents that are cut at a time.
SHARD, PIECE = 1 << 20, 1 << 20
_SEED = 0x9D39247E33776D41
#: Positions of a stretch of Kasai's walk, at least and at most.
STRETCH = 32, 256


def eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    n = len(flat) - 7
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(flat), strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def hashed(eight: np.ndarray, at: np.ndarray | slice, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the `size` >= 8 bytes from each place on, eight at a time; the last ones may overlap."""
    shift = (lambda k: slice(k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    out = eight[shift(0)] ^ np.uint64(seed)
    for k in (*range(8, size - 8, 8), *([size - 8] if size > 8 else [])):
        out = pair(out, eight[shift(k)])
    return out


def _scan(window: int, anchor: int, piece: int):
    def one(i, flat, at, base, inner_):
        size = len(flat) - window + 1
        if size <= 0:
            return None
        eight = eights(flat)
        whole = lambda x: hashed(eight, x, window)
        g = hashed(eight, slice(0, len(flat) - anchor + 1), anchor)
        low = sliding_min(g, window - anchor + 1)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        valid = np.arange(size) + window <= at[row[:size] + 1]
        start, n, m = cut(low, valid, row, window)
        near, wild = sides(g, low, start, n, m, lambda x: hashed(eight, x, anchor + (window - anchor + 1) // 2), at, window, anchor)
        state = wild * WILD
        if inner_:
            state[wild] |= inner(start[wild], n[wild], whole) * INNER  # equal windows of a segment have the minimizer at two places
        return Piece(i, at[:-1], base, size, whole, lambda x: hashed(eight, x, window, _SEED), start, n, m, state, near, lambda a, b: flat[a:b].tobytes())

    def scan(column, inner_: bool):
        for i, j, flat, at in blocks(column, piece):
            if j - i > 1 or len(flat) <= piece:
                if (got := one(i, flat, at, 0, inner_)) is not None:
                    yield got
                continue
            for a in range(0, len(flat), piece):  # one long document, in pieces that share a window less a byte
                part = flat[a : a + piece + window - 1]
                if (got := one(i, part, np.array([0, len(part)]), a, inner_)) is not None:
                    yield got

    return scan


def _extract(window: int):
    def extract(column):
        r, data = -1, b""

        def get(row, start, n):
            nonlocal r, data
            out = []
            for k, a, b in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
                if k != r:
                    r, data = k, (column[k].as_py() or "").encode()
                out.append(data[a : a + b + window - 1])
            return out

        return get

    return extract


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their first `depth` >= 8 bytes, and each place's rank: where its group begins.

    The end of the text counts as zero bytes. Larsson and Sadakane's refinement: sorted by 8 bytes at first, then
    only groups of several places are sorted, by the rank at the distance that is sorted already.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray((n,), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = np.flatnonzero(~(head & np.append(head[1:], True)))
    h = 8
    while h < depth and len(slots):
        step = min(h, depth - h)
        place = order[slots]
        key = rank[place] * (n + 1) + rank[np.minimum(place + step, n)] + 1
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[slots] = place
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[place] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h += step
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WINDOW, stretch: int | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """Bytes that each sorted suffix shares with the one before it, `depth` at most; 0 for the first.

    Kasai's walk: the next place of the text shares at least one byte less than the last one did. Stretches of the
    text are walked in step. Where `depth` cut a comparison the order of the next pair is open, and it starts anew. asked:
    the sorted suffixes to be compared, all if it is not given; the others get 0.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    stretch = stretch or min(max(n // 4096, STRETCH[0]), STRETCH[1])
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    eight = np.ndarray((n + depth + 8,), "<u8", buffer=padded, strides=(1,))
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    if asked is not None:
        before[order[~asked]] = -1
    lane = np.arange(0, n, stretch)
    shared = np.zeros(len(lane), np.int64)
    for step in range(min(stretch, n)):
        lane, shared = lane[lane + step < n], shared[: np.count_nonzero(lane + step < n)]
        at = lane + step
        other = before[at]
        shared = np.where(shared >= depth, 0, np.maximum(shared - 1, 0))
        todo = np.flatnonzero(other >= 0)
        shared[other < 0] = 0
        while len(todo):
            h = shared[todo]
            differ = eight[at[todo] + h] ^ eight[other[todo] + h]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            h = np.minimum(h + same, depth)
            shared[todo] = h
            todo = todo[(same == 8) & (h < depth)]
        # bytes beyond the end of the text are not shared
        shared = np.minimum(shared, n - np.maximum(at, other))
        out[slot[at]] = shared
    return out


def repeated(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined texts: where each text begins, whether a window starts at a place and equals an earlier one, and the first places of all others.

    Equal texts are one in the suffix array; all windows of the later ones are repeats.
    """
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    first: dict[bytes, int] = {}
    own = np.array([first.setdefault(t, k) == k for k, t in enumerate(texts)])
    flat = np.frombuffer(b"".join(first), np.uint8)
    size = np.diff(begin)[own]
    at = np.concatenate(([0], np.cumsum(size)))
    order, rank = suffix_array(flat, window)
    # what refinement has parted shares less than a window
    together = rank[order] != np.arange(len(flat))
    group = np.cumsum(common_prefixes(flat, order, window, asked=together) < window)
    valid = np.arange(len(flat)) + window <= np.repeat(at[1:], size)
    keep = valid[order]
    place, group = order[keep], group[keep]
    by = np.lexsort((place, group))
    place, group = place[by], group[by]
    fresh = np.ones(len(place), bool)
    fresh[1:] = group[1:] != group[:-1]
    place += np.repeat(begin[:-1][own] - at[:-1], size)[place]  # from places in the distinct texts to places in all
    again = np.zeros(begin[-1] + 1, bool)
    again[place[~fresh]] = True
    for k in np.flatnonzero(~own):
        again[begin[k] : max(begin[k], begin[k + 1] - window + 1)] = True
    return begin, again, place[fresh]


def strings(flat: bytes, places: np.ndarray, window: int) -> np.ndarray:
    """The windows at places, as sortable values."""
    text = np.frombuffer(flat, np.uint8)
    rows = np.ones((len(places), window + 1), np.uint8)  # the last byte keeps trailing zero bytes
    rows[:, :window] = text[places[:, None] + np.arange(window)]
    return rows.reshape(-1).view(f"S{window + 1}")


def found_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the sorted table has, by binary search."""
    if not len(table) or not len(keys):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _resolver(window: int, shard: int):
    def resolver(batches):
        rows: list[tuple] = []
        size = 0
        family, table = None, np.zeros(0, f"S{window + 1}")  # a minimizer that goes on from shard to shard, and its strings

        def solve(goes_on):
            nonlocal family, table
            begin, again, firsts = repeated([r[5] for r in rows], window)
            flat = b"".join(r[5] for r in rows)
            text = np.searchsorted(begin, firsts, side="right") - 1
            m = np.array([r[0] for r in rows])
            if family is not None and len(table):
                own = np.sort(firsts[m[text] == family])
                again[own[found_in(table, strings(flat, own, window))]] = True
            if goes_on is not None:
                mine = strings(flat, np.sort(firsts[m[text] == goes_on]), window)
                table = np.union1d(table, mine) if family == goes_on else np.unique(mine)
            family = goes_on
            out: list[tuple] = []
            for k, r in enumerate(rows):
                x, y = runs(again[begin[k] : begin[k + 1]])
                out += [(r[1], r[2], r[3] + int(a), int(b - a)) for a, b in zip(x, y, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "part", "start", "n"])

        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "part", "start", "n", "text")), strict=True):
                if size >= shard and (row[0] != last or size >= 2 * shard):
                    yield solve(last if row[0] == last else None)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[5]), row[0]
        if rows:
            yield solve(None)

    return resolver


def _windows(window: int):
    def windows(text: bytes):
        return (text[k : k + window] for k in range(len(text) - window + 1))

    return windows


def _method(window: int):
    def method(texts, doc):
        begin, again, _ = repeated(texts, window)
        for k in range(len(texts)):
            yield from ((k, int(a), int(b)) for a, b in zip(*runs(again[begin[k] : begin[k + 1]]), strict=True))

    return method


def finder(window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD, piece: int = PIECE) -> Finder:
    if not 8 <= anchor < window:
        raise ValueError("an anchor has at least 8 bytes and is shorter than a window")
    return Finder(window, False, _scan(window, anchor, piece), _method(window), _extract(window), _resolver(window, shard), shard, _windows(window))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, local: int = LOCAL, most: int = MOST, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """Keyed documents with the list of (start, n windows) runs to be removed, null if there are none."""
    how = finder(window, anchor, shard, piece)
    whole = keyed(docs)
    return beside(whole, runs_of(whole, how, "suffix", hot, local, most))


def _each(batch, window: int):
    """(rows i to j, bytes, offsets, removed bytes) of each block."""
    start, n, at = spans(batch)
    for i, j, flat, offsets in blocks(batch.column("text")):
        x = slice(at[i], at[j])
        first = np.repeat(offsets[:-1], np.diff(at[i : j + 1])) + start[x]
        yield i, j, flat, offsets, cover(len(flat), first, first + n[x] + window - 1)


def digest(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            for i, j, flat, at, gone in _each(batch, window):
                lost = np.concatenate(([0], np.cumsum(gone)))[at]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                inner = at[:-1][at[:-1] < len(flat)]
                begins[inner] = gone[inner]  # a run ends with its document
                n_spans = np.diff(np.concatenate(([0], np.cumsum(begins)))[at])
                kept, cuts = flat[~gone].tobytes(), at - lost
                sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(lost).astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(sha)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return repeats(docs, window, **options).select("doc_id", "list", "text").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict = {}
