"""Substring dedup of passages: repeated-phrase automata.

Words covered by a window of WINDOW words that also starts in a document with a smaller doc_id are removed. The corpus
is cut and dealt as windows.py says, so that possible repeats of one window meet in one shard. A shard first confirms
which windows recur in its texts and joins them to passages, taken from the smallest document; it compiles tiles of
these passages, one in every window, into an Aho-Corasick automaton over word numbers; then it streams all its texts
through the automaton, grows each tile found to the longest common run, and reports runs of a window or more. Every
removed word is found in this way: equal hashes decide which texts meet, never what is removed.

Defined results: a null or empty text has no words; texts shorter than a window lose nothing; a null doc_id is in no
order, so its row loses nothing and takes nothing; rows that repeat a doc_id do not take from each other; tables may
have any other columns.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import Words, blocks, cover, grams, pair, runs, sliding_min
from quarrylight.llm.store import documents
from quarrylight.llm.windows import HOT, LOCAL, MOST, WILD, Finder, Piece, beside, cut, keyed, runs_of, sides, spans

WINDOW, ANCHOR, TILE = 50, 12, 25
#: Bytes of text that one automaton serves; bytes of documents that are cut at a time.
SHARD, PIECE = 1 << 21, 1 << 22


def _scan(window: int, anchor: int):
    def scan(column, inner: bool):
        for i, _, flat, at in blocks(column, PIECE):
            words = Words(flat, at)
            h = words.hashes()
            whole = grams(h, window)
            if not len(whole):
                continue
            g = grams(h, anchor)
            low = sliding_min(g, window - anchor + 1)
            hash_ = lambda x, whole=whole: whole[x]
            start, n, m = cut(low, words.fits(window)[: len(whole)], words.row(), window)
            wide = grams(h, anchor + (window - anchor + 1) // 2)
            near, wild = sides(g, low, start, n, m, lambda x, wide=wide: wide[x], words.first, window, anchor)
            second = lambda x, h=h: grams(h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), window)[x]
            text = lambda a, b, flat=flat, words=words: flat[words.start[a] : words.end[b - 1]].tobytes()
            yield Piece(i, words.first[:-1], 0, len(whole), hash_, second, start, n, m, wild * WILD, near, text)

    return scan


def _extract(window: int):
    def extract(column):
        r, data, words = -1, b"", None

        def get(row, start, n):
            nonlocal r, data, words
            out = []
            for k, a, b in zip(row.tolist(), start.tolist(), (start + n).tolist(), strict=True):
                if k != r:
                    r, data = k, (column[k].as_py() or "").encode()
                    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                out.append(data[words.start[a] : words.end[b + window - 2]])
            return out

        return get

    return extract


def confirm(ids: list[np.ndarray], low: np.ndarray, high: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Passages (text, start, end): maximal runs, in the smallest document, of windows that recur in another one.

    ids: word numbers of each text, which the documents from low to high have; windows whose numbers hash alike are
    taken for equal here, and words are compared where passages are found.
    """
    flat = np.concatenate(ids).astype(np.uint64)
    size = np.array([len(x) for x in ids])
    offset = np.concatenate(([0], np.cumsum(size)))
    a = grams(pair(flat, flat + np.uint64(0x51ED270B)), window)
    text = np.repeat(np.arange(len(ids)), size)[: len(a)]
    valid = np.flatnonzero(np.arange(len(a)) + window <= offset[text + 1])
    if not len(valid):
        return []
    a, text = a[valid], text[valid]
    order = np.lexsort((valid, low[text], a))
    a, text, valid = a[order], text[order], valid[order]
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    count = np.diff(np.append(begin, len(a)))
    lead = np.repeat(low[text][begin], count)
    recurs = np.repeat(np.maximum.reduceat(high[text], begin), count) != lead
    source = np.sort(valid[recurs & (low[text] == lead)])
    flags = np.zeros(len(flat) + 1, bool)
    flags[source] = True
    out = []
    for t in np.unique(np.searchsorted(offset, source, side="right") - 1):
        x, y = runs(flags[offset[t] : offset[t + 1]])
        out += [(int(t), int(i), int(j) + window - 1) for i, j in zip(x, y, strict=True)]
    return out


def automaton(passages: list[tuple[int, int, int]], ids: list[np.ndarray], tile: int):
    """Tiles of the passages as key sequences; the value lists (passage, place of the tile in it)."""
    tiles: dict[tuple, list] = {}
    for p, (t, a, b) in enumerate(passages):
        words = ids[t]
        for x in {*range(a, b - tile + 1, tile), b - tile}:
            tiles.setdefault(tuple(words[x : x + tile].tolist()), []).append((p, x))
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, value in tiles.items():
        out.add_word(key, value)
    if tiles:
        out.make_automaton()
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def locate(texts: list[bytes], doc: np.ndarray, window: int = WINDOW, tile: int = TILE) -> list[tuple[int, int, int]]:
    """(text, start, end): runs of words of each text that a text of a smaller document has, of at least a window.

    Words are what bytes.split() gives: it parts at 0x20 and 0x09-0x0D, as the kernel does. Equal texts are streamed
    once, for all documents that have them.
    """
    owners: dict[bytes, list[int]] = {}
    for k, t in enumerate(texts):
        owners.setdefault(t, []).append(k)
    low, high = (np.array([f(doc[o]) for o in owners.values()]) for f in (np.min, np.max))
    table: dict[bytes, int] = {}
    ids = [np.array([table.setdefault(w, len(table) + 1) for w in t.split()], np.int64) for t in owners]
    passages = confirm(ids, low, high, window)
    if not passages:
        return []
    machine = automaton(passages, ids, tile)
    out = []
    for words, last, rows in zip(ids, high, owners.values(), strict=True):
        known: dict[tuple[int, int], int] = {}  # (passage, diagonal): up to where it is grown
        got: set[tuple[int, int, int]] = set()  # (document of the passage, start, end)
        for end, found in machine.iter(tuple(words.tolist())):
            for p, x in found:
                t, a, b = passages[p]
                if low[t] >= last:
                    continue
                begin = end - tile + 1
                if known.get((p, begin - x), -1) >= end:
                    continue
                source = ids[t]
                right = _common(words[end + 1 :], source[x + tile : b])
                left = _common(words[:begin][::-1], source[a:x][::-1])
                known[p, begin - x] = end + right
                if left + tile + right >= window:
                    got.add((int(low[t]), begin - left, end + 1 + right))
        for k in rows if got else ():
            out += [(k, x, y) for x, y in {(x, y) for d, x, y in got if d < doc[k]}]
    return out


def _method(window: int, tile: int):
    def method(texts, doc):
        return [(k, a, b - window + 1) for k, a, b in locate(texts, doc, window, tile)]

    return method


def _windows(window: int):
    def windows(text: bytes):
        words = text.split()
        return (b" ".join(words[k : k + window]) for k in range(len(words) - window + 1))

    return windows


def _resolver(window: int, tile: int, shard: int):
    def solve(rows: list[tuple]):
        doc = np.array([r[1] for r in rows])
        got = locate([r[5] for r in rows], doc, window, tile)
        columns = [[rows[k][c] for k, _, _ in got] for c in (1, 2)]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array([rows[k][3] + a for k, a, _ in got], pa.int32()), pa.array([b - a - window + 1 for _, a, b in got], pa.int32())],
            names=["doc_id", "part", "start", "n"],
        )

    def resolver(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "part", "start", "n", "text")), strict=True):
                if size >= shard and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[5]), row[0]
        if rows:
            yield solve(rows)

    return resolver


def finder(window: int = WINDOW, anchor: int = ANCHOR, tile: int = TILE, shard: int = SHARD) -> Finder:
    if not (0 < anchor < window and 0 < tile and 2 * tile - 1 <= window):
        raise ValueError("a window has to hold an anchor, and a whole tile wherever it starts")
    return Finder(window, True, _scan(window, anchor), _method(window, tile), _extract(window), _resolver(window, tile, shard), shard, _windows(window))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, tile: int = TILE, hot: int = HOT, local: int = LOCAL, most: int = MOST, shard: int = SHARD, more: tuple[str, ...] = ()) -> DataFrame:
    """Keyed documents with the list of (start, n windows) runs to be removed, null if there are none."""
    how = finder(window, anchor, tile, shard)
    whole = keyed(docs, more)
    return beside(whole, runs_of(whole.select("doc_id", "part", "text"), how, "passages", hot, local, most))


def _kept(flat: np.ndarray, words: Words, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words, each followed by a space, and where each row's begin."""
    start, end = words.start[~gone], words.end[~gone]
    size = end - start + 1
    at = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(start, size)
    out = np.append(flat, np.uint8(0x20))[np.minimum(index, len(flat))]
    out[at[1:] - 1] = 0x20
    kept = np.concatenate(([0], np.cumsum(~gone)))[words.first]
    return out.tobytes(), at[kept]


def _assembled(window: int):
    """(rows i to j of the batch, words, gone words, kept text, its offsets) of each block."""

    def each(batch):
        start, n, at = spans(batch)
        for i, j, flat, offsets in blocks(batch.column("text")):
            words = Words(flat, offsets)
            x = slice(at[i], at[j])
            first = np.repeat(words.first[:-1], np.diff(at[i : j + 1]))
            gone = cover(len(words.start), first + start[x], first + start[x] + n[x] + window - 1)
            data, begin = _kept(flat, words, gone)
            yield i, j, words, gone, data, begin

    return each


def digest(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    each = _assembled(window)

    def run(batches):
        for batch in batches:
            for i, j, words, gone, data, begin in each(batch):
                lost = np.concatenate(([0], np.cumsum(gone)))[words.first]
                sha = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(words.count.astype(np.int64)), pa.array(np.diff(lost).astype(np.int64)), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    return repeats(docs, window, **options).select("doc_id", "list", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The documents with their kept words, and all their columns; texts that lose nothing stay as they are."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    more = ("rest",) if rest else ()
    joined = repeats(docs.select("doc_id", "text", F.struct(*rest).alias("rest")) if rest else docs, window, more=more, **options).drop("part")
    each = _assembled(window)

    def run(batches):
        for batch in batches:
            where = batch.schema.get_field_index("text")
            column = batch.column(where)
            for i, j, words, gone, data, begin in each(batch):
                lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                text = [column[i + r].as_py() if not lost[r] else data[begin[r] : max(begin[r], begin[r + 1] - 1)].decode() for r in range(j - i)]
                part = batch.slice(i, j - i)
                yield part.set_column(where, batch.schema.field(where), pa.array(text, batch.schema.field(where).type)).drop_columns(["list"])

    out = joined.mapInArrow(run, joined.drop("list").schema)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict = {}
