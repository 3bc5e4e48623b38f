"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact confirmation.

Words are runs of letters and digits in lower case; a text's features are its five-word shingles, each as heavy as it
is frequent. For every benchmark item, windows of the item's length slide over each document; only windows that share
a shingle with an item of their length can be similar to it, so only these are fingerprinted (64 signed sums over
shingle hash bits). Fingerprints within RADIUS bits of an item's agree with it in one of 8 blocks but for RADIUS // 8
bits, so tables of all block values within that distance give every such item. Candidates are confirmed by weighted
Jaccard similarity, the sum of the smaller over the sum of the larger weights.

The benchmark is split into blocks of at most ITEMS items and about ITEM_BYTES bytes; documents are scanned once for
each block, so what is sent to the executors is bounded whatever the benchmark's size. No shuffle.

At similarity 0.75 a fingerprint differs in 11 bits on average (3 standard deviation), so RADIUS loses 5 in 100,000 of
the windows exactly at the threshold.

Defined results: null or empty texts and items without words match nothing; an item or document of fewer than five
words has one shingle, all of it; a document shorter than an item is one window; repeated documents are reported each,
repeated items each under its item_id; a null id is reported as null.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import Words, blocks, grams
from quarrylight.llm.store import documents

SHINGLE, PERCENT = 5, 75
RADIUS, PARTS = 23, 8
ITEMS, ITEM_BYTES = 2_000, 4 << 20
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long"

_letters = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
_MARKS = np.ones(256, bool)
_MARKS[_letters] = False
_FILTER_BITS = 22


def _words(flat: np.ndarray, at: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8), at, _MARKS)
    return words, words.hashes()


def _sums(shingles: np.ndarray) -> np.ndarray:
    """Running signed sums of the hash bits: row i sums the first i shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    out = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=out[1:])
    return out


def fingerprints(shingles: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start on, as 8 bytes."""
    total = _sums(shingles)
    return np.packbits(total[start + n] - total[start] > 0, axis=1)


_near: dict[int, np.ndarray] = {}


def _within(bits: int) -> np.ndarray:
    """Which pairs of byte values differ in at most so many bits."""
    if bits not in _near:
        x = np.arange(256, dtype=np.uint8)
        _near[bits] = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    return _near[bits]


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], radius: int = RADIUS):
        self.radius = radius
        self.ids, self.size, self.weights, prints, owners = [], [], [], [], defaultdict(list)
        for item_id, text in items:
            flat = np.frombuffer((text or "").encode(), np.uint8)
            words, h = _words(flat, np.array([0, len(flat)]))
            if not len(h):
                continue
            g = grams(h, min(SHINGLE, len(h)))
            k = len(self.ids)
            self.ids.append(item_id)
            self.size.append(len(h))
            self.weights.append(np.unique(g, return_counts=True))
            prints.append(fingerprints(g, np.array([0]), len(g))[0])
            for x in self.weights[-1][0].tolist():
                owners[min(SHINGLE, len(h)), x].append(k)
        self.prints = np.array(prints, np.uint8).reshape(-1, PARTS)
        #: By shingle length: sorted shingles, and the items of each.
        self.tables = {}
        for k in {k for k, _ in owners}:
            keys = np.array(sorted(x for n, x in owners if n == k), np.uint64)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[k] = keys, [owners[k, x] for x in keys.tolist()], maybe
        self.of_size = defaultdict(list)
        for k, n in enumerate(self.size):
            self.of_size[n].append(k)
        near = _within(radius // PARTS)
        #: By length: for each block of a fingerprint, which items are near each value.
        self.multi = {n: np.stack([near[:, self.prints[ks, b]] for b in range(PARTS)]) for n, ks in self.of_size.items()}

    def hits(self, h: np.ndarray, first: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """By row, by item length: the places in the row of shingles that an item of that length has."""
        out: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for k, (keys, owners, maybe) in self.tables.items():
            g = grams(h, k)
            at = np.flatnonzero(maybe[g >> np.uint64(64 - _FILTER_BITS)])
            at = at[keys[np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)] == g[at]]
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + k <= first[row + 1]
            for p, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                for n in {self.size[i] for i in owners[int(np.searchsorted(keys, g[p]))]}:
                    out[r][n].append(p - int(first[r]))
        return out

    def search(self, h: np.ndarray, places: list[int], n: int, percent: int = PERCENT) -> list[tuple[int, float, int, int]]:
        """(item, similarity, start, words) of the best window of n words of a row for each item of that length."""
        k = min(SHINGLE, n, len(h))
        g = grams(h, k)
        span = min(n - k + 1, len(g)) if n >= SHINGLE else 1
        p = np.array(places)
        lo, hi = np.maximum(p - span + 1, 0), np.minimum(p, len(g) - span)
        marks = np.zeros(len(g) + 2, np.int64)
        np.add.at(marks, lo, 1)
        np.add.at(marks, np.maximum(hi, lo) + 1, -1)
        start = np.flatnonzero(np.cumsum(marks[: len(g) - span + 1]) > 0)
        items = np.array(self.of_size[n])
        best: dict[int, tuple[float, int]] = {}
        for a in range(0, len(start), 4096):
            part = start[a : a + 4096]
            f = fingerprints(g, part, span)
            near = np.zeros((len(part), len(items)), bool)
            for b in range(PARTS):
                near |= self.multi[n][b][f[:, b]]
            w, c = np.nonzero(near)
            d = np.bitwise_count(f[w] ^ self.prints[items[c]]).sum(axis=1)
            for i, j in zip(w[d <= self.radius].tolist(), c[d <= self.radius].tolist(), strict=True):
                x, y = np.unique(g[part[i] : part[i] + span], return_counts=True)
                u, v = self.weights[items[j]]
                _, xi, ui = np.intersect1d(x, u, assume_unique=True, return_indices=True)
                low = int(np.minimum(y[xi], v[ui]).sum())
                top = int(y.sum() + v.sum()) - low
                if 100 * low >= percent * top and (low / top, -int(part[i])) > best.get(int(items[j]), (0.0, 0)):
                    best[int(items[j])] = low / top, -int(part[i])
        return [(k_, s, -at, min(n, len(h))) for k_, (s, at) in sorted(best.items())]

    def scan(self, column, percent: int = PERCENT):
        """(row, item, similarity, start, words) of a text column."""
        for i, _, flat, at in blocks(column):
            words, h = _words(flat, at)
            found = self.hits(h, words.first)
            for r in sorted(found):
                own = h[words.first[r] : words.first[r + 1]]
                for n, places in sorted(found[r].items()):
                    if len(own) >= min(n, SHINGLE):
                        for k, s, a, size in self.search(own, places, n, percent):
                            yield i + r, k, s, a, size


def _size(benchmark: DataFrame) -> tuple[int, int]:
    row = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return int(row["n"]), int(row["bytes"])


def item_blocks(benchmark: DataFrame, items: int = ITEMS, item_bytes: int = ITEM_BYTES):
    """Lists of (item_id, text), of about half the bounds each, so that an uneven deal stays within them."""
    n, size = _size(benchmark)
    count = max(1, -(-2 * n // items), -(-2 * size // item_bytes)) if n > items or size > item_bytes else 1
    for b in range(count):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b) if count > 1 else benchmark
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, items: int = ITEMS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A row for each document and benchmark item that some window of it is similar to."""
    out = None
    for block in item_blocks(benchmark, items, item_bytes):
        index = Index(block)

        def run(batches, index=index):
            for batch in batches:
                got = list(index.scan(batch.column("text"), percent))
                ids = batch.column("doc_id").to_pylist() if got else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[r] for r, *_ in got], pa.int64()),
                        pa.array([index.ids[k] for _, k, *_ in got], pa.int64()),
                        pa.array([round(s, 6) for _, _, s, *_ in got], pa.float64()),
                        pa.array([a for *_, a, _ in got], pa.int64()),
                        pa.array([n for *_, n in got], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "similarity", "start_word", "n_words"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, items: int = ITEMS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents without a window similar to a benchmark item; all columns stay."""
    for block in item_blocks(benchmark, items, item_bytes):
        index = Index(block)

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in index.scan(batch.column(batch.schema.get_field_index("text")), percent)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLES: dict = {}
