"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

1. A document's set is its distinct five-word shingles. MinHash samples under many hash functions give BANDS band
   keys. The MinHash sample of one function, the SAMPLES smallest hashes of the set, is folded into an odd sketch: a
   hashed bit is flipped for each, so that the population count of two sketches' XOR estimates how many samples
   differ, most precisely for alike sets. The sketch radius of a pair follows from the sizes of its sets.
2. Documents with equal sets form one class, whose smallest doc_id stands for it from here on.
3. In every band bucket each class is paired with the smallest one; of its pairs within the sketch radius each class
   keeps the closest. These are confirmed on the full sets, and confirmed links are joined to components.
4. What is left are pairs of one bucket in different components. Buckets that still hold several components are
   compared pair by pair on sketches (large ones in blocks), and pairs within the radius are confirmed on the full
   sets, the closest ones of each component first, then all that are not connected by then. So a group of copies
   costs one confirmed link each, and no pair of one bucket is skipped unless its ends are connected already.

With 40 bands of 4 samples a pair of similarity 0.75 shares no bucket with probability 3e-7. The radius lies
DEVIATIONS standard deviations above what a pair at the threshold has (3 in 10 million are further off).

Defined results: a null or empty text has an empty set and links with nothing; a null doc_id links with nothing and is
kept; rows that repeat a doc_id are one document for links, and each is returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.graph import components
from quarrylight.llm.kernel import Words, blocks, grams, mix, pair, signed
from quarrylight.llm.store import documents, stage
from quarrylight.llm.windows import keyed

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
SAMPLES, SKETCH_BITS, DEVIATIONS = 1024, 2048, 5
#: Links of one class that are confirmed in one group; classes of a bucket that are compared in one group.
FAN, BLOCK = 128, 4_096
#: Pairs of each component in a bucket that are confirmed before the rest.
FIRST = 4

_random = np.random.default_rng(20)
_A = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(flat: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's sorted distinct hashes of k words; of all its words if they are fewer; none without words."""
    lower = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    words = Words(lower, at)
    h = words.hashes()
    g = grams(h, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            whole = h[a:b]
            out = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in whole:
                    out = pair(np.array([out]), np.array([x]))[0]
            yield np.array([out], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _A + _B).min(axis=0))
    return mix(low)


def bands_of(samples: np.ndarray) -> np.ndarray:
    """A key for each band, of n rows of samples."""
    x = samples.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2]).copy()
    for r in range(ROWS):
        key = pair(key, x[:, :, r])
    return key


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of the smallest hashes of a sorted set, packed in 64-bit lanes."""
    bit = (mix(s[:SAMPLES] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.uint64)


def radius(a, b, percent: int = PERCENT, fn=np):
    """Bits that sketches of sets of a and b shingles may differ in if the sets are similar; fn: numpy, or Spark's functions."""
    least, most, root, exp = (np.minimum, np.maximum, np.sqrt, np.exp) if fn is np else (F.least, F.greatest, F.sqrt, F.exp)
    one, k = (1.0, float(SAMPLES)) if fn is np else (F.lit(1.0), F.lit(float(SAMPLES)))
    common = (a + b) * (percent / (100 + percent))
    share = least(one, k / most(a, b))
    drawn = common * share
    differ = least(k, a) + least(k, b) - drawn * 2
    spread = drawn * (one - least(one, common / most(a, b))) * 8 * (one - share) + differ * differ * (2 / SKETCH_BITS)
    return (one - exp(differ * (-2 / SKETCH_BITS))) * (SKETCH_BITS / 2) + root(spread) * DEVIATIONS + 2


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(signed(np.ascontiguousarray(x).ravel())))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), hi and lo (fingerprint of the set), bands and odd sketch; one row per document, no shuffle."""

    def run(batches):
        for batch in batches:
            for i, j, flat, at in blocks(batch.column("text")):
                n = j - i
                size, hi, lo = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                samples, odd = np.zeros((n, BANDS * ROWS), np.uint64), np.zeros((n, SKETCH_BITS // 64), np.uint64)
                for r, s in enumerate(shingle_sets(flat, at)):
                    size[r] = len(s)
                    hi[r], lo[r] = mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64), mix(s + np.uint64(0x27220A95)).sum(dtype=np.uint64)
                    if len(s):
                        samples[r], odd[r] = minhash(s), odd_sketch(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n).cast(pa.int64()), pa.array(size), pa.array(signed(hi)), pa.array(signed(lo)), _lists(bands_of(samples)), _lists(odd)],
                    names=["doc_id", "n", "hi", "lo", "bands", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>, sketch array<long>")


def distance(a, b):
    """Bits in which two sketch columns differ."""
    return sum(F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH_BITS // 64))


def confirm(edges: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of edges (a, b) whose full sets are similar enough.

    Texts are sent to the group of their edges' first end, whose set is built once; an end with over FAN edges is
    spread over several groups.
    """
    degree = edges.groupBy("a").agg(F.count("*").alias("degree"))
    salted = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / FAN)).alias("salt"))
    need = salted.select("a", "salt", F.lit(1).alias("kind"), F.col("b").alias("doc_id")).unionByName(salted.select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("doc_id")).distinct())
    rows = need.join(docs.select("doc_id", "text"), "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches):
        group, firsts = None, []
        for batch in batches:
            a, salt, kind, b = (batch.column(c).to_pylist() for c in ("a", "salt", "kind", "doc_id"))
            x, y = [], []
            for i, j, flat, at in blocks(batch.column("text")):
                for r, s in enumerate(shingle_sets(flat, at), i):
                    if (a[r], salt[r]) != group:
                        group, firsts = (a[r], salt[r]), []
                    if kind[r] == 0:
                        firsts.append(s)
                        continue
                    for t in firsts:
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if both and 100 * both >= percent * (len(s) + len(t) - both):
                            x.append(a[r])
                            y.append(b[r])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _close_pairs(batches, percent: int, most: int | None):
    """Pairs of different components and within the radius, of rows sorted by (key, left, right).

    A pair is reported in the first bucket only that its ends share. most: only pairs that are among the so many
    closest ones of one of their components; None: all.
    """
    columns = ("key", "left", "right", "block", "rep", "root", "n")

    def out(a, b, d):
        for at in range(0, len(a), 20_000):
            x = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(b[x]), pa.array(d[x])], names=["a", "b", "d"])

    def closest(a, b, d, x, y):
        side, pair_ = np.concatenate((x, y)), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((pair_, d[pair_], side))
        side = side[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = side[1:] != side[:-1]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        keep = np.unique(pair_[order[np.arange(len(order)) - lead < most]])
        return tuple(v[keep] for v in (a, b, d, x, y))

    def flush(rows):
        if not rows:
            return
        left, right = rows[0][0], rows[0][1]
        block, rep, root, n = (np.array(x) for x in zip(*[r[2:6] for r in rows], strict=True))
        lanes = np.array([r[6] for r in rows], np.int64).view(np.uint64)
        bands = np.array([r[7] for r in rows], np.int64)
        bands = bands[:, : np.flatnonzero(bands[0] == group[0])[0]]
        size = n.astype(float)
        best = None
        for i in range(0, len(rows), 16):
            ok = (root[i : i + 16, None] != root[None, :]) & (rep[i : i + 16, None] < rep[None, :])
            if left != right:
                ok &= block[i : i + 16, None] != block[None, :]
            p, q = np.nonzero(ok)
            p += i
            d = np.bitwise_count(lanes[p] ^ lanes[q]).sum(axis=1, dtype=np.int64)
            near = d <= radius(size[p], size[q], percent)
            near[near] = ~(bands[p[near]] == bands[q[near]]).any(axis=1)
            p, q, d = p[near], q[near], d[near]
            if most is None:
                yield from out(rep[p], rep[q], d)
            elif len(p):
                found = rep[p], rep[q], d, root[p], root[q]
                best = closest(*found) if best is None else closest(*(np.concatenate(v) for v in zip(best, found, strict=True)))
        if best is not None:
            yield from out(*best[:3])

    group, rows = None, []
    for batch in batches:
        key, left, right, block, rep, root, n = (batch.column(c).to_pylist() for c in columns)
        lanes, bands = batch.column("sketch").to_pylist(), batch.column("bands").to_pylist()
        for r in range(len(key)):
            if (key[r], left[r], right[r]) != group:
                yield from flush(rows)
                group, rows = (key[r], left[r], right[r]), []
            rows.append((left[r], right[r], block[r], rep[r], root[r], n[r], lanes[r], bands[r]))
    yield from flush(rows)


def _open_pairs(buckets: DataFrame, reps: DataFrame, roots: DataFrame, tested: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b): untested pairs of one bucket, in different components and within the sketch radius."""
    rows = buckets.select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "c")
    rows = rows.join(mixed, "key").join(reps.select("rep", "n", "sketch", "bands"), "rep")
    parts = F.ceil(F.col("c") / BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "rep", "root", "n", "sketch", "bands")
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    found = rows.mapInArrow(lambda batches: _close_pairs(batches, percent, most), "a long, b long, d long").select("a", "b").distinct()
    return found.join(tested, ["a", "b"], "left_anti")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketch table, and one row per distinct set: n, hi, lo, rep (its smallest doc_id), bands, sketch."""
    all_docs = stage(sketch(docs), "neardup-sketch")
    sets = all_docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "hi", "lo")
    return all_docs, stage(sets.agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "neardup-sets")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Needs doc_id and text."""
    all_docs, sets = classes(docs)
    reps = sets.select("rep", "n", "bands", "sketch")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    ends = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last")
    buckets = stage(keys.join(ends.select("key", "leader"), "key").select("key", "rep", "leader"), "neardup-buckets")
    one = reps.select(F.col("rep").alias("leader"), F.col("n").cast("double").alias("n1"), F.col("sketch").alias("s1"))
    two = reps.select("rep", F.col("n").cast("double").alias("n2"), F.col("sketch").alias("s2"))
    near = buckets.where("leader < rep").select("leader", "rep").distinct().join(one, "leader").join(two, "rep")
    near = near.select("leader", "rep", distance(F.col("s1"), F.col("s2")).alias("d"), radius(F.col("n1"), F.col("n2"), percent, F).alias("most")).where("d <= most")
    tested = stage(near.groupBy("rep").agg(F.min(F.struct("d", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("rep").alias("b")), "neardup-pairs")
    # the texts of classes that share a bucket: documents are shuffled once for all rounds
    some = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = stage(docs.select("doc_id", "text").join(some, "doc_id", "left_semi"), "neardup-texts")
    links = stage(confirm(tested, texts, percent), "neardup-links")
    roots = components(links)
    # first the closest pairs of each component in a bucket, then all that are not connected by then
    for most in (FIRST, None):
        now = stage(_open_pairs(buckets, reps, roots, tested, percent, most), "neardup-pairs")
        more = stage(confirm(now, texts, percent), "neardup-links")
        tested = tested.unionByName(now)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    named = sets.join(roots, F.col("rep") == F.col("node"), "left").select("n", "hi", "lo", F.coalesce("root", "rep").alias("root"))
    out = all_docs.select("doc_id", "n", "hi", "lo").join(named, ["n", "hi", "lo"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stand for their groups, with all their columns.

    Different texts under one doc_id are documents of their own; of rows with one doc_id and one text one stays.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1 AND doc_id IS NOT NULL")
    if again.isEmpty():
        gone = link(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = keyed(docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.struct(*names).alias("row")), ("row",))
    # further texts of a doc_id are linked under ids of their own, and the smallest (doc_id, part) of a group stays
    node = F.when(F.col("part") > 0, F.xxhash64("doc_id", "part")).otherwise(F.col("doc_id").cast("long"))
    one = stage(rows.groupBy("doc_id", "part").agg(F.first("row").alias("row")).withColumn("node", node), "neardup-rows")
    groups = link(one.select(F.col("node").alias("doc_id"), F.col("row").getField("text").alias("text")), percent).select(F.col("doc_id").alias("node"), "component_id")
    stay = groups.join(one.select("node", "doc_id", "part"), "node").groupBy("component_id").agg(F.min_by("node", F.struct("doc_id", "part")).alias("node"))
    out = one.join(stay.select("node"), "node", "left_semi").select("row.*")
    return out.unionByName(docs.where("doc_id IS NULL").select(*names))


def op8_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


QUERIES = {"op8_minhash_neardup": op8_minhash_neardup}
ORACLES: dict = {}
