"""Near-duplicates against brute force, components against union-find."""

import random
import re

import numpy as np
from messy import MESSY, awkward, frame

from quarrylight.llm import graph, neardup


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(6, 150))]
        for _ in range(rng.randrange(1, 9)):
            x = list(base)
            for _ in range(rng.randrange(0, 5)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(9999)}"
            out.append((len(out) * 2, " ".join(x).title() if rng.random() < 0.3 else "  ".join(x)))
    return out + [(901, "one two"), (902, "One  two"), (903, "two one"), (904, None), (905, "")]


def test_links(spark):
    rows = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_links_in_small_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FAN", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FIRST", 1)
    monkeypatch.setattr(graph, "AT_ONCE", 0)
    rows = copies(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_components_by_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.root for r in graph.components(df, 0).collect()}
    two = {r.node: r.root for r in graph.components(df).collect()}
    assert one == two and one[40] == 0 and 0 not in one
    assert graph.components(df.limit(0), 0).count() == 0


def test_sketch_radius_keeps_similar_sets():
    rng = np.random.default_rng(4)
    for n in (8, 100, 900, 3000, 20_000):
        worst = 0
        for _ in range(30):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            k = max(1, n // 6)
            a = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, k, dtype=np.uint64))))
            b = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, k, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            d = int(np.bitwise_count(neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).sum())
            worst = max(worst, d / neardup.radius(float(len(a)), float(len(b))))
        assert worst <= 1


def test_messy(spark):
    got = {}
    for r in neardup.link(awkward(spark)).collect():
        got.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert sum(map(len, got.values())) == len(MESSY)
    assert got[1] == [(1, True)] and got[4] == [(1, False)] * 2 and got[8] == [(7, False)]
    assert got[None] == [(None, True)] * 2 and got[2] == [(2, True)] and got[5] == [(5, True)]
    assert neardup.link(frame(spark, [])).count() == 0


def test_keep_one(spark):
    df = awkward(spark)
    out = neardup.keep_one(df)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert out.columns == df.columns and ids.count(4) == 0 and ids.count(1) == 1 and ids.count(None) == 2 and 8 not in ids


def test_keep_one_of_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (3, text("a")), (3, text("b")), (3, text("c")), (3, text("c")), (5, text("d")), (5, text("d") + " x"), (6, text("b")), (7, ""), (7, text("e")), (-2, text("e")), (None, text("a"))]
    got = [tuple(r) for r in neardup.keep_one(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and {r for r in got if r[0] != 5} == {(i, text(k)) for i, k in ((1, "a"), (3, "b"), (3, "c"), (-2, "e"), (None, "a"))} | {(7, "")}
    assert sum(r[0] == 5 for r in got) == 1
    texts = [r.text for r in neardup.keep_one(awkward(spark)).where("doc_id = 3").collect()]
    assert texts == [t for i, t in MESSY if i == 3][1:]
