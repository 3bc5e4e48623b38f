"""Substring dedup of passages and of byte strings, against brute force."""

import hashlib
import random
import re
from dataclasses import replace

import pytest
from messy import MESSY, awkward, frame

from quarrylight.llm import passages, suffix, windows


def passages_brute(rows, window):
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_brute(rows, window):
    """Rows in order of doc_id; equal rows are one document."""
    seen, out, done = {}, [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        x = (t or "").encode()
        gone = bytearray(len(x))
        if i is not None and (i, x) not in done:
            for k in range(len(x) - window + 1):
                s = x[k : k + window]
                if seen.setdefault(s, (i, k)) != (i, k):
                    gone[k : k + window] = b"\1" * window
            done[i, x] = gone
        gone = done.get((i, x), gone)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "efg", "hä", "x,", "yz\n"]) + str(rng.randrange(40))
    base = [[word() for _ in range(rng.randrange(5, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            x = list(rng.choice(base))
            a = rng.randrange(len(x))
            x = x[a : a + rng.randrange(1, 90)]
            if rng.random() < 0.5 and x:
                x[rng.randrange(len(x))] = word()
            parts += x
        rows.append((i * 3, rng.choice([" ", "  ", "\t"]).join(parts)))
    return rows + [(500, "a b " * 300), (501, "a b " * 200 + "c"), (502, "q" * 5000), (503, "q" * 3000 + "r" + "q" * 900)]


@pytest.mark.parametrize("options", [{}, {"hot": 2, "local": 1}, {"shard": 300}, {"most": 2}, {"hot": 5, "local": 3, "most": 4}])
def test_passages(spark, options):
    rows = corpus()
    got = sorted((tuple(r) for r in passages.digest(frame(spark, rows), 12, anchor=5, tile=6, **options).collect()), key=str)
    assert got == passages_brute(rows, 12)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "local": 1}, {"shard": 200, "piece": 700}, {"most": 2, "piece": 700}, {"hot": 5, "local": 3, "most": 4}])
def test_suffix(spark, options):
    rows = corpus(9)
    got = sorted((tuple(r) for r in suffix.digest(frame(spark, rows), 40, anchor=12, **options).collect()), key=str)
    assert got == suffix_brute(rows, 40)


def test_messy_passages(spark):
    got = sorted((tuple(r) for r in passages.digest(awkward(spark), 6, anchor=3, tile=3).collect()), key=str)
    assert got == passages_brute(MESSY, 6)


def test_messy_suffix(spark):
    got = {(r.doc_id, r.n_bytes) for r in suffix.digest(awkward(spark), 20, anchor=10).collect()}
    assert got == {(i, len((t or "").encode())) for i, t in MESSY}
    rows = [r for r in MESSY if r[0] != 3]
    got = sorted((tuple(r) for r in suffix.digest(frame(spark, rows), 20, anchor=10).collect()), key=str)
    assert got == suffix_brute(rows, 20)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "local": 1}, {"most": 2}])
def test_suffix_of_repeated_rows(spark, options):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    alone, shared, period = text(500), text(300), text(30) * 8
    texts = [(50, alone), (51, shared + text(90)), (52, text(80) + shared[:200] + text(90)), (53, period), (54, text(60) + period[:90] + text(60))]
    rows = [r for r in texts for _ in range(3)]
    got = sorted((tuple(r) for r in suffix.digest(frame(spark, rows).repartition(5), 40, anchor=12, **options).collect()), key=str)
    assert got == suffix_brute(rows, 40) and (50, 500, 0) in {r[:3] for r in got}


def test_empty_tables(spark):
    assert passages.digest(frame(spark, [])).count() == 0
    assert suffix.digest(frame(spark, [])).count() == 0
    assert passages.clean(awkward(spark).limit(0)).count() == 0


def test_clean_keeps_columns(spark):
    df = awkward(spark)
    out = passages.clean(df, 6, anchor=3, tile=3)
    assert out.columns == df.columns and out.count() == df.count()
    text = "one two three four five six seven"
    rows = passages.clean(frame(spark, [(1, text), (2, text + " eight"), (3, None)]), 6, anchor=3, tile=3).orderBy("doc_id").collect()
    assert [r.text for r in rows] == [text, "eight", None]


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        passages.repeats(frame(spark, []), window=10, anchor=10)
    with pytest.raises(ValueError):
        suffix.repeats(frame(spark, []), window=100, anchor=4)


FOLDER = "/root/testdata/sf0.001"


def table(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_query(spark):
    got = sorted((tuple(r) for r in passages.op1_substring_dedup(spark, FOLDER).collect()), key=str)
    assert got == passages_brute(table(spark), 50) and any(r[2] for r in got)


def test_op3_query(spark):
    got = sorted((tuple(r) for r in suffix.op3_suffix_dedup(spark, FOLDER).collect()), key=str)
    assert got == suffix_brute(table(spark), 100) and any(r[2] for r in got)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "local": 1}, {"most": 2}])
@pytest.mark.parametrize("find", [passages.finder(12, 5, 6), suffix.finder(40, 12)])
def test_nothing_is_removed_but_by_the_method(spark, find, options):
    docs = windows.keyed(frame(spark, corpus()))
    assert windows.runs_of(docs, find, "method", **options).count() > 10
    silent = replace(find, method=lambda texts, doc: [], resolver=lambda batches: iter(()))
    assert windows.runs_of(docs, silent, "method", **options).count() == 0


def test_hot_minimizers(spark):
    docs = windows.keyed(frame(spark, corpus()).repartition(3))
    assert len(windows.hot_minimizers(docs, passages.finder(12, 5, 6), 2, 1)) > 0
    assert len(windows.hot_minimizers(docs, passages.finder(12, 5, 6), 2, 1, keys=3)) == 3


@pytest.mark.parametrize("find", [passages.finder(12, 5, 6), suffix.finder(40, 12, piece=700)])
def test_no_task_holds_more_than_most_segments_of_a_minimizer(spark, find):
    from pyspark.sql import functions as F

    docs = windows.keyed(frame(spark, corpus()).repartition(6))
    cut = windows.stage(windows.segments(docs, find, windows.hot_minimizers(docs, find, keys=1)), "cut")
    sizes = {r.m: r.c for r in cut.where("state % 2 = 0").groupBy("m").agg(F.count("*").alias("c")).collect()}
    assert max(sizes.values()) > 3  # there is something to part
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a group goes on from batch to batch
    try:
        left = {r.m: r.c for r in windows.judged(cut, find.across, most=3).where("state % 2 = 0").groupBy("m").agg(F.count("*").alias("c")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(left[m] == c for m, c in sizes.items() if c > 5) and sum(left.values()) < sum(sizes.values())
    seen = []

    def spy(rows, docs, finder):
        seen.extend(r.c for r in rows.groupBy("m").agg(F.count("*").alias("c")).collect())
        return plain(rows, docs, finder)

    plain, windows.resolved = windows.resolved, spy
    try:
        assert windows.runs_of(docs, find, "bounded", most=3).count() > 10
    finally:
        windows.resolved = plain
    assert seen and max(seen) <= 3
