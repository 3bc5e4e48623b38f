"""Alignment of two tokenizers, chat formatting and clustering against plain versions of their definitions."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from messy import MESSY, awkward, frame

from quarrylight.llm import align, chat, lloyd

FOLDER = "/root/testdata/sf0.001"
ODD = ["a▁b c", " ▁", "\n\n a\t b\n \tc  d \r\n e  f g \x1c h\x1f\n", "   ", "\n", "\t", "x\t", "a\n", "</s><s>[INST]<|endoftext|> <unk> <0x0A>", "🙂👩‍👩‍👧 x" * 50, "' 's' ''S  'll\n'm", " " * 3000 + "\n" * 3000 + "=-" * 900, "的" * 3000]
DOCS = MESSY + [(100 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def encoder():
    return align.Encoder()


def plain(encoder, text):
    """(A's ids, B's ids, groups, bytes where groups begin) of the whole text at once; None if it has no tokens."""
    if not text:
        return None
    a, b = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
    ends = []
    for side, ids in enumerate((a, b)):
        data = [encoder.bytes[side][i] for i in ids]
        if b"".join(data) != (" " + text).encode():
            return None
        ends.append(np.cumsum([len(x) for x in data]).tolist())
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        for i, end in zip(ids, ends[side], strict=True):
            groups[bisect_left(cuts, end)][side].append(i)
    return a, b, groups, [0, *cuts[:-1]], ends


def expected(encoder, docs):
    """Rows of the digest, as a bag."""
    found = [(i, plain(encoder, t)) for i, t in docs]
    links = [Counter((x, y) for a, b in (f[2] if f else []) for x in a for y in b) for _, f in found]
    count = Counter(p for held in links for p in held)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, f), held in zip(found, links, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), sum(held.values()), sum(n for p, n in held.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in held.items()), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("block", "parts"), [(align.BLOCK, 1), (2000, 3)])
def test_alignment_of_messy_texts(spark, encoder, block, parts):
    got = align.digest(awkward(spark, DOCS).repartition(parts), block=block).collect()
    assert Counter(map(tuple, got)) == expected(encoder, DOCS)
    assert align.digest(frame(spark, [])).count() == 0


def test_texts_that_end_with_a_space(spark, encoder, monkeypatch):
    """SentencePiece puts no space before an empty string, so a part that is one space needs its own id."""
    docs = [(i, t) for i, t in enumerate(["x ", "a b. ", "a\tb\x0c ", "的 ", "two lines\nend \n ", "é🙂 "])]
    assert all(plain(encoder, t) for _, t in docs)
    assert Counter(map(tuple, align.digest(frame(spark, docs)).collect())) == expected(encoder, docs)
    monkeypatch.setattr(align, "SECTION", 3)
    assert all(len(align.Aligned(encoder, [s]).a) for _, t in docs for s in encoder.sections(t))


def test_stored_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    """A row is a block of documents: a row group passes its size by no more than one row."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(align, "GROUP", 1 << 15)
    docs = [(i, "".join(f" w{(i * 131 + j * j) % 9973}" for j in range(300))) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        stored = align._stored(frame(spark, docs).repartition(1), None, None, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stored.count() == 12 and stored.selectExpr("sum(size(doc_id))").first()[0] == 60
    groups = [g for f in stored.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert all(g.num_rows == 1 or g.total_byte_size < 4 << 15 for g in groups) and len(groups) > 3


def test_op11_query(spark, encoder):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, align.op11_tokenizer_alignment(spark, FOLDER).collect())) == expected(encoder, docs)


def test_sections_and_whole_texts_agree(encoder, monkeypatch):
    """Long texts go section by section, and a vocabulary whose tokens may cross parts is encoded whole."""
    names, whole = align._names(), align.Encoder(by_parts=False)
    for e, size in ((encoder, 40), (whole, 40), (whole, align.SECTION)):
        monkeypatch.setattr(align, "SECTION", size)
        for text in [t for _, t in DOCS if t]:
            block = align._Block(0)
            block.add(e, align.pa.array([1]), [" " + text], names)
            f = plain(encoder, text)
            got = [c[0] for c in block.columns[1:]]
            assert got[:3] == ([len(f[0]), len(f[1]), len(f[2])] if f else [0, 0, 0])
            held = Counter((x, y) for a, b in (f[2] if f else []) for x in a for y in b)
            (_, pair, links) = block.held[0]
            assert {(p >> 16, p & 0xFFFF): n for p, n in zip(pair.tolist(), links.tolist(), strict=True)} == held


def test_wide_groups_are_linked_in_slices(encoder, monkeypatch):
    text = "的" * 300 + " x" + "=-" * 200
    want = align.Aligned(encoder, [" " + text]).links()
    monkeypatch.setattr(align, "WIDE", 0)
    monkeypatch.setattr(align, "AT_ONCE", 3)
    for a, b in zip(align.Aligned(encoder, [" " + text]).links(), want, strict=True):
        assert a.tolist() == b.tolist()


def test_alignments(spark, encoder):
    rows = {r.doc_id: r for r in align.alignments(frame(spark, [(i, t) for i, (_, t) in enumerate(DOCS)])).collect()}
    for i, (_, text) in enumerate(DOCS):
        f, r = plain(encoder, text), rows[i]
        if f is None:
            assert (r.a_ids, r.b_ids, r.cuts, r.overlap_a) == ([], [], [], [])
            continue
        assert (r.a_ids, r.b_ids, r.cuts) == (f[0], f[1], f[3])
        owners = [np.searchsorted(np.array(e), np.arange(e[-1]), side="right") for e in f[4]]
        first = [k for k in range(len(owners[0])) if not k or owners[0][k] != owners[0][k - 1] or owners[1][k] != owners[1][k - 1]]
        assert r.overlap_at == first and r.overlap_a == owners[0][first].tolist() and r.overlap_b == owners[1][first].tolist()


def test_pair_counts(spark, encoder):
    docs = [(1, "a cat"), (2, "a cat"), (3, "a dog"), (3, "a dog"), (4, None)]
    groups = [f[2] for _, t in docs if (f := plain(encoder, t))]
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    rows = align.pair_counts(frame(spark, docs)).collect()
    assert {(r.a_id, r.b_id): r.docs for r in rows} == count
    assert all(r.best == (r.docs == max(n for (a, _), n in count.items() if a == r.a_id)) for r in rows)


# chat

TEXTS = ["</s>[INST] ok [/INST]", r"<\s> <\\/s> [\INST] <\|endoftext|>", "", None, "<|endoftext|><s><<s>>[[INST]]", "été 🙂 \x00 \\", "<", "/s>", " lead and trail ", "x " * 5000]
TALKS = [(c, t, r, TEXTS[(c + t) % len(TEXTS)]) for c in range(12) for t in range(c) for r in [("user", "assistant", "system", None, "<s>")[t % 5]]]
TALKS += [(None, 1, "assistant", "none"), (None, 0, "user", "q"), (20, None, "assistant", "z"), (20, None, "assistant", "z"), (20, 3, "user", "a"), (20, 3, "assistant", "b")]


def turns_of(rows):
    """Conversations with their turns in order: by turn, role and text, nulls first."""
    low = lambda x: (x is not None, x if x is not None else "")
    out = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3]))):
        out[conv].append((role or "", text or ""))
    return out


def talk_digests(rows):
    template, out = chat.Template(), {}
    for conv, turns in turns_of(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        chars = sum(len("<s>[INST][/INST]</s>") + len(template.escape(r)) + len(template.escape(t)) for r, t in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    return out


def talks(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' AS ids", "1 AS segment", "true AS whole", "'y' AS formatted")


@pytest.mark.parametrize("segment", [chat.SEGMENT, 0, 50])
def test_conversations_are_read_back(spark, segment):
    table = chat.formatted(talks(spark, TALKS).repartition(3), segment=segment)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(table).collect()}
    assert got == talk_digests(TALKS)
    if segment == 0:
        assert table.count() == len(TALKS)  # a segment for each turn


def test_conversation_of_most_rows(spark):
    """One conversation over many tasks: no task has all of it but for its digest."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(6000)] + [(c, 0, "user", "a") for c in range(2, 50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = chat.formatted(talks(spark, rows).repartition(4), segment=10_000).cache()
        most = table.where("conv_id = 1").selectExpr("segment >> 32 AS task", "n_turns").groupBy("task").sum("n_turns").collect()
        assert len(most) > 1 and max(r[1] for r in most) < 5000
        assert {r.conv_id: tuple(r)[1:] for r in chat.digests(table).collect()} == talk_digests(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_masks_and_text(spark):
    row = chat.formatted(talks(spark, [(1, 0, "user", "héllo <s>"), (1, 1, "assistant", "[INST] yes 🙂 ")])).first()
    assert row.formatted == "<s>[INST]user[/INST]héllo <\\s></s><s>[INST]assistant[/INST][\\INST] yes 🙂 </s>"
    encoder = chat.Encoder(chat.Template())
    assert b"".join(encoder.bytes[i] for i in row.ids).decode() == row.formatted
    assert b"".join(encoder.bytes[i] for i, m in zip(row.ids, row.learnt, strict=True) if m).decode() == "[\\INST] yes 🙂 "
    assert sum(row.ids.count(m) for m in encoder.marks) == 8


def test_escapes():
    t = chat.Template()
    forms = [x for a in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>") for n in range(4) for x in [a[0] + "\\" * n + a[1:]]]
    assert len({t.escape(f) for f in forms}) == len(forms)
    for f in forms + [f + g for f in forms for g in forms] + ["<" + f for f in forms]:
        assert t.unescape(t.escape(f)) == f and not any(c in t.escape(f) for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template(begin="[[x")


def test_no_conversations(spark):
    assert chat.digests(chat.formatted(talks(spark, TALKS[:1]).limit(0))).count() == 0


def sql_rows(tables, sql):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize(("module", "table"), [(chat, "conversations"), (lloyd, "embeddings")])
def test_queries_equal_sql(spark, module, table):
    (name, query), = module.QUERIES.items()
    columns, rows = sql_rows([table], module.ORACLES[name])
    assert sorted(map(tuple, query(spark, FOLDER).select(*columns).collect())) == sorted(rows)


# clustering


def plain_lloyd(rows, k, rounds, dims, scale=256.0):
    """Every vector with every centroid, in Python's whole numbers."""
    kept = [(i, [int(np.floor(scale * x)) for x in map(float, v)]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        owner = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], c


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, owner int, distance string")


def check(spark, rows, k, rounds, dims):
    want, c = plain_lloyd(rows, k, rounds, dims)
    got = lloyd.assignments(vectors(spark, rows).repartition(3), k, rounds, dims).collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter(want)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, o, d in want if o == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_lloyd(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 4))
    rows = [(i, (middle[i % 6] + rng.normal(size=4) * 0.3).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(200)]  # copies, and ties
    rows += [(7, [0.0] * 4), (7, [1.0] * 4), (None, [2.0] * 4), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("-inf")] * 4)]
    check(spark, rows, 8, 5, 4)
    check(spark, rows, 1, 0, 4)


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    check(spark, [(i, [float(i), -1.5]) for i in range(n)] + [(0, [0.0, -1.5])], 5, 3, 2)


def test_large_components(spark):
    """Beyond what doubles hold exactly, whole numbers are compared; beyond 64 bits the query says so."""
    check(spark, [(i, [float(i * 7919 % 101) * 5000 + i * 2**-8, -3.0e5 + i]) for i in range(60)], 4, 3, 2)
    with pytest.raises(Exception, match="too large"):
        lloyd.assignments(vectors(spark, [(1, [1e30, 0.0])]), 2, 1, 2).collect()


def test_no_vectors(spark):
    assert lloyd.assignments(vectors(spark, [(1, None)])).count() == 0 and lloyd.assignments(vectors(spark, [(1, None)]).limit(0)).count() == 0


def test_deltas_compare_what_may_change():
    """`nearest` gives what a full comparison gives, whichever centroids moved."""
    rng = np.random.default_rng(1)
    x, c = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (12, 3))
    owner, distance = lloyd.nearest(x, c, np.ones(12, bool), np.full(500, -1), np.zeros(500, np.int64))
    for _ in range(20):
        new = c.copy()
        some = rng.integers(0, 12, 3)
        new[some] = rng.integers(-9, 9, (3, 3))
        owner, distance = lloyd.nearest(x, new, (new != c).any(1), owner, distance)
        c = new
        full = lloyd.squared(x, c)
        assert (owner == full.argmin(1)).all() and (distance == full.min(1)).all()
