"""The stored index against plain Python over the same texts."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import inverted, text
from quarrylight.sources.commits import Commits, Taken

WORDS = ["poverty", "povertx", "property", "rate", "rates", "of", "the", "kenya", "education", "educatoin", "edukasion", "x" * 60]
RANDOM = random.Random(3)
TEXTS = {i: " ".join(RANDOM.choices(WORDS, k=RANDOM.randrange(1, 60))) for i in range(300)} | {300: "", 301: None, 302: "…", 303: "rate " * 400, 304: "rate of rate the of"}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "k long, t string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return inverted.Index(spark, str(tmp_path_factory.mktemp("index"))).add(frame(spark, TEXTS), "k", {"t": F.col("t")})


def split(texts):
    return {k: t.split() for k, t in texts.items() if t and t != "…"}


def bm25(tf, dl, n, df, avg):
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))


def plain_scores(texts, words):
    docs = split(texts)
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in d for d in docs.values()) for w in words}
    return {k: s for k, d in docs.items() if (s := sum(bm25(d.count(w), len(d), n, df[w], avg) for w in words if w in d))}


def found(rows):
    return {r.key: r.score for r in rows.collect()}


def test_scores(spark, index):
    words = ["rate", "kenya", "absent"]
    assert found(index.scores(words, ["t"])) == pytest.approx(plain_scores(TEXTS, words))
    assert found(index.scores(["absent"], ["t"])) == {}
    empty = inverted.Index(spark, index.root + "-empty").add(frame(spark, TEXTS).limit(0), "k", {"t": F.col("t")})
    assert found(empty.scores(words, ["t"])) == {} and found(empty.phrase(["rate", "of"], ["t"], 2)) == {} and empty.top(words, "t", 5).count() == 0


def test_forms(index):
    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    asked = ["poverty", "ratex", "of", "education", "educationz", "x" * 59, "x" * 62]
    want = {(q, w) for q in asked for w in WORDS if w[:2] == q[:2] and levenshtein(q, w) <= text.edits(q)}
    assert {(r.query_term, r.term) for r in index.forms(asked).collect()} == want and ("educationz", "education") in want


def plain_phrase(texts, words, slop):
    """From the definition: every choice of distinct tokens."""
    docs = split(texts)
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    idf = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in (sum(w in x for x in docs.values()) for w in words))
    out = {}
    for k, d in docs.items():
        places = [[i for i, x in enumerate(d) if x == w] for w in words]
        freq = 0.0
        for first in places[0]:
            near = [[p for p in ps if abs(p - j - first) <= slop] for j, ps in enumerate(places)]
            spreads = []
            for choice in product([first], *near[1:]):
                if len(set(choice)) == len(choice):
                    at = [p - j for j, p in enumerate(choice)]
                    spreads.append(max(at) - min(at))
            if spreads and min(spreads) <= slop:
                freq += 1 / (1 + min(spreads))
        if freq:
            out[k] = idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * len(d) / avg))
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
@pytest.mark.parametrize("words", [["rate", "of"], ["of", "rate"], ["rate", "rate"], ["rate", "of", "rate"], ["the", "kenya", "of"], ["of"], ["rate", "absent"]])
def test_phrases(index, words, slop):
    assert found(index.phrase(words, ["t"], slop)) == pytest.approx(plain_phrase(TEXTS, words, slop))


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_top_reads_what_can_reach_it(spark, tmp_path, k):
    many = {i: ("rate " * (1 + i % 7) + "kenya " * (i % 3 == 0) + "of " * (i % 50)).strip() for i in range(3000)}
    index = inverted.Index(spark, str(tmp_path)).add(frame(spark, many), "k", {"t": F.col("t")})
    best = sorted(((-round(s, 9), i) for i, s in plain_scores(many, ["rate", "kenya"]).items()))[:k]
    assert [(-round(r.score, 9), r.key) for r in index.top(["rate", "kenya"], "t", k).collect()] == best
    if k == 1:
        bounds = index.bounds(["rate", "kenya"], "t")
        reached = index._reached(["rate", "kenya"], "t", k, bounds)
        able = index._rows(index.state["segments"][0], ["rate", "kenya"], ["t"])
        assert 0 < able.where(index._able("t", bounds, reached)).count() < able.count()


def test_segments(spark, tmp_path):
    now = dict(TEXTS)
    index = inverted.Index(spark, str(tmp_path)).add(frame(spark, TEXTS), "k", {"t": F.col("t")})
    for changed, gone in (({5: "kenya rate", 400: "rate of kenya"}, [7, 8, 9999]), ({5: "nothing", 7: "rate"}, []), ({401: None}, [400])):
        now = {k: t for k, t in now.items() if k not in gone} | changed
        index = index.add(frame(spark, changed), "k", {"t": F.col("t")}, spark.createDataFrame([(g,) for g in gone], "key long"))
    for x in (index, index.merge()):
        assert found(x.scores(["rate", "kenya"], ["t"])) == pytest.approx(plain_scores(now, ["rate", "kenya"]))
        assert found(x.phrase(["rate", "of"], ["t"], 2)) == pytest.approx(plain_phrase(now, ["rate", "of"], 2))
    assert len(inverted.Index(spark, str(tmp_path)).state["segments"]) == 1


def test_one_of_two_writers_commits(spark, tmp_path):
    a, b = Commits(spark, str(tmp_path)), Commits(spark, str(tmp_path))
    assert a.read() is None
    a.commit(1, {"n": 1})
    with pytest.raises(Taken):
        b.commit(1, {"n": 2})
    b.commit(2, {"n": 3})
    assert a.read() == (2, {"n": 3}) and a.read(1) == (1, {"n": 1}) and a.versions() == [1, 2]


def test_stored_follows_its_files(spark, tmp_path):
    table, folder = str(tmp_path / "t"), str(tmp_path / "i")
    frame(spark, {1: "rate", 2: "kenya"}).write.parquet(table)
    first = inverted.stored(spark.read.parquet(table), "k", {"t": F.lower("t")}, folder)
    assert inverted.stored(spark.read.parquet(table), "k", {"t": F.lower("t")}, folder).root == first.root
    assert inverted.stored(spark.read.parquet(table), "k", {"t": F.upper("t")}, folder).root != first.root
    frame(spark, {3: "rate"}).write.mode("append").parquet(table)
    assert set(found(inverted.stored(spark.read.parquet(table), "k", {"t": F.lower("t")}, folder).scores(["rate"], ["t"]))) == {1, 3}


def test_a_dictionary_has_one_row_for_each_term(spark, tmp_path):
    """Forms are found in the sorted dictionary; nothing is stored for each term's misspellings."""
    import os

    df = spark.createDataFrame([(i, f"education{i} term{i * 7} same") for i in range(50)], "sid long, text string")
    built = inverted.Index(spark, str(tmp_path)).add(df, "sid", {"text": F.col("text")})
    folder = built.state["segments"][0]["path"]
    assert set(os.listdir(folder)) == {"postings", "files", "docs", "terms"}
    stored = spark.read.parquet(f"{folder}/terms")
    assert stored.count() == stored.select("term").distinct().count() == 101
    assert {r.term for r in built.forms(["educatione"]).collect()} == {f"education{i}" for i in range(50)}


def test_a_word_of_a_slice_is_one_row_until_it_is_dealt(spark, tmp_path):
    many = {i: f"same word{i % 10} once{i}" for i in range(600)}
    index = inverted.Index(spark, str(tmp_path))
    index.log.delete = lambda path: None  # so that what was dealt is left to count
    index = index.add(frame(spark, many).coalesce(1), "k", {"t": F.col("t")})
    dealt = spark.read.parquet(f"{index.state['segments'][0]['path']}/single").where("term IN ('same', 'word3')")
    assert dealt.count() <= 5 + 1 + 2 * 2  # 660 postings; a batch may end within a block
    assert index._postings(["same"]).count() == 600 and found(index.scores(["word3"], ["t"])) == pytest.approx(plain_scores(many, ["word3"]))


def test_slices_of_mixed_keys_give_blocks_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(inverted, "SLICE", 900)
    keys = list(range(400))
    RANDOM.shuffle(keys)
    texts = {k: " ".join(RANDOM.choices(["a", "b", "c"], k=k % 9)) for k in keys}
    lists = {k: ["a b", "", " b "] if k % 2 else [] for k in keys}
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([f" {texts[k]} " for k in keys]), pa.array([lists[k] for k in keys], pa.list_(pa.string()))], names=["key", "_f0", "_f1"])
    parts = [r for out in inverted._parts(["t", "l"])([batch.slice(0, 0), batch]) for r in out.to_pylist()]
    assert sum(r["term"] == "a" and r["field"] == "t" for r in parts) > 4
    lengths = {(k, r["field"]): dl for r in parts if r["term"] is None and r["field"] for k, dl in zip(r["keys"], r["dls"], strict=True)}
    assert lengths == {(k, "t"): len(t.split()) for k, t in texts.items() if t} | {(k, "l"): 3 for k in keys if lists[k]}
    assert {k for r in parts if r["field"] is None for k in r["keys"]} == {k for k in keys if not texts[k] and not lists[k]}
    rows = sorted((r for r in parts if r["term"]), key=lambda r: (r["term"], r["field"], r["lo"]))
    held = {}
    schema = pa.schema([("term", pa.string()), ("field", pa.string()), ("lo", pa.int64()), ("keys", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("dls", "tfs", "positions"))])
    for block in (r for out in inverted._blocks([pa.RecordBatch.from_pylist(rows, schema)]) for r in out.to_pylist()):
        assert len(block["keys"]) == block["n"] <= inverted.BLOCK and block["keys"] == sorted(block["keys"]) and (block["lo"], block["hi"]) == (block["keys"][0], block["keys"][-1])
        assert (block["max_tf"], block["min_dl"]) == (max(block["tfs"]), min(block["dls"]))
        for k, tf, at, dl in zip(block["keys"], block["tfs"], block["starts"], block["dls"], strict=True):
            assert dl == lengths[k, block["field"]]
            held[block["term"], block["field"], k] = block["positions"][at : at + tf]
    want = {(w, "t", k): [i for i, x in enumerate(t.split()) if x == w] for k, t in texts.items() for w in set(t.split())}
    gap = inverted.GAP  # two entries lie between the two that have b
    assert held == want | {("a", "l", k): [0] for k in keys if k % 2} | {("b", "l", k): [1, 2 + 2 * gap] for k in keys if k % 2}


def test_words_and_documents_are_not_rows_while_they_are_dealt(spark, tmp_path):
    many = {i: f"same word{i % 10} once{i}" for i in range(3000)}
    index = inverted.Index(spark, str(tmp_path))
    index.log.delete = lambda path: None  # so that what was dealt is left to count
    index = index.add(frame(spark, many).coalesce(1), "k", {"t": F.col("t")})
    assert spark.read.parquet(f"{index.state['segments'][0]['path']}/single").count() <= 8  # 3,011 words
    assert found(index.scores(["word3", "once7"], ["t"])) == pytest.approx(plain_scores(many, ["word3", "once7"]))


ODD = ["ΟΔΟΣ ΟΔΟΣ.α Σ σας", "İstanbul ISTANBUL ıI", "e\u0301te\u0301 \u0301 a\u0301", "x´y ¨ a¯b", "Straße ÆON œuvre ﬁn", "it’s “so”\u00a0ok\u2003em…end", "東京、大阪 ＡＢ１", "𝐀𝐁 𐐀 😀a😀", "½ ² x² ª", "a_b-c'd\te\nf\x00g", "", "…", "Кириллица ЁЖ", "ａ" * 40, "naïve NAÏVE naive"]


def test_tokens_of_bytes_are_those_of_spark(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 2)], "k int, t string").coalesce(1)
    low = F.when(F.contains("t", F.lit("Σ")), F.lower("t")).otherwise(F.col("t"))
    rows = sorted(df.select("k", low.alias("t"), F.filter(F.split(inverted._spaced(F.col("t")), " "), lambda x: x != "").alias("w")).collect())
    terms, code, text = inverted._tokens(pa.array(["skipped", *(r.t for r in rows)]).slice(1), inverted.letters(spark))
    terms = terms.to_pylist()
    assert terms == sorted(set(terms), key=str.encode)
    got = {r.k: [] for r in rows}
    for c, at in zip(code, text, strict=True):
        got[at].append(terms[c])
    assert got == {r.k: r.w for r in rows} and got[0][:2] == ["οδος", "οδοσ"] and got[2] == ["ete", "a"]


def test_packs_of_a_range_are_merged_in_order_whatever_they_hold(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(inverted, "SLICE", 2000)
    monkeypatch.setattr(inverted, "PACK", 3000)
    texts = {k: " ".join(RANDOM.choices(["hot"] * 20 + [f"w{i}" for i in range(60)], k=k % 23)) for k in range(900)}
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["key", "_f0"])
    packs = [r for out in inverted._packed(inverted._parts(["t"])([batch])) for r in out.to_pylist()]
    rows = sorted((r for r in packs if r["term"]), key=lambda r: (r["term"], r["lo"]))
    assert sum(r["term"] == "hot" for r in rows) > 3
    schema = pa.schema([("term", pa.string()), ("lo", pa.int64()), ("body", pa.binary())])
    for most in (1, 20_000, 1 << 30):  # the first one lets everything go at once
        monkeypatch.setattr(inverted, "MERGED", most)
        blocks = list(inverted._merged([pa.RecordBatch.from_pylist(rows[:7], schema), pa.RecordBatch.from_pylist(rows[7:], schema)]))
        held = {(r["term"], r["key"]): r["positions"] for out in inverted._postings_of(True)(blocks) for r in out.to_pylist()}
        assert held == {(w, k): [i for i, x in enumerate(t.split()) if x == w] for k, t in texts.items() for w in set(t.split())}
    count = {w: sum(w in t.split() for t in texts.values()) for w in {w for t in texts.values() for w in t.split()}}
    assert sum(b.num_rows for b in blocks) == sum(-(-n // inverted.BLOCK) for n in count.values())
