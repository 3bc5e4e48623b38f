"""Quality rules, URL filter, toxicity, decontamination: SQL, brute force and held-out accuracy."""

import collections
import re
import zlib

import pytest
from messy import MESSY, awkward, frame
from oracle import connect, same

from quarrylight.llm import decontam, quality, toxicity, urls

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_quality_oracle(spark, con):
    same(spark, con, FOLDER, quality.op7_quality_rules, quality.ORACLE)


def test_url_oracle(spark, con):
    same(spark, con, FOLDER, urls.op5_url_filters, urls.ORACLES["op5_url_filters"])


def test_messy_quality(spark):
    got = collections.defaultdict(list)
    for r in quality.score(awkward(spark)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(MESSY)
    assert not got[2][0].kept and got[2][0].n_words == 0 and got[1][0].kept
    assert got[11][0].n_failed_lines == 2 and got[11][0].n_lost_words == 8 and not got[11][0].kept
    assert quality.score(frame(spark, [])).count() == 0
    out = quality.clean(awkward(spark))
    assert out.columns == awkward(spark).columns
    lines = ["Home > Science > Physics", "© 2024 Firma. Alle Rechte vorbehalten.", "Lire la suite.", "Haga clic aquí.", "a > b is a test."]
    one = quality.score(frame(spark, [(i, t) for i, t in enumerate(lines)])).orderBy("doc_id").collect()
    assert [r.n_failed_lines for r in one] == [1, 1, 1, 1, 0]
    prose = "First line of good prose ends here, as it should.\nSecond one too, with several more words in it.\nA third one follows the other two before the end."
    kept = quality.clean(frame(spark, [(1, prose + "\nA | b | c | d"), (2, prose + "\n" + prose), (3, prose)])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, prose), (3, prose)]  # 2 repeats itself


def test_menus_and_accents(spark):
    menu = "Home\nNews\n\nSports\nLog in\nAbout"
    prose = "The first line of prose is long enough to stay here.\nSo is the second one, which ends as it should too.\nAnd a third one comes after both of them, at last."
    texts = [menu, f"{menu}\n{prose}", f"Home\nNews\n{prose}", f"Home\nNews\nIt ends.\nSports\n{prose}", "一行目の文章はここにあります\n二行目の文章もここにあります\n三行目の文章もここにあります", f"TÉRMINOS DE USO of it.\nPOLÍTICA de privacidad.\nDATENSCHUTZERKLÄRUNG.\n{prose}", "Home\nNews", "Sports\nLogin"]
    got = {r.doc_id: r for r in quality.score(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_failed_lines for i in range(8)] == [5, 5, 0, 0, 0, 3, 0, 0]
    assert [got[i].kept for i in (1, 2, 3)] == [True, True, True]
    assert [r.text.replace("\n\n", "\n").strip() for r in quality.clean(frame(spark, [(1, texts[1])])).collect()] == [prose]
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(8), "text": texts})  # noqa: F841
    want = duckdb.sql(f"SELECT doc_id, n_failed_lines, n_lost_words, kept FROM ({quality.ORACLE})").fetchall()
    assert sorted(want) == [(i, got[i].n_failed_lines, got[i].n_lost_words, got[i].kept) for i in range(8)]


def test_urls(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "http://X.Example.ORG/es/1": ("x.example.org", "/es/1", "example.org/es/"), "http://example.org/en/12?x#y": ("example.org", "/en/12", "example.org/en/1"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/"), "https://a.com/de/#x": ("a.com", "/de/", "com/de/"), "ftp://h?q=/": ("h", "", None), "http://É.com/fr/é": ("É.com", "/fr/é", "com/fr/"), "http://": ("", "", None),
    }
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want and got[i].verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://a.net/" + "x" * 50_000)], "page_id long, url string")
    assert urls.judge(long).first().verdict in ("allow", "block")


def test_url_model_on_held_out_rows(spark):
    seen, rows = {urls._parts(u)[0] for u, _ in urls.labelled()}, urls.labelled("test")
    assert not seen & {urls._parts(u)[0] for u, _ in rows} and len(rows) == 30
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(df, rules=()).collect()}
    assert sum((got[i] == "block") == bool(y) for i, (_, y) in enumerate(rows)) >= 27


def test_url_tables_with_clashing_names(spark):
    rows = [(1, "http://a.example.org/es/", "x", 1.0, "y"), (1, "http://a.example.org/es/", "x", 1.0, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, path string, score double, verdict string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule) for r in urls.judge(df).collect()))
    assert got == [(0, "", "", None)] + [(1, "a.example.org", "/es/", "example.org/es/")] * 2


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_folding():
    assert toxicity.fold("1d10t! ІDІOТ st​upid 2024 ca$h") == " idiot idiot stupid 2024 cash "
    lex = toxicity.Lexicon({" idiot ": 5.0, " clow": 4.0}, ("clown fish",), (-4.0, 3.0, 1.0))
    assert lex.score(toxicity.fold("you 1d1ot")) > lex.score(toxicity.fold("a clown fish here")) == lex.score(toxicity.fold(""))
    assert lex.matched(toxicity.fold("clown fish and clowns"))[:2] == (4.0, 1)


def matched_brute(lexicon, folded):
    """The same as Lexicon.matched, by trying every entry at every place."""
    spared = [(s, s + len(p) + 1) for p in lexicon.exceptions for s in range(len(folded)) if folded.startswith(f" {p} ", s)]
    best = {}
    for s in range(len(folded)):
        found = [w for e, w in lexicon.weights.items() if folded.startswith(e, s)]
        if found and not any(a <= s < b for a, b in spared):
            best[s] = max(found)
    return sum(best.values()), len(best), len(folded.split())


def test_toxicity_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lex = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    made = toxicity.Lexicon({" the ": 2.0, " th": 1.5, " der ": 1.0, " erin": 3.0, " an": 0.5}, ("the erin", "der"), (-3.0, 2.0, 1.0))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for n, (_, text) in enumerate(rows):
        folded = toxicity.fold(text or "")
        assert n > 60 or made.matched(folded) == pytest.approx(matched_brute(made, folded))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, FOLDER).collect()}
    assert len(got) == len(rows) and all(got[i].score == pytest.approx(lex.score(toxicity.fold(t or ""))) for i, t in rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_messy_toxicity(spark):
    lex = toxicity.Lexicon({" same ": 2.0}, (), (-4.0, 3.0, 1.0))
    rows = toxicity.score(awkward(spark), lex).collect()
    assert len(rows) == len(MESSY) and all(r.score is not None for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.fit(frame(spark, MESSY), empty)
    assert {r.predicted for r in toxicity.score(frame(spark, MESSY), none).collect()} == {0}


def leaks_brute(docs, items):
    tok = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = set()
    for d, text in docs:
        words = tok(text)
        for i, item in items:
            w = tok(item)
            k = min(5, len(w), len(words))
            if not w or not words or k < min(5, len(w)):
                continue
            c, g = collections.Counter(grams(w, k)), grams(words, k)
            span = min(len(w) - k + 1, len(g))
            for s in range(len(g) - span + 1):
                x = collections.Counter(g[s : s + span])
                low = sum((x & c).values())
                if 100 * low >= 75 * (sum(x.values()) + sum(c.values()) - low):
                    out.add((d, i))
    return out


def test_leaks(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    text = items[3][1]
    words = text.split()
    docs += [(9001, text.upper()), (9002, "Intro, " + text.replace(" ", ", ") + " and more."), (9003, " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])), (9004, " ".join(words[: len(words) // 3])), (9005, None), (9006, "ab cd")]
    items += [(900, None), (901, ""), (902, "ab cd"), (903, "!!")]
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs, items)
    for options in ({}, {"items": 5}):
        got = [(r.doc_id, r.item_id) for r in decontam.find(df, bench, **options).collect()]
        assert set(got) == want and len(got) == len(want)
    assert {(9001, 3), (9002, 3)} <= {(d, i) for d, i in want if d > 9000} or items[3][0] != 3
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_messy_leaks(spark):
    bench = spark.createDataFrame([(1, "the same line of ten words"), (None, "日本語 🙂")], "item_id long, text string")
    got = decontam.find(awkward(spark), bench).collect()
    assert sorted((r.doc_id or -1 for r in got if r.item_id == 1)) == [-1, 1, 3, 4, 4, 11]
    assert decontam.find(awkward(spark), bench.limit(0)).count() == 0
    assert decontam.find(frame(spark, []), bench).count() == 0
    assert decontam.clean(awkward(spark), bench).columns == awkward(spark).columns
