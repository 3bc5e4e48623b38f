"""Keyword executor, cursors, modes, facet maps and schemas on small tables, against what the contract says."""

import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions.scalar import fold, folded
from quarrylight.operators import documents, filters, inverted, paging, sinks


def test_fold_equals_the_driver_and_unicode(spark):
    words = ["Łódź", "Čeština ĄĘŚŻ", "İstanbul ğüş", "Ἀθῆναι", "ﬁn", "Straße ÆŒ", "été", "plain ASCII", "日本語", ""]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f")).collect()
    assert all(r.f == folded(r.w) for r in rows)
    for w in ("Čeština ĄĘŚŻ", "Ἀθῆναι", "été"):
        plain = "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
        assert folded(w) == plain
    assert folded("Straße ÆŒ") == "strasse aeoe"


DOCS = [
    (1, "Poverty rate in Kenya", "A survey of poverty.", ["Kenya", "poverty rate"]),
    (2, "Povrety rates", "poverty and the rate of growth in kenya", []),
    (3, "Health", "rate poverty kenya", ["nothing"]),
    (4, "Health and demography", None, ["kenya", "rate poverty"]),
    (5, None, None, None),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(DOCS, "sid int, title string, abstract string, all_text array<string>")
    root = str(tmp_path_factory.mktemp("index"))
    return inverted.Index(spark, root).add(df, "sid", {"title": F.col("title"), "abstract": F.col("abstract"), "*all_text": F.col("all_text")})


def scores(index, query, **options):
    return {r.key: r.score for r in index.lexical({"title": 40.0, "abstract": 10.0}, query, "all_text", **options).collect()}


def test_lexical_executor(index):
    assert set(scores(index, "poverty")) == {1, 2, 3, 4}  # all_text alone is enough
    assert set(scores(index, "povertyx")) == {1, 2, 3}  # one edit, no typos in all_text
    assert scores(index, "paverty") == {}  # the first two letters have to be alike
    assert set(scores(index, "poverty rate kenya")) >= {1, 2, 3, 4}
    assert set(scores(index, '"poverty rate"')) == {1} and scores(index, '"kenya rate"') == {}
    with_, without = scores(index, "poverty rate"), scores(index, "poverty rate", bonus=0.0)
    assert set(with_) == set(without) and with_[1] > without[1] and with_[4] == without[4]  # no bonus in all_text
    assert with_[3] > without[3]  # neighbours that changed places are two moves apart
    assert with_[2] > without[2]  # two words between


def test_quoted_phrases_score(index):
    alone, beside = scores(index, '"poverty rate"'), scores(index, '"poverty rate" kenya')
    assert alone[1] > 1 and beside[1] == pytest.approx(alone[1] + scores(index, "kenya")[1])
    assert set(scores(index, '"rate poverty"')) == {3, 4}  # 4 has it in an entry of all_text


def test_cursor():
    text_ = paging.encode_cursor("after", ["abc", None, 7], 40, 900)
    assert paging.decode_cursor(text_, ["str", "int", "id"]) == {"direction": "after", "values": ["abc", None, 7], "position": 40, "total": 900, "lower_bound": False}
    for values, kinds in ((["a"], ["int"]), ([True], ["int"]), ([0], ["id"]), ([2**31], ["id"]), ([2**64], ["int"]), ([None], ["id"]), ([1, 2], ["int"])):
        with pytest.raises(ValueError):
            paging.decode_cursor(paging.encode_cursor("after", values, 0), kinds)
    for bad in ("x" * 5000, "%%%", paging.encode_cursor("sideways", [1], 0)):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad, ["int"])
    with pytest.raises(ValueError):
        paging.encode_cursor("after", [float("nan")], 0)


def test_pages_sorts_and_modes():
    assert paging.envelope(41, 2, 20) == {"page": 2, "page_size": 20, "total": 41, "has_more": True, "total_pages": 3}
    assert paging.envelope(0, 1, 20)["total_pages"] == 1
    for offset, limit in ((0, 101), (9_950, 100), (-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            paging.check_window(offset, limit)
    assert paging.adjusted_sort(None, "x") == ("relevance", []) and paging.adjusted_sort("relevance", None) == ("title", ["sort_adjusted"])
    with pytest.raises(ValueError):
        paging.adjusted_sort("relevance", "", strict=True)
    every = {"hybrid", "lexical", "semantic"}
    assert [paging.resolve_mode("auto", q, every)[0] for q in (None, '"a b"', "a")] == ["browse", "lexical", "hybrid"]
    assert paging.resolve_mode("auto", "a", every, False) == ("lexical", ["semantic_unavailable"])
    for args in (("hybrid", "a", every, False), ("semantic", "a", {"lexical"}), ("auto", "a", set())):
        with pytest.raises(ValueError):
            paging.resolve_mode(*args)
    assert paging.truncated("lexical", 10_001) and not paging.truncated("browse", 10_001)


def test_registry_and_schemas():
    assert sinks.register({"a", "b"}, {"c"}, add={"c"}, remove={"a"}) == (["b", "c"], ["a"])
    assert filters.resolve_facets(None, ["b", "a"], ["z"]) == (["a", "b"], ["z"]) and filters.resolve_facets(["a", "z", "q"], ["b", "a"], ["z"]) == (["a"], ["z"])
    live = T.StructType([T.StructField("a", T.StringType()), T.StructField("m", T.StructType([T.StructField("x", T.LongType())]))])
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("m", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])), T.StructField("n", T.StringType())])
    assert sinks.outdated_fields(live, want) == ["a", "m.y", "n"] and sinks.outdated_fields(live, live) == []


def test_count_and_date_filters(spark):
    df = spark.range(5)
    assert [df.where(filters.count_test(t, F.col("id"))).count() for t in (">2", "<2", "=3", "4")] == [2, 2, 1, 1]
    for bad in ("", ">x", "~3"):
        with pytest.raises(ValueError):
            filters.count_test(bad, F.col("id"))
    with pytest.raises(ValueError):
        filters.date_test("2020/02/01-2020/01/01", F.col("id"))


def test_guard_and_chunk_ids(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    with pytest.raises(ValueError):
        sinks.guard_dimensions(df, 2)
    sinks.guard_dimensions(df.limit(1), 2)
    ids = spark.range(1).select(*(documents.chunk_id(F.lit("a"), F.lit("b"), F.lit(x), F.lit(y)).alias(n) for n, x, y in (("one", "c", "d"), ("two", "cd", ""), ("three", "c", "d")))).first()
    assert ids.one == ids.three != ids.two
