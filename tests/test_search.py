"""Search operators on small rows: keyset walks, fusion order, phrases, facets, upserts."""

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import ingest as I
from quarrylight.operators import search as Q
from quarrylight.operators import text as T
from quarrylight.operators import vectors as N
from quarrylight.sources import views as V

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("by", list(Q.SORTS))
@pytest.mark.parametrize("ascending", [True, False])
def test_keyset_walk_both_ways(spark, by, ascending):
    df = Q.with_sort_columns(V.studies(spark, FOLDER)).where("sid <= 60").withColumn("score", F.when(F.col("sid") % 9 != 0, F.col("sid") % 7 * 0.5)).cache()
    keys = Q.sort_keys(by, ascending)
    want = [r.sid for r in df.orderBy(*Q.ordering(keys)).select("sid").collect()]
    got, at = [], None
    while True:
        rows = Q.page(df, keys, 25, at).collect()
        got += [r.sid for r in rows]
        if len(rows) < 25:
            break
        at = [rows[-1][c] for c, _ in keys]
    assert got == want
    first = df.where(F.col("sid") == want[30]).first()
    back = [r.sid for r in Q.page(df, keys, 10, [first[c] for c, _ in keys], before=True).collect()]
    assert back == want[20:30]


def test_fusion_order(spark):
    ranked = lambda ids: spark.createDataFrame([(s, i + 1) for i, s in enumerate(ids)], "sid int, pos int")
    got = N.rrf([ranked([1, 2, 5]), ranked([3, 2, 7])], "sid").orderBy("pos").collect()
    assert [r.sid for r in got] == [2, 1, 3, 5, 7] and got[0].matched_by == [0, 1]
    tail = N.head_and_tail(ranked([2, 1]), ranked([1, 2, 9]), "sid").orderBy("block", "pos").collect()
    assert [r.sid for r in tail] == [2, 1, 9]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "k int, embedding array<float>")
    v = N.fuse(df, "k").first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-12
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 0.0])], "k int, embedding array<float>")
    assert abs(N.fuse(df, "k", "max").first().embedding[0] - 3 / 13**0.5) < 1e-12


def test_text(spark):
    df = spark.createDataFrame([(1, "Poverty in the rural Éthiopie"), (2, "rural poverty"), (3, None), (4, "povertx")], "k int, t string")
    assert [r.k for r in T.phrase(df, "t", "RURAL ethiopie").collect()] == [1]
    assert {r.k for r in T.bm25(df, "k", "t", ["rural", "poverty"], 2).collect()} == {1, 2}
    assert [T.required(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 3, 3]
    assert T.multi_field(df, "k", {"t": 2.0}, ["zebra"]).count() == 0


def test_title_complete(spark):
    df = spark.createDataFrame([(1, "Poverty rate in Kenya"), (2, "Kenya: poverty"), (3, "What is the poverty rate"), (4, None)], "sid int, title string")
    found = lambda query: [r.sid for r in Q.title_complete(df, query).collect()]
    assert found("what is the poverty rate in Kenya") == [1] and found("their poverty, and the rate it is from") == []
    assert len(set(Q.STOPWORDS)) == 119 and found("the kenya is poverty of and") == []


def test_filters(spark):
    df = V.studies(spark, FOLDER)
    assert Q.filter_studies(df, types=[]).count() == df.count()
    with pytest.raises(ValueError):
        Q.filter_studies(df, colour=["red"])
    with pytest.raises(ValueError):
        Q.filter_studies(df, years=(2010, 2000))
    with pytest.raises(ValueError):
        Q.filter_studies(df, types=[str(i) for i in range(21)])
    # 2000 and 2010 are two years of one study: neither lies in 2003..2005
    one = spark.createDataFrame([([2000, 2010],)], "years array<int>")
    assert Q.filter_studies(one, years=(2003, 2005)).count() == 0


def test_ingest(spark):
    cur = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k int, version int, x string")
    new = spark.createDataFrame([(1, 4, "old"), (2, 1, "tie"), (3, 1, "new")], "k int, version int, x string")
    assert {(r.k, r.x) for r in I.upsert_latest(cur, new, "k", "version").collect()} == {(1, "a"), (2, "tie"), (3, "new")}
    queue = spark.createDataFrame([(1, 10, "delete", 3), (2, 10, "upsert_full", 9)], "id long, object_id long, change_class string, changed long")
    assert I.coalesce_latest(queue).first().change_class == "upsert_full"


def test_stream_is_idempotent(spark, tmp_path):
    from quarrylight.streaming import cdc

    source, schema = str(tmp_path / "in"), "object_id long, id long, change_class string, changed long"

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        cdc.apply_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path)).awaitTermination()
        return sorted(map(tuple, cdc.state_table(spark, str(tmp_path)).read().collect()))

    assert run([(1, 1, "upsert_full", 5)]) == [(1, 1, "upsert_full", 5)]
    assert run([(1, 9, "delete", 4), (2, 3, "variables", 7), (2, 4, "delete", 7)]) == [(1, 1, "upsert_full", 5), (2, 4, "delete", 7)]
    table = cdc.state_table(spark, str(tmp_path))
    assert not table.apply(table.read().limit(0), 1)  # the last batch once more


def test_recommend_takes_all_passages_of_a_study(spark):
    """A study's mean vector is that of all of its passages, however many."""
    rows = [(i, 5, [1.0, 0.0]) for i in range(501)] + [(i, 5, [0.0, 1.0]) for i in range(501, 2000)] + [(3000, 1, [1.0, 0.0]), (3001, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, sid int, embedding array<float>")
    assert [r.chunk_id for r in N.recommend(df, 5, 1).collect()] == [3001]
