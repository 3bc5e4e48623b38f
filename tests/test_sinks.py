"""Writes, types, filters and merges in the cases that tables rarely have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import analytics, ingest, search, sinks
from quarrylight.sources import views

FOLDER = "/root/testdata/sf0.001"


def test_merge_of_any_magnitude(spark):
    roles = analytics.Roles(order="period", label=None)
    rows = [("a", "2000", 3e19), ("b", "2000", 1e19), ("a", "2001", 1e-10), ("b", "2001", 3e-10), ("a", "2002", 0.12345), ("a", "2003", None)]
    df = spark.createDataFrame(rows, "geo string, period string, v double")
    got = {r.period: (r.mean_1, r.mean_2) for r in analytics.merge_by_period([df, df.where("geo = 'a'")], roles).collect()}
    assert got["2000"] == (2e19, 3e19) and got["2001"] == (0.0, 0.0) and got["2002"][0] in (0.1234, 0.1235)


def test_all_catalog_types(spark):
    kinds = ["survey", "timeseries", "timeseriesdb", "timeseries-db", "document", "table", "geospatial", "script", "image", "video", "novel"]
    df = spark.createDataFrame([(i + 1, f"I{i}", k) for i, k in enumerate(kinds)], "catalog_id int, idno string, dataset_type string")
    got = {r.idno: (r.type, r.rejected) for r in ingest.validated(df).collect()}
    assert [got[f"I{i}"][0] for i in range(10)] == ["microdata", "indicator", "indicator-db", "indicator-db", "document", "table", "geospatial", "script", "image", "video"]
    assert got["I10"] == (None, "dataset_type")


def test_one_row_of_a_study_counts(spark):
    stored = spark.createDataFrame([(1, "old", "text"), (2, "b", "t")], "sid int, title string, all_text string")
    twice = spark.createDataFrame([(1, "first", None, 1), (1, "last", None, 2), (1, "middle", "m", 1)], "sid int, title string, all_text string, at int")
    assert sorted(map(tuple, sinks.partial_update(stored, twice, order="at").collect())) == [(1, "last", "text"), (2, "b", "t")]
    assert sinks.partial_update(stored, twice.drop("at")).count() == 2
    changes = spark.createDataFrame([(1, 10, "upsert_full"), (3, 11, "upsert_full")], "sid int, id int, change_class string")
    records = twice.unionByName(spark.createDataFrame([(3, "new", "n", 1), (3, "new", "n", 1)], twice.schema))
    assert sorted(map(tuple, sinks.apply_classes(stored, changes, records, order="at").collect())) == [(1, "last", None), (2, "b", "t"), (3, "new", "n")]
    chunks = spark.createDataFrame([(7, 1, {"k": ["o"]}), (8, 2, {"k": ["o"]})], "chunk_id int, sid int, facets map<string,array<string>>")
    filters = spark.createDataFrame([(1, {"k": ["x"]}, 1), (1, {"k": ["y"]}, 2)], "sid int, facets map<string,array<string>>, at int")
    assert {r.chunk_id: r.facets for r in sinks.sync_filters(chunks, filters, "at").collect()} == {7: {"k": ["y"]}, 8: {"k": ["o"]}}


def test_poison_items(spark):
    events = [(1, 5, 1, "begin"), (1, 5, 2, "begin"), (2, 5, 1, "begin"), (2, 6, 2, "begin"), (3, 1, 1, "begin"), (3, 1, 2, "begin"), (3, 1, 3, "end"), (3, 1, 4, "begin"), (4, 1, 1, "end"), (4, 1, 2, "begin"), (4, 1, 3, "begin"), (4, 1, 4, "begin")]
    df = spark.createDataFrame(events, "id int, changed int, seq int, event string")
    assert sorted(map(tuple, sinks.poisoned(df).collect())) == [(1, 5, 2), (4, 1, 3)]


def test_ranges_and_ids_are_checked(spark):
    df = views.studies(spark, FOLDER)
    for bad in ({"created": (5, 4)}, {"created_from": -1}, {"year_from": 2001, "year_to": 2000}, {"year_to": 10_000}, {"countries": [0]}, {"regions": list(range(1, 302))}, {"color": ["red"]}):
        with pytest.raises(ValueError):
            search.filter_studies(df, **bad)
    n = df.count()
    assert search.filter_studies(df, countries=[], regions=None, facets={"theme": []}, created=(None, None)).count() == n
    assert search.filter_studies(df, created_from=500).count() == df.where("created >= 500").count()
    assert search.filter_studies(df, facets={"absent": [1]}).count() == 0 and search.filter_studies(df, databases=["DB_1"]).count() == df.where(F.array_contains("databases", "DB_1")).count()


def test_selected_facet_values_are_listed_once(spark):
    df = views.studies(spark, FOLDER)
    rows = search.facets(df, {"countries": F.col("countries")}, {}, 2, {"countries": ["100", "204"]}).collect()
    assert len(rows) == len({r.value for r in rows}) >= 2 and {"100", "204"} <= {r.value for r in rows} and all(r.more for r in rows)


def test_trend_of_real_magnitudes(spark):
    roles = analytics.Roles(order="period", label=None)
    rng = np.random.default_rng(2)
    x = np.arange(1990, 2020)
    y = 7e10 + 3.5e8 * (x - 1990) + rng.normal(size=30) * 1e7
    df = spark.createDataFrame([("a", str(p), float(v)) for p, v in zip(x, y)], "geo string, period string, v double")
    row = analytics.trend(df, roles).first()
    slope, intercept = np.polyfit(x, y, 1)
    assert row.slope == pytest.approx(slope, rel=1e-9) and row.intercept == pytest.approx(intercept, rel=1e-9)
