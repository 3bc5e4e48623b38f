"""The walk over nested records, and the forms of extract payloads."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import nested
from quarrylight.operators import analytics, schemas, search


def test_order_and_keys():
    record = {"study_desc": {"title": " T ", "abstract": "no", "nested": {"deep": {"Var_Group": ["g1", "g2", "x"]}}}, "data_dictionary": [{"name": "n1", "labl": "l1", "other": "no"}, {"name": "n1", "label": "l2"}], "title": "not searched"}
    assert nested.searchable(record).split("\n") == ["n1", "l1", "l2", "T", "g1", "g2"]
    assert nested.searchable({"data_dictionary": {"x": 1}, "title": "whole record", "name": "a"}) == "whole record"
    assert nested.searchable({"file_description": "a text"}) == "a text"
    assert nested.searchable({}) == nested.searchable(None) == nested.searchable([]) == ""


def test_limits():
    deep = "deepest"
    for _ in range(nested.DEPTH):
        deep = {"group": deep}
    assert nested.searchable({"data_dictionary": deep}) == "deepest" and nested.searchable({"data_dictionary": {"group": deep}}) == ""
    wide = {"data_dictionary": [f"v{i}" for i in range(nested.ITEMS + 5)]}
    assert len(nested.searchable(wide).split("\n")) == nested.ITEMS
    many = {"data_dictionary": [[f"v{i}-{j}" for j in range(400)] for i in range(20)]}
    assert len(nested.searchable(many).split("\n")) == nested.LINES


def test_microdata_text(spark):
    record = json.dumps({"data_dictionary": {"variable": "age"}})
    df = spark.createDataFrame([("a", "microdata", record, ["x", None, ""], None), ("b", "document", record, None, None), ("c", "microdata", "{", ["y"], ["z"]), ("d", "microdata", None, ["q"], None), ("e", "microdata", "[1]", None, None)], "c string, k string, m string, l array<string>, g array<string>")
    got = [r[0] for r in df.select(nested.with_microdata_text(F.col("c"), F.col("k"), F.col("m"), F.col("l"), F.col("g"))).collect()]
    assert got == ["a\nage\nx", "b", "c\ny\nz", "d", "e"]


def test_payload_forms(spark):
    good = {"core_fields": {"catalog_id": 5}, "filters": {"a": [1]}}
    text_id = {"core_fields": {"catalog_id": "6"}, "filters": {"b": "x"}, "more": 1}
    bad = [{"core_fields": {"catalog_id": 0}, "filters": {}}, {"core_fields": {"catalog_id": 5}, "filters": [1]}, {"filters": {}}, {"core_fields": 3, "filters": {}}, {"core_fields": {"catalog_id": "x"}, "filters": {}}]
    payloads = [{"studies": [good, *bad, None, 3, text_id], "study": good}, {"study": text_id}, good, {"study": bad[0], **good}, {"studies": []}, {"studies": {}, "study": good}, *bad, [good], 3]
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads] + [(None,), ("{",)], "payload string")
    got = sorted((r.sid, r.filters) for r in nested.filter_records(df).collect())
    assert got == [(5, '{"a":[1]}')] * 4 + [(6, '{"b":"x"}')] * 2


def test_schema_roles(spark):
    parts = [("REF_AREA_CODE", "geography"), ("NAME", "attribute"), ("REF_AREA_NAME", "attribute"), ("REF_AREA_NAME_2", "attribute"), ("FREQ", "periodicity"), ("T", "time_period"), ("V", "observation_value"), ("AGE", "dimension"), ("IND", "indicator_id"), ("X", None)]
    good = json.dumps({"status": "ok", "result": {"components": [{"name": n, "column_type": t, "codelist": [1]} for n, t in parts]}})
    rows = [("a", good), ("b", json.dumps({"result": {"components": [{"name": "G", "column_type": "geography"}]}})), ("c", "{"), ("d", json.dumps({"status": "Failed"})), ("e", None), ("f", "{}")]
    schema = schemas.bound(spark.createDataFrame(rows, "idno string, payload string"))
    got = {r.idno: r for r in schema.collect()}
    assert (got["a"].geo_column, got["a"].freq_column, got["a"].dimensions, got["a"].label_column, got["a"].error) == ("REF_AREA_CODE", "FREQ", ["AGE", "X"], "REF_AREA_NAME", None)
    assert got["b"].error == "missing: time_period, observation_value" and got["d"].error == "Schema API error: failed" and got["c"].error and got["e"].error
    assert got["f"].error == "missing: geography, time_period, observation_value"
    assert schemas.roles_of(schema, "a") == analytics.Roles("REF_AREA_CODE", "T", "V", "row_ord", "REF_AREA_NAME")
    for bad in ("b", "zz"):
        with pytest.raises(ValueError):
            schemas.roles_of(schema, bad)


def test_catalog_sorts():
    assert search.catalog_sort_keys("total_views") == search.sort_keys("popularity") and search.catalog_sort_keys("country", "desc")[0] == ("nation_sort", False)
    for bad in (("colour", None), ("title", "up")):
        with pytest.raises(ValueError):
            search.catalog_sort_keys(*bad)


def test_idno_first(spark):
    df = spark.createDataFrame([("Ab.1",), ("poverty x",)], "idno string")
    found = lambda q: [r[0] for r in search.idno_first(df, q, lambda q: df.sparkSession.createDataFrame([("searched " + q,)], "idno string")).collect()]
    assert found("ab.1") == ["Ab.1"] and found("poverty") == ["searched poverty"] and found("poverty x") == ["searched poverty x"]
