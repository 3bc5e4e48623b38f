"""Vector cells, distinct sketches, delta tables and attempts with state."""

import datetime
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import cells, sketches, vectors
from quarrylight.streaming import cdc, deltas


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 16))
    x = middle[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.4
    rows = [(i, v.tolist(), i % 50) for i, v in enumerate(x)] + [(5000, [0.0] * 16, 1), (5001, None, 1), (5002, x[7].tolist(), 7)]
    return x, spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int")


@pytest.mark.parametrize("where", [None, "label = 7", "label < 25", "label = 99"])
def test_cells(spark, many, tmp_path, where):
    x, df = many
    index = cells.Cells(spark, str(tmp_path)).build(df, "chunk_id", 32)
    test = None if where is None else F.expr(where)
    found = whole = 0
    for i in (3, 99, 1234):
        query = (x[i] * 3).tolist()
        want = [r.chunk_id for r in vectors.knn(df.where("embedding IS NOT NULL AND chunk_id <> 5000"), query, 10, test).collect()]
        assert [r.chunk_id for r in index.exact(query, 10, test).collect()] == want
        got = [r.chunk_id for r in index.search(query, 10, test).collect()]
        found, whole = found + len(set(got) & set(want)), whole + len(want)
    assert found >= 0.9 * whole and (where != "label = 99" or whole == 0)


def test_cells_prune(spark, many, tmp_path):
    x, df = many
    index = cells.Cells(spark, str(tmp_path)).build(df, "chunk_id", 32)
    read = index.search(x[3].tolist(), 5)
    assert read.count() == 5
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull", "PartitionFilters: [cell")
    assert cells.Cells(spark, str(tmp_path / "none")).build(df.limit(0), "chunk_id").search([1.0] * 16, 5).count() == 0


def test_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS sid", "id % 7 AS part", "id % 2 AS half").unionByName(spark.createDataFrame([(None, 1, 1)], "sid long, part long, half long"))
    parts = sketches.sketched(df, "sid", "part", "half")
    whole = sketches.estimated(sketches.merged(parts)).first().n
    assert abs(whole - 20_000) <= 3 * sketches.ERROR * 20_000
    assert whole == sketches.estimated(sketches.sketched(df, "sid")).first().n  # the union of parts is the whole
    few = df.where("sid < 100")
    assert {r.half: r.n for r in sketches.estimated(sketches.merged(sketches.sketched(few, "sid", "part", "half"), "half")).collect()} == {0: 50, 1: 50}


SCHEMA = "k long, at long, v string"


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_deltas(spark, tmp_path):
    root = str(tmp_path)
    table = deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at", buckets=4, deltas=3)
    assert table.read().count() == 0
    now = {}

    def apply(number, data):
        for k, at, v in data:
            if k not in now or at >= now[k][0]:
                now[k] = at, v
        return deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at", buckets=4, deltas=3).apply(rows(spark, data), number)

    def read():
        return {r.k: (r.at, r.v) for r in deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at").read().collect()}

    assert apply(0, [(i, 0, hashlib.sha256(b"%d" % i).hexdigest()) for i in range(5000)]) and read() == now
    first = size(root)
    for n in range(1, 8):
        before = size(root)
        assert apply(n, [(1, n, f"n{n}"), (10_000 + n, 1, "new")])
        assert size(root) - before < first  # a batch of two rows rewrites a bucket at most
        if n < 3:
            assert size(root) - before < first / 20
        assert read() == now
    assert not deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at").apply(rows(spark, [(1, 99, "again")]), 7) and read() == now
    table = deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at")
    assert max(map(len, table.state["buckets"].values())) <= 4  # compacted
    assert sorted(map(tuple, table.lookup([(1,), (77,), (-5,)]).collect())) == sorted([(1, *now[1]), (77, *now[77])])
    apply(8, [(1, 3, "older"), (2, 0, "equal")])
    assert read()[1] == (7, "n7") and read()[2] == (0, "equal")  # of equals the later batch's
    table = deltas.DeltaTable(spark, root, SCHEMA, ("k",), "at")
    table.compact()
    assert table.clean(keep=1) > 0 and read() == now and table.clean(keep=1) == 0


def test_a_batch_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    table = deltas.DeltaTable(spark, str(tmp_path), SCHEMA, ("k",), "at")
    table.apply(rows(spark, [(1, 1, "a")]), 0)

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(table, "_commit", die)
    with pytest.raises(RuntimeError):
        table.apply(rows(spark, [(1, 2, "b")]), 1)
    table = deltas.DeltaTable(spark, str(tmp_path), SCHEMA, ("k",), "at")
    assert table.read().first().v == "a" and table.apply(rows(spark, [(1, 2, "b")]), 1) and table.read().first().v == "b"


def test_attempts_with_state(spark, tmp_path):
    """Deaths over batches: of an item that changed, that ended between, that comes back late."""
    source, schema = str(tmp_path / "in"), "id long, changed long, seq long, at timestamp, event string"
    when = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)

    def run(events):
        spark.createDataFrame([(i, c, s, when(s), e) for i, c, s, e in events], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        cdc.follow_attempts(stream, str(tmp_path)).awaitTermination()
        return {(r.id, r.changed): (r.deaths, r.poisoned, r.retry_at) for r in cdc.deaths_table(spark, str(tmp_path)).read().collect()}

    got = run([(1, 5, 1, "begin"), (2, 5, 2, "begin"), (3, 1, 3, "begin"), (3, 1, 4, "begin")])
    assert got[1, 5] == (1, False, when(61)) and got[3, 1] == (2, True, when(4 + 120))
    got = run([(1, 5, 10, "begin"), (2, 6, 11, "begin"), (3, 1, 12, "end"), (4, 1, 13, "end"), (4, 1, 14, "begin")])
    assert got[1, 5][:2] == (2, True) and got[2, 5][:2] == (1, False) and got[2, 6][:2] == (1, False)
    assert got[3, 1] == (0, False, None) and got[4, 1][:2] == (1, False)
    got = run([(3, 1, 20, "begin"), (1, 5, 10, "begin")])  # the second one was seen before
    assert got[3, 1][:2] == (1, False) and got[1, 5][:2] == (2, True)


def test_attempts_are_followed_without_a_call_for_each_item(spark, tmp_path):
    """Items are grouped by Spark itself; late attempts are dropped, and an item long unheard of starts anew."""
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    schema = "id long, changed long, seq long, at timestamp, event string"
    table = lambda: cdc.deaths_table(spark, str(tmp_path))

    def run(number, *events):
        batch = spark.createDataFrame([(i, 1, s, day(n), e) for i, s, n, e in events], schema)
        out = cdc.deaths_after(batch, table())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        table().apply(out, number, {"latest": int(max(n for _, _, n, _ in events) * 86_400_000_000 + 1_704_067_200_000_000)})
        return {r.id: r.deaths for r in table().read().collect()}

    assert run(0, (1, 1, 0, "begin"), (None, 2, 0, "begin"), (3, 3, 0, "begin"), (3, 3, 0, "end"), (3, 4, 0, "begin")) == {1: 1, None: 1, 3: 1}
    assert run(1, (None, 5, 1, "begin"), (4, 6, 30, "begin")) == {1: 1, None: 2, 3: 1, 4: 1}
    assert run(2, (None, 7, 22, "begin"), (3, 8, 29, "begin"), (1, 9, 23, "end")) == {1: 0, None: 2, 3: 1, 4: 1}
