"""Runs a query and its oracle SQL over one folder of tables and compares their rows."""

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in records)


def same(spark, con, folder, query, sql):
    got = query(spark, folder)
    want = con.sql(sql)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    b = rows(want.columns, want.fetchall())
    assert a == b
