"""Analytic operators on small rows worked out by hand."""

import math

import numpy as np
import pytest

from quarrylight.functions.lowess import lowess
from quarrylight.functions.scalar import format_authors, idno_like, parse_obs, period_to_numeric, split_list
from quarrylight.operators import analytics as A

R = A.Roles("GEO", "PERIOD", "VALUE", "ord", "GEO_NAME")
ROWS = [(0, "A", "Alpha", "2020", "10.0"), (1, "B", "Beta", "2020", "30.0"), (2, "C", "Gamma", "2020", "20.0"), (3, "A", "Alpha", "2021", "12.0"), (4, "B", "Beta", "2021", "25.0"), (5, "C", "Gamma", "2021", "22.0")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "ord long, GEO string, GEO_NAME string, PERIOD string, VALUE string")


def test_rank(spark):
    got = A.rank(frame(spark), R, "2020", 2).collect()
    assert [(r.rank, r.geo, r.value, r.total_ref_areas) for r in got] == [(1, "B", 30.0, 3), (2, "C", 20.0, 3)]
    assert [r.geo for r in A.rank(frame(spark), R, "2020", 2, ascending=True).collect()] == ["A", "C"]
    assert A.rank(frame(spark), R, "1900").count() == 0


@pytest.mark.parametrize("ascending", [False, True])
def test_rank_ties_keep_arrival_order(spark, ascending):
    rows = [(i, g, g, "2020", "5") for i, g in enumerate("CAB")]
    assert [r.geo for r in A.rank(frame(spark, rows), R, "2020", ascending=ascending).collect()] == ["C", "A", "B"]


def test_extremes_earliest_of_equals(spark):
    rows = [(0, "B", "b", "2020", "5"), (1, "A", "a", "2020", "5"), (2, "C", "c", "2020", "x")]
    r = A.extremes(frame(spark, rows), R).first()
    assert (r.max_geo, r.min_geo, r.total_observations) == ("B", "B", 2)
    assert A.extremes(frame(spark, []), R).first().max_geo is None


def test_compare_first_row_counts_even_if_null(spark):
    rows = [(0, "A", "a", "2020", "nan"), (1, "A", "a", "2020", "4"), (2, "B", "b", None, "7")]
    got = {r.period: r for r in A.compare(frame(spark, rows), R, ["A", "B", "Z"]).collect()}
    assert got["2020"].A is None and got[""].B == 7.0 and got[""].Z is None


def test_summarize(spark):
    r = A.summarize(frame(spark), R, "2020").first()
    assert (r["count"], r.min, r.max, r.mean, r.median, r.min_geo, r.max_geo) == (3, 10.0, 30.0, 20.0, 20.0, "A", "B")
    assert A.summarize(frame(spark, ROWS[:1]), R, "2020").first().std == 0.0
    assert A.summarize(frame(spark), R, "1900").first()["count"] == 0


def test_growth(spark):
    rows = [*ROWS, (6, "D", "d", "2020", "0"), (7, "D", "d", "2021", "3"), (8, "E", "e", "2020", "1"), (9, "A", "a", "2021", "13")]
    got = {r.geo: r for r in A.growth(frame(spark, rows), R, "2020", "2021").collect()}
    assert got["B"].absolute_change == -5 and math.isclose(got["B"].pct_change, -5 / 30 * 100)
    assert got["D"].pct_change is None and got["E"].end_value is None and got["A"].end_value == 13


def test_correlate(spark):
    other = [(i, g, g, "2020", str(v)) for i, (g, v) in enumerate((("A", 1), ("B", 3), ("C", 2)))]
    assert A.correlate(frame(spark), frame(spark, other), R, "2020").first().r == 1.0
    flat = [(i, g, g, "2020", "1") for i, g in enumerate("ABC")]
    assert A.correlate(frame(spark), frame(spark, flat), R, "2020").first().r is None
    assert A.correlate(frame(spark), frame(spark, other[:1]), R, "2020").first().r is None


def test_outliers(spark):
    rows = [(i, g, g, "2020", str(v)) for i, (g, v) in enumerate((("A", 1), ("B", 2), ("C", 3), ("D", 4), ("E", 100)))]
    got = {r.geo: r for r in A.outliers(frame(spark, rows), R, period="2020").collect()}
    assert got["E"].is_outlier and not got["A"].is_outlier and got["E"].score == round(0.6745 * 97, 4)
    got = {r.geo: r for r in A.outliers(frame(spark, rows), R, period="2020", method="iqr").collect()}
    assert got["E"].score == (100 - 7) / 2 and got["E"].is_outlier
    flat = [(i, g, g, "2020", "5") for i, g in enumerate("ABC")]
    assert {r.score for r in A.outliers(frame(spark, flat), R, period="2020").collect()} == {0.0}
    assert {r.score for r in A.outliers(frame(spark, flat), R, period="2020", method="iqr").collect()} == {0.0}
    with pytest.raises(ValueError):
        A.outliers(frame(spark), R)


def test_outliers_by_local_regression(spark):
    rows = [(i, "A", "a", str(1980 + i), str(i + i * 7 % 5 / 10 + (50 if i == 20 else 0))) for i in range(40)]
    got = {r.period: r for r in A.outliers(frame(spark, rows), R, ref_area="A", method="trend_residual").collect()}
    assert got["2000"].is_outlier and not got["1990"].is_outlier and abs(got["1980"].residual) < 1


def plain_lowess(x, y, frac, rounds=4):
    """From the definition: every place looks at all others."""
    n = len(x)
    k = max(2, min(n, int(frac * n + 1e-10)))
    robust = np.ones(n)
    for _ in range(rounds):
        fit = y.astype(float).copy()
        for i in range(n):
            far = np.abs(x - x[i])
            reach = np.sort(far)[k - 1]
            w = robust * (np.where(far < reach * 0.999, (1 - (far / reach) ** 3) ** 3, 0) if reach > 0 else far == 0)
            if w.sum() > 0:
                mx, my = np.average(x, weights=w), np.average(y, weights=w)
                spread = np.average((x - mx) ** 2, weights=w)
                fit[i] = my + (np.average((x - mx) * (y - my), weights=w) / spread if spread > 1e-12 else 0) * (x[i] - mx)
        rest = np.abs(y - fit)
        scale = 6 * np.median(rest)
        if scale <= 0:
            break
        robust = np.where(rest < scale, (1 - (rest / scale) ** 2) ** 2, 0)
    return fit


def test_lowess_over_windows():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 40):
        for x in (rng.normal(size=n), np.arange(n) * 1.0, rng.integers(0, max(1, n // 4), n) * 1.0, np.full(n, 3.0)):
            y = 2 * x + rng.normal(size=n)
            y[0] += 10
            for frac in (0.3, 1.0):
                assert np.allclose(lowess(x, y, frac), plain_lowess(x, y, frac), rtol=1e-9, atol=1e-9)
    assert len(lowess([], [], 0.3)) == 0 and lowess([1.0], [2.0], 1.0).tolist() == [2.0]


def test_lowess_of_a_line_is_the_line():
    x = [float(i) for i in range(20)]
    assert max(abs(a - (3 * b + 1)) for a, b in zip(lowess(x, [3 * b + 1 for b in x], 0.4), x, strict=True)) < 1e-9


def test_trend(spark):
    rows = [(i, g, g, p, str(v)) for i, (g, p, v) in enumerate((("A", "2000", 1), ("A", "2001", 3), ("B", "2000", 4), ("B", "2001", 4), ("C", "2000", 1), ("C", "2000", 2), ("D", "2000", 1), ("E", "2000-Q1", 1), ("E", "2000-Q3", 0)))]
    got = {r.geo: r for r in A.trend(frame(spark, rows), R).collect()}
    assert (got["A"].slope, got["A"].r_squared, got["A"].direction) == (2.0, 1.0, "improving")
    assert (got["B"].slope, got["B"].r_squared, got["B"].direction) == (0.0, 0.0, "stable")
    assert (got["C"].slope, got["C"].intercept, got["C"].r_squared) == (0.0, 1.5, 0.0)
    assert "D" not in got and got["E"].slope == -2.0 and got["E"].direction == "declining"


def test_benchmark(spark):
    rows = [(i, g, g, "2020", str(v)) for i, (g, v) in enumerate((("A", 1), ("B", 2), ("C", 2), ("D", 3)))]
    got = {r.geo: r for r in A.benchmark(frame(spark, rows), R, ["B", "Z"], "2020").collect()}
    assert got["B"].percentile == 50.0 and got["B"].vs_mean == 0.0 and got["Z"].value is None and got["Z"].percentile is None
    assert A.benchmark(frame(spark, rows[:1]), R, ["A"], "2020").first().z_score == 0.0


def test_coverage_join_aggregate(spark):
    rows = [*ROWS, (6, "A", "a", "2022", "nan")]
    got = {r.geo: r for r in A.coverage(frame(spark, rows), R).collect()}
    assert got["A"].n_periods == 2 and got["A"].coverage_pct == 100.0 and got["A"].last_period == "2021"
    joined = A.join_indicators(frame(spark, ROWS[:3]), frame(spark, ROWS[3:]), R).collect()
    assert len(joined) == 6 and all((r.value_1 is None) != (r.value_2 is None) for r in joined)
    total = {r.period: r for r in A.aggregate(frame(spark, [*ROWS, ROWS[0]]), R).collect()}
    assert total["2020"].n_ref_areas == 4 and total["2020"].total == 70.0


def test_dimensions_and_roles(spark):
    df = frame(spark).withColumnRenamed("ord", "SEX").selectExpr("*", "SEX AS ord")
    assert A.where_dimensions(df, {"SEX": 3}).count() == 1
    assert A.where_dimensions(df, {"AGE": 3}).count() == 0
    with pytest.raises(ValueError, match="geography"):
        A.rank(df, A.Roles(geo=""), "2020")


def test_scalars(spark):
    from pyspark.sql import functions as F

    cases = {"4.5": 4.5, "0": 0.0, "": None, "nan": None, "inf": None, "-inf": None, "not_a_number": None, "1_000": 1000.0, "1.0d": None, " 4.5 ": 4.5, "1e3": 1000.0, "1__0": None, ".5": 0.5, "5.": 5.0}
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    assert all(r.got == r.want for r in df.select("want", parse_obs(F.col("t")).alias("got")).collect())
    periods = {"2020": 2020.0, "2020-Q3": 2020.5, "2020-07": 2020.5, "x": None}
    df = spark.createDataFrame(list(periods.items()), "t string, want double")
    assert all(r.got == r.want for r in df.select("want", period_to_numeric(F.col("t")).alias("got")).collect())
    r = spark.range(1).select(
        format_authors(F.lit('[{"fname":"Olivia Victoria","lname":"Bentley"},{"fname":"Ann","initial":"B","lname":"Smith"}]')).alias("a"),
        format_authors(F.lit("[{}]")).alias("b"), format_authors(F.lit("Plain Name")).alias("c"), split_list(F.lit(" a, ,b ")).alias("d"), idno_like(F.lit("WLD_2021")).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("Olivia Victoria Bentley; Ann B Smith", "", "Plain Name", ["a", "b"], True)
