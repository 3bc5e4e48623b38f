"""Analytics queries over the observation views, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions.scalar import parse_obs, period_to_numeric
from quarrylight.operators import analytics as A
from quarrylight.sources import views as V
from quarrylight.sources.views import with_views

R = A.Roles()
REFS = ["NATION_1", "NATION_7", "NATION_14", "NOWHERE"]
_refs = "('NATION_1', 'NATION_7', 'NATION_14', 'NOWHERE')"


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


QUERIES: dict = {}
ORACLES: dict = {}

#: A dirty text column: nan, blanks, nulls and numbers, by order key.
DIRTY_SQL = "CASE row_ord % 7 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN ' ' || CAST(row_ord AS VARCHAR) || '.5 ' WHEN 4 THEN '1_000' WHEN 5 THEN '1.0d' ELSE CAST(row_ord AS VARCHAR) || 'e2' END"
_NUM = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def _dirty(spark, d):
    k = F.pmod("row_ord", F.lit(7))
    text = F.col("row_ord").cast("string")
    v = F.when(k == 0, "nan").when(k == 1, "").when(k == 2, None).when(k == 3, F.concat(F.lit(" "), text, F.lit(".5 "))).when(k == 4, "1_000").when(k == 5, "1.0d").otherwise(F.concat(text, F.lit("e2")))
    return V.obs_raw(spark, d).withColumn("v", v)


_dirty_sql = f"dirty AS (SELECT * REPLACE ({DIRTY_SQL} AS v) FROM obs_raw), parsed AS (SELECT * REPLACE (CASE WHEN regexp_matches(trim(v), '{_NUM}') THEN try_cast(replace(trim(v), '_', '') AS DOUBLE) END AS v) FROM dirty)"


@_query("obs_page_scan", with_views("obs_raw", "SELECT geo, period, v, row_ord FROM obs_raw WHERE year BETWEEN 1996 AND 1998 ORDER BY v DESC, row_ord LIMIT 100 OFFSET 50"))
def obs_page_scan(spark, d):
    return V.obs_raw(spark, d).where("year BETWEEN 1996 AND 1998").select("geo", "period", "v", "row_ord").orderBy(F.desc("v"), "row_ord").offset(50).limit(100)


@_query("obs_year_geo_filter", with_views("obs_raw", f"SELECT geo, period, v, row_ord FROM obs_raw WHERE year BETWEEN 1997 AND 1999 AND geo IN {_refs}"))
def obs_year_geo_filter(spark, d):
    return V.obs_raw(spark, d).where(F.col("year").between(1997, 1999) & F.col("geo").isin(REFS)).select("geo", "period", "v", "row_ord")


@_query("obs_dimension_filter", with_views("obs_raw", "SELECT geo, period, v, row_ord FROM obs_raw WHERE dim = 'BUILDING' AND year::VARCHAR = '1997'"))
def obs_dimension_filter(spark, d):
    return A.where_dimensions(V.obs_raw(spark, d), {"dim": "BUILDING", "year": 1997}).select("geo", "period", "v", "row_ord")


@_query("parse_obs_values", with_views("obs_raw", f", {_dirty_sql} SELECT row_ord, v FROM parsed"))
def parse_obs_values(spark, d):
    return _dirty(spark, d).select("row_ord", parse_obs(F.col("v")).alias("v"))


@_query("period_axis", with_views("obs_raw", """, p AS (SELECT row_ord, CASE row_ord % 4 WHEN 0 THEN period WHEN 1 THEN period || '-Q' || (row_ord % 3 + 1) WHEN 2 THEN month ELSE 'n/a' END AS p FROM obs_raw)
SELECT row_ord, round(CASE WHEN regexp_matches(p, '^\\d{4}$') THEN p::DOUBLE WHEN contains(p, 'Q') THEN left(p, 4)::DOUBLE + (right(p, 1)::DOUBLE - 1) / 4
 WHEN regexp_matches(p, '^\\d{4}-\\d{2}$') THEN left(p, 4)::DOUBLE + (right(p, 2)::DOUBLE - 1) / 12 ELSE try_cast(p AS DOUBLE) END, 6) AS x FROM p""".replace("\\\\", "\\")))
def period_axis(spark, d):
    raw = V.obs_raw(spark, d).select("row_ord", "period").join(V.obs_raw(spark, d, "yyyy-MM").select("row_ord", F.col("period").alias("month")), "row_ord")
    k = F.pmod("row_ord", F.lit(4))
    p = F.when(k == 0, F.col("period")).when(k == 1, F.concat("period", F.lit("-Q"), (F.pmod("row_ord", F.lit(3)) + 1).cast("string"))).when(k == 2, F.col("month")).otherwise("n/a")
    return raw.select("row_ord", F.round(period_to_numeric(p), 6).alias("x"))


@_query("codelist_distinct", with_views("obs_raw", "SELECT geo AS code, min_by(geo_name, row_ord) AS label FROM obs_raw GROUP BY geo"))
def codelist_distinct(spark, d):
    return A.codelist(V.obs_raw(spark, d), "geo", "geo_name", "row_ord")


@_query("codelist_first_rows", with_views("obs_raw", "SELECT geo AS code, min_by(geo_name, row_ord) AS label FROM (SELECT * FROM obs_raw ORDER BY row_ord LIMIT 500) GROUP BY geo"))
def codelist_first_rows(spark, d):
    return A.codelist(V.obs_raw(spark, d), "geo", "geo_name", "row_ord", 500)


@_query("label_map", with_views("obs_raw", "SELECT geo, min_by(geo_name, row_ord) AS label FROM obs_raw GROUP BY geo"))
def label_map(spark, d):
    return A.label_map(V.obs_raw(spark, d), R)


def _rank_sql(view: str, period: str, way: str, n: int, v: str = "v") -> str:
    return f"""f AS (SELECT geo, min_by(geo_name, row_ord) AS label, min_by({v}, row_ord) AS v, min(row_ord) AS o FROM {view} WHERE period = '{period}' AND {v} IS NOT NULL GROUP BY geo)
SELECT row_number() OVER (ORDER BY v {way}, o) AS rank, geo, label, v AS value, (SELECT count(*) FROM f) AS total_ref_areas FROM f ORDER BY v {way}, o LIMIT {n}"""


@_query("rank_top", with_views("obs", ", " + _rank_sql("obs", "1998", "DESC", 10)))
def rank_top(spark, d):
    return A.rank(V.obs(spark, d), R, "1998", 10)


@_query("rank_bottom", with_views("obs", ", " + _rank_sql("obs", "1998", "ASC", 5)))
def rank_bottom(spark, d):
    return A.rank(V.obs(spark, d), R, "1998", 5, ascending=True)


@_query("rank_ties_by_arrival", with_views("obs_raw", ", t AS (SELECT * REPLACE ((row_ord % 3)::DOUBLE AS v) FROM obs_raw), " + _rank_sql("t", "1997", "DESC", 12)))
def rank_ties_by_arrival(spark, d):
    return A.rank(V.obs_raw(spark, d).withColumn("v", F.pmod("row_ord", F.lit(3)).cast("double")), R, "1997", 12)


@_query("extremes", with_views("obs_raw", """, t AS (SELECT * REPLACE (round(v / 1000) AS v) FROM obs_raw), h AS (SELECT geo, period, v FROM t ORDER BY v DESC, row_ord LIMIT 1), l AS (SELECT geo, period, v FROM t ORDER BY v, row_ord LIMIT 1)
SELECT h.geo AS max_geo, h.period AS max_period, h.v AS max_value, l.geo AS min_geo, l.period AS min_period, l.v AS min_value, (SELECT count(*) FROM t) AS total_observations FROM h, l"""))
def extremes(spark, d):
    return A.extremes(V.obs_raw(spark, d).withColumn("v", F.round(F.col("v") / 1000)), R)


_compare = ", ".join(f"min_by(v, row_ord) FILTER (WHERE geo = '{r}') AS \"{r}\"" for r in REFS)


@_query("compare_pivot", with_views("obs", f"SELECT period, {_compare} FROM obs WHERE geo IN {_refs} GROUP BY period"))
def compare_pivot(spark, d):
    return A.compare(V.obs(spark, d), R, REFS)


@_query("compare_unpivot", with_views("obs", f", c AS (SELECT period, {_compare} FROM obs WHERE geo IN {_refs} GROUP BY period) SELECT p.period, g.geo, o.v AS value FROM c AS p, (SELECT unnest(['NATION_1', 'NATION_7', 'NATION_14', 'NOWHERE']) AS geo) g LEFT JOIN obs o ON o.period = p.period AND o.geo = g.geo"))
def compare_unpivot(spark, d):
    return A.unpivoted(A.compare(V.obs(spark, d), R, REFS), REFS)


_first_any = ", ".join(f"(SELECT p2.v FROM parsed p2 WHERE p2.geo = '{r}' AND p2.period = parsed.period ORDER BY p2.row_ord LIMIT 1) AS \"{r}\"" for r in REFS)


@_query("compare_first_row_null", with_views("obs_raw", f", {_dirty_sql} SELECT period, {_first_any} FROM parsed WHERE geo IN {_refs} GROUP BY period"))
def compare_first_row_null(spark, d):
    return A.compare(_dirty(spark, d), R, REFS)


def _summary_sql(where: str) -> str:
    return f"""SELECT count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, median(v) AS median, CASE WHEN count(*) > 0 THEN coalesce(round(stddev_samp(v), 4), 0.0) END AS std,
 arg_min(geo, v) AS min_geo, arg_max(geo, v) AS max_geo FROM obs WHERE {where}"""


@_query("summarize_period", with_views("obs", _summary_sql("period = '1998'")))
def summarize_period(spark, d):
    return A.summarize(V.obs(spark, d), R, "1998")


@_query("summarize_single", with_views("obs", _summary_sql("period = '1998' AND geo = 'NATION_1'")))
def summarize_single(spark, d):
    return A.summarize(V.obs(spark, d), R, "1998", {"geo": "NATION_1"})


def _growth_sql(view: str, where: str = "true") -> str:
    return f""", b AS (SELECT geo, max_by(v, row_ord) FILTER (WHERE period = '1996') AS base_value, max_by(v, row_ord) FILTER (WHERE period = '1999') AS end_value FROM {view} WHERE period IN ('1996', '1999') AND {where} GROUP BY geo)
SELECT geo, base_value, end_value, end_value - base_value AS absolute_change, CASE WHEN base_value <> 0 THEN (end_value - base_value) / abs(base_value) * 100 END AS pct_change FROM b"""


@_query("growth_change", with_views("obs_raw", _growth_sql("obs_raw")))
def growth_change(spark, d):
    return A.growth(V.obs_raw(spark, d), R, "1996", "1999")


@_query("growth_zero_base", with_views("obs_raw", ", z AS (SELECT * REPLACE (CASE WHEN period = '1996' AND row_ord % 2 = 0 THEN 0 ELSE v END AS v) FROM obs_raw)" + _growth_sql("z", f"geo IN {_refs}")))
def growth_zero_base(spark, d):
    return A.growth(V.obs_raw(spark, d).withColumn("v", F.when((F.col("period") == "1996") & (F.pmod("row_ord", F.lit(2)) == 0), 0.0).otherwise(F.col("v"))), R, "1996", "1999", REFS)


@_query("correlate_pairs", with_views("obs obs2", "SELECT geo, a.v AS x, b.v AS y FROM obs a JOIN obs2 b USING (geo) WHERE a.period = '1998' AND b.period = '1998'"))
def correlate_pairs(spark, d):
    return A.correlate_pairs(V.obs(spark, d), V.obs2(spark, d), R, "1998")


@_query("correlate_r", with_views("obs obs2", "SELECT round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM obs a JOIN obs2 b USING (geo) WHERE a.period = '1998' AND b.period = '1998'"))
def correlate_r(spark, d):
    return A.correlate(V.obs(spark, d), V.obs2(spark, d), R, "1998")


@_query("correlate_constant", with_views("obs obs2", "SELECT NULL::DOUBLE AS r, count(*) AS n FROM obs a JOIN obs2 b USING (geo) WHERE a.period = '1998' AND b.period = '1998'"))
def correlate_constant(spark, d):
    return A.correlate(V.obs(spark, d), V.obs2(spark, d).withColumn("v", F.lit(7.0)), R, "1998")


def _z_sql(view: str, where: str) -> str:
    return f""", f AS (SELECT geo, period, geo_name AS label, v FROM {view} WHERE {where}), m AS (SELECT median(v) AS med, stddev_pop(v) AS sd FROM f), k AS (SELECT median(abs(v - med)) AS mad FROM f, m),
 z AS (SELECT *, CASE WHEN mad <> 0 THEN 0.6745 * (v - med) / mad WHEN sd <> 0 THEN (v - med) / sd ELSE 0.0 END AS z FROM f, m, k)
SELECT geo, period, label, v AS value, round(z, 4) AS score, abs(z) >= 3.5 AS is_outlier, round(med, 4) AS centre, round(mad, 4) AS spread FROM z"""


def _iqr_sql(view: str, where: str) -> str:
    return f""", f AS (SELECT geo, period, geo_name AS label, v FROM {view} WHERE {where}), s AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS c, stddev_pop(v) AS sd FROM f),
 t AS (SELECT *, q3 - q1 AS gap FROM f, s), z AS (SELECT *, CASE WHEN gap = 0 THEN 0.0 WHEN v > q3 + 1.5 * gap THEN (v - (q3 + 1.5 * gap)) / gap WHEN v < q1 - 1.5 * gap THEN (q1 - 1.5 * gap - v) / gap ELSE 0.0 END AS z FROM t)
SELECT geo, period, label, v AS value, round(z, 4) AS score, z > 0 AS is_outlier, round(c, 4) AS centre, round(sd, 4) AS spread FROM z"""


@_query("outliers_zscore_cross", with_views("obs", _z_sql("obs", "period = '1998'")))
def outliers_zscore_cross(spark, d):
    return A.outliers(V.obs(spark, d), R, period="1998")


@_query("outliers_mad_zero_fallback", with_views("obs", ", q AS (SELECT * REPLACE (CASE WHEN geo = 'NATION_14' THEN 900.0 ELSE 5.0 END AS v) FROM obs)" + _z_sql("q", "period = '1998'")))
def outliers_mad_zero_fallback(spark, d):
    return A.outliers(V.obs(spark, d).withColumn("v", F.when(F.col("geo") == "NATION_14", 900.0).otherwise(5.0)), R, period="1998")


@_query("outliers_iqr_cross", with_views("obs", _iqr_sql("obs", "period = '1998'")))
def outliers_iqr_cross(spark, d):
    return A.outliers(V.obs(spark, d), R, period="1998", method="iqr")


@_query("outliers_zscore_long", with_views("obs_month", _z_sql("obs_month", "geo = 'NATION_1'")))
def outliers_zscore_long(spark, d):
    return A.outliers(V.obs(spark, d, "yyyy-MM"), R, ref_area="NATION_1")


@_query("outliers_iqr_long", with_views("obs_month", _iqr_sql("obs_month", "geo = 'NATION_1'")))
def outliers_iqr_long(spark, d):
    return A.outliers(V.obs(spark, d, "yyyy-MM"), R, ref_area="NATION_1", method="iqr")


def _lowess_sql() -> str:
    """The local regression of one place's months from its definition: every pair of points, four weighted fits."""
    steps = [
        "s AS (SELECT row_number() OVER (ORDER BY period) AS i, period, left(period, 4)::DOUBLE + (right(period, 2)::DOUBLE - 1) / 12 AS x, v AS y FROM obs_month WHERE geo = 'NATION_1')",
        "k AS (SELECT greatest(2, least(count(*), floor(CASE WHEN count(*) >= 4 THEN greatest(0.3, least(0.6, 5 / count(*))) ELSE 1.0 END * count(*) + 1e-10)))::BIGINT AS k FROM s)",
        "r AS (SELECT a.i, list_sort(list(abs(a.x - b.x)))[any_value(k)] AS reach FROM s a, s b, k GROUP BY a.i)",
        "p AS (SELECT a.i, b.i AS j, a.x AS xi, b.x AS xj, b.y AS yj, CASE WHEN abs(a.x - b.x) < reach * 0.999 THEN (1 - (abs(a.x - b.x) / reach) ** 3) ** 3 ELSE 0 END AS tri FROM s a JOIN r USING (i), s b)",
        "b0 AS (SELECT i AS j, 1.0::DOUBLE AS robust FROM s)",
    ]
    for t in range(4):
        steps.append(f"w{t} AS (SELECT p.*, tri * robust AS w FROM p JOIN b{t} USING (j)), m{t} AS (SELECT i, sum(w) AS total, sum(w * xj) / sum(w) AS mx, sum(w * yj) / sum(w) AS my FROM w{t} GROUP BY i)")
        steps.append(f"""f{t} AS (SELECT i, any_value(my) + CASE WHEN sum(w * (xj - mx) ** 2) / any_value(total) > 1e-12 THEN sum(w * (xj - mx) * (yj - my)) / sum(w * (xj - mx) ** 2) ELSE 0 END * (any_value(xi) - any_value(mx)) AS fit FROM w{t} JOIN m{t} USING (i) GROUP BY i),
 e{t} AS (SELECT i, period, y, fit, y - fit AS rest FROM s JOIN f{t} USING (i)), z{t} AS (SELECT 6 * median(abs(rest)) AS scale FROM e{t}), b{t + 1} AS (SELECT i AS j, CASE WHEN abs(rest) < scale THEN (1 - (rest / scale) ** 2) ** 2 ELSE 0 END AS robust FROM e{t}, z{t})""")
    return f""", {', '.join(steps)}, c AS (SELECT median(rest) AS med FROM e3), d AS (SELECT median(abs(rest - med)) AS mad FROM e3, c)
SELECT 'NATION_1' AS geo, period, y AS value, round(fit, 2) AS trend_value, round(rest, 2) AS residual, round(0.6745 * (rest - med) / mad, 4) AS score, abs(0.6745 * (rest - med) / mad) >= 3.5 AS is_outlier FROM e3, c, d"""


@_query("outliers_lowess_long", with_views("obs_month", _lowess_sql()))
def outliers_lowess_long(spark, d):
    rows = A.outliers(V.obs(spark, d, "yyyy-MM"), R, ref_area="NATION_1", method="trend_residual")
    return rows.withColumn("trend_value", F.round("trend_value", 2)).withColumn("residual", F.round("residual", 2))


def _trend_sql(view: str, x: str, where: str = "true") -> str:
    return f""", p AS (SELECT *, {x} AS x FROM {view} WHERE {where}), l AS (SELECT geo, count(*) AS n, var_pop(x) AS vx, var_pop(v) AS vy, covar_pop(x, v) AS c, avg(x) AS mx, avg(v) AS my, arg_min(period, x) AS first_period, arg_max(period, x) AS last_period FROM p GROUP BY geo HAVING count(*) >= 2),
 s AS (SELECT *, CASE WHEN vx = 0 THEN 0.0 ELSE c / vx END AS slope FROM l)
SELECT geo, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(CASE WHEN vx = 0 OR vy = 0 THEN 0.0 ELSE c * c / (vx * vy) END, 4) AS r_squared,
 CASE WHEN abs(slope) < 1e-10 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS direction, n AS n_points, first_period, last_period FROM s"""


#: In billions, so that six digits of a line are within what doubles hold.
_BILLIONS = ", b AS (SELECT * REPLACE (v / 1e9 AS v) FROM obs)"


def _billions(df):
    return df.withColumn("v", F.col("v") / 1e9)


@_query("trend_ols", with_views("obs", _BILLIONS + _trend_sql("b", "period::DOUBLE - 1995").replace("my - slope * mx", "my - slope * (mx + 1995)")))
def trend_ols(spark, d):
    return A.trend(_billions(V.obs(spark, d)), R)


@_query("trend_constant", with_views("obs", _BILLIONS + ", q AS (SELECT * REPLACE (CASE WHEN geo < 'NATION_14' THEN 4.0 ELSE v END AS v) FROM b)" + _trend_sql("q", "period::DOUBLE", "geo < 'NATION_3' AND (geo <> 'NATION_10' OR period = '1998')")))
def trend_constant(spark, d):
    df = _billions(V.obs(spark, d)).where("geo < 'NATION_3' AND (geo <> 'NATION_10' OR period = '1998')")
    return A.trend(df.withColumn("v", F.when(F.col("geo") < "NATION_14", 4.0).otherwise(F.col("v"))), R)


@_query("benchmark_percentile", with_views("obs", """, p AS (SELECT geo, v FROM obs WHERE period = '1998'), s AS (SELECT count(*) AS n, avg(v) AS mean, median(v) AS med, coalesce(stddev_samp(v), 0.0) AS sd FROM p),
 a AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest(['NATION_1', 'NATION_7', 'NATION_14', 'NOWHERE']) AS geo)
SELECT pos::INTEGER AS pos, a.geo, v AS value, CASE WHEN v IS NOT NULL THEN round(((SELECT count(*) FROM p q WHERE q.v < p.v) + 0.5 * (SELECT count(*) FROM p q WHERE q.v = p.v)) / n * 100, 1) END AS percentile,
 round(CASE WHEN v IS NULL THEN NULL WHEN sd = 0 THEN 0.0 ELSE (v - mean) / sd END, 4) AS z_score, round(v - mean, 4) AS vs_mean, round(v - med, 4) AS vs_median FROM a LEFT JOIN p ON p.geo = a.geo CROSS JOIN s"""))
def benchmark_percentile(spark, d):
    return A.benchmark(V.obs(spark, d), R, REFS, "1998")


@_query("coverage_pct", with_views("obs_raw", f""", {_dirty_sql}, o AS (SELECT * FROM parsed WHERE v IS NOT NULL)
SELECT geo, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period, round(count(DISTINCT period) / (SELECT count(DISTINCT period) FROM o) * 100, 1) AS coverage_pct, (SELECT count(DISTINCT period) FROM o) AS total_periods FROM o GROUP BY geo"""))
def coverage_pct(spark, d):
    return A.coverage(_dirty(spark, d), R)


@_query("join_indicators", with_views("obs obs2", "SELECT coalesce(a.geo, b.geo) AS geo, coalesce(a.period, b.period) AS period, a.geo_name AS label, a.v AS value_1, b.v AS value_2 FROM (SELECT * FROM obs WHERE geo > 'NATION_12') a FULL JOIN (SELECT * FROM obs2 WHERE geo < 'NATION_5') b ON a.geo = b.geo AND a.period = b.period"))
def join_indicators(spark, d):
    return A.join_indicators(V.obs(spark, d).where("geo > 'NATION_12'"), V.obs2(spark, d).where("geo < 'NATION_5'"), R)


@_query("join_counts", with_views("obs obs2", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS n_matched, count(*) FILTER (WHERE b.v IS NULL) AS n_only_1, count(*) FILTER (WHERE a.v IS NULL) AS n_only_2 FROM (SELECT * FROM obs WHERE geo > 'NATION_12') a FULL JOIN (SELECT * FROM obs2 WHERE geo < 'NATION_5') b ON a.geo = b.geo AND a.period = b.period"))
def join_counts(spark, d):
    return A.join_counts(join_indicators(spark, d))


@_query("aggregate_period", with_views("obs", "SELECT period, count(*) AS n_ref_areas, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(sum(v), 4) AS total, min(v) AS min, max(v) AS max, coalesce(round(stddev_samp(v), 4), 0.0) AS std FROM obs GROUP BY period"))
def aggregate_period(spark, d):
    return A.aggregate(V.obs(spark, d), R)


@_query("visualize_merge3", with_views("obs obs2", ", u AS (SELECT period, 0 AS s, v FROM obs UNION ALL SELECT period, 1, v FROM obs2 UNION ALL SELECT period, 2, v FROM obs WHERE geo = 'NATION_1') SELECT period, round(avg(v) FILTER (WHERE s = 0), 4) AS mean_1, round(avg(v) FILTER (WHERE s = 1), 4) AS mean_2, round(avg(v) FILTER (WHERE s = 2), 4) AS mean_3 FROM u GROUP BY period"))
def visualize_merge3(spark, d):
    return A.merge_by_period([V.obs(spark, d), V.obs2(spark, d), V.obs(spark, d).where("geo = 'NATION_1'")], R)
