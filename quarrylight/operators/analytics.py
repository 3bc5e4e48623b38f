"""Analytics over observation rows: geography x period x value, with free dimensions.

Every operator is a lazy DataFrame function. Arrival order is a column (`order`), so first and last of duplicates are
aggregates (min_by, max_by) that combine before a shuffle; only results of bounded size are numbered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.scalar import parse_obs, period_to_numeric


@dataclass(frozen=True)
class Roles:
    """Which columns play which part; label may be absent."""

    geo: str = "geo"
    period: str = "period"
    value: str = "v"
    order: str = "row_ord"
    label: str | None = "geo_name"

    def missing(self) -> list[str]:
        named = {"geography": self.geo, "time_period": self.period, "observation_value": self.value}
        return [k for k, c in named.items() if not c]


def require(roles: Roles, idno: str = "") -> None:
    if roles.missing():
        raise ValueError(f"Schema for '{idno}' is missing required columns: [{', '.join(roles.missing())}]")


def where_dimensions(df: DataFrame, dimensions: dict | None) -> DataFrame:
    """Rows equal, as text, in every given dimension; an absent column matches nothing."""
    if not dimensions:
        return df
    tests = [F.col(c).cast("string") == F.lit(str(x)) if c in df.columns else F.lit(False) for c, x in dimensions.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def _rows(df: DataFrame, roles: Roles, dimensions: dict | None = None, period: str | None = None, refs: list[str] | None = None) -> DataFrame:
    """geo, period, v (parsed), ord, label of the rows that pass the filters."""
    require(roles)
    df = where_dimensions(df, dimensions)
    if period is not None:
        df = df.where(F.col(roles.period) == period)
    if refs is not None:
        df = df.where(F.col(roles.geo).isin(refs))
    label = F.col(roles.label) if roles.label else F.lit(None).cast("string")
    return df.select(F.col(roles.geo).alias("geo"), F.col(roles.period).alias("period"), parse_obs(F.col(roles.value)).alias("v"), F.col(roles.order).alias("ord"), label.alias("label"))


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where("v IS NOT NULL AND coalesce(geo, '') <> ''")


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    return _valid(rows).groupBy(*keys).agg(F.min_by("v", "ord").alias("v"), F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label"))


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    return _valid(rows).groupBy(*keys).agg(F.max_by("v", "ord").alias("v"), F.min_by("label", "ord").alias("label"))


def label_map(df: DataFrame, roles: Roles) -> DataFrame:
    """geo and its first label."""
    return _rows(df, roles).where("label IS NOT NULL").groupBy("geo").agg(F.min_by("label", "ord").alias("label"))


def codelist(df: DataFrame, code: str, label: str, order: str, max_entries: int | None = None) -> DataFrame:
    """Distinct codes with their first labels, over all rows or the first max_entries by arrival."""
    rows = df.select(F.col(code).alias("code"), F.col(label).alias("label"), F.col(order).alias("ord")).where("code IS NOT NULL")
    if max_entries is not None:
        rows = rows.orderBy("ord").limit(max_entries)
    return rows.groupBy("code").agg(F.min_by("label", "ord").alias("label"))


def rank(df: DataFrame, roles: Roles, period: str, n: int = 10, ascending: bool = False, dimensions: dict | None = None) -> DataFrame:
    """The n highest (or lowest) places of a period; ties keep arrival order and do not share a rank."""
    found = _first(_rows(df, roles, dimensions, period), "geo")
    order = [F.asc("v") if ascending else F.desc("v"), F.asc("ord")]
    top = found.orderBy(*order).limit(n)
    total = found.agg(F.count("*")).scalar()
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "geo", "label", F.col("v").alias("value"), total.alias("total_ref_areas"))


def extremes(df: DataFrame, roles: Roles, dimensions: dict | None = None) -> DataFrame:
    """The highest and the lowest observation, the earliest of equals, and how many are valid: one row."""
    rows = _valid(_rows(df, roles, dimensions))
    pick = F.struct("geo", "period", "v")
    hi, lo = F.max_by(pick, F.struct(F.col("v"), -F.col("ord"))), F.min_by(pick, F.struct(F.col("v"), F.col("ord")))
    out = rows.agg(hi.alias("hi"), lo.alias("lo"), F.count("*").alias("total_observations"))
    return out.select("hi.geo", "hi.period", "hi.v", "lo.geo", "lo.period", "lo.v", "total_observations").toDF("max_geo", "max_period", "max_value", "min_geo", "min_period", "min_value", "total_observations")


def compare(df: DataFrame, roles: Roles, refs: list[str], dimensions: dict | None = None) -> DataFrame:
    """Period x requested places; of duplicates the first row counts, even a null one; an empty period is ''."""
    rows = _rows(df, roles, dimensions, refs=refs).withColumn("period", F.coalesce("period", F.lit("")))
    return rows.groupBy("period").pivot("geo", refs).agg(F.min_by("v", "ord"))


def unpivoted(wide: DataFrame, refs: list[str]) -> DataFrame:
    return wide.unpivot("period", refs, "geo", "value")


def summarize(df: DataFrame, roles: Roles, period: str, dimensions: dict | None = None) -> DataFrame:
    """Count, range, mean, median and sample deviation (0 of a single value) of a period: one row."""
    rows = _valid(_rows(df, roles, dimensions, period))
    lo, hi = F.struct(F.col("v"), F.col("ord")), F.struct(F.col("v"), -F.col("ord"))
    return rows.agg(
        F.count("*").alias("count"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.round(F.avg("v"), 4).alias("mean"),
        F.median("v").alias("median"),
        F.when(F.count("*") > 0, F.coalesce(F.round(F.stddev_samp("v"), 4), F.lit(0.0))).alias("std"),
        F.min_by("geo", lo).alias("min_geo"),
        F.max_by("geo", hi).alias("max_geo"),
    )


def growth(df: DataFrame, roles: Roles, base: str, end: str, refs: list[str] | None = None, dimensions: dict | None = None) -> DataFrame:
    """Change between two periods of each place with either; of duplicates the last counts; no percentage of 0."""
    rows = _valid(_rows(df, roles, dimensions, refs=refs)).where(F.col("period").isin(base, end))
    at = lambda p: F.max_by(F.when(F.col("period") == p, F.col("v")), F.when(F.col("period") == p, F.col("ord")))
    both = rows.groupBy("geo").agg(at(base).alias("base_value"), at(end).alias("end_value"))
    change = F.col("end_value") - F.col("base_value")
    share = F.when(F.col("base_value") != 0, change / F.abs("base_value") * 100)
    return both.select("geo", "base_value", "end_value", change.alias("absolute_change"), share.alias("pct_change"))


def correlate_pairs(one: DataFrame, two: DataFrame, roles: Roles, period: str) -> DataFrame:
    """Places with a value in both indicators; of duplicates the last counts."""
    a, b = (_last(_rows(x, roles, None, period), "geo").select("geo", F.col("v").alias(n)) for x, n in ((one, "x"), (two, "y")))
    return a.join(b, "geo")


def pearson(x: Column, y: Column) -> Column:
    """Correlation, null of fewer than two pairs or of a constant side."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count("*") >= 2, F.try_divide(F.covar_pop(x, y), spread))


def correlate(one: DataFrame, two: DataFrame, roles: Roles, period: str) -> DataFrame:
    return correlate_pairs(one, two, roles, period).agg(F.round(pearson(F.col("x"), F.col("y")), 6).alias("r"), F.count("*").alias("n"))


#: Default thresholds.
Z_THRESHOLD, IQR_THRESHOLD, MAD_FACTOR = 3.5, 0.0, 0.6745


def _scored(values: DataFrame, method: str, threshold: float | None) -> DataFrame:
    """values: geo, period, v, label, ord of one series. Centre and spread come as scalar subqueries of aggregates."""
    if method == "iqr":
        limit = IQR_THRESHOLD if threshold is None else threshold
        stats = values.agg(F.percentile("v", F.lit(0.25)).alias("q1"), F.percentile("v", F.lit(0.75)).alias("q3"), F.avg("v").alias("centre"), F.stddev_pop("v").alias("spread"))
        out = values.join(F.broadcast(stats), how="cross")
        gap = F.col("q3") - F.col("q1")
        high, low = F.col("q3") + 1.5 * gap, F.col("q1") - 1.5 * gap
        score = F.when(gap == 0, 0.0).when(F.col("v") > high, (F.col("v") - high) / gap).when(F.col("v") < low, (low - F.col("v")) / gap).otherwise(0.0)
        return out.select("geo", "period", "label", F.col("v").alias("value"), F.round(score, 4).alias("score"), (score > limit).alias("is_outlier"), F.round("centre", 4).alias("centre"), F.round("spread", 4).alias("spread"))
    limit = Z_THRESHOLD if threshold is None else threshold
    middle = values.agg(F.median("v").alias("med"), F.stddev_pop("v").alias("sd"))
    out = values.join(F.broadcast(middle), how="cross")
    spread = out.agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    out = out.join(F.broadcast(spread), how="cross")
    away = F.col("v") - F.col("med")
    z = F.when(F.col("mad") != 0, MAD_FACTOR * away / F.col("mad")).when(F.col("sd") != 0, away / F.col("sd")).otherwise(0.0)
    return out.select("geo", "period", "label", F.col("v").alias("value"), F.round(z, 4).alias("score"), (F.abs(z) >= limit).alias("is_outlier"), F.round("med", 4).alias("centre"), F.round("mad", 4).alias("spread"))


def outliers(df: DataFrame, roles: Roles, period: str | None = None, ref_area: str | None = None, method: str = "modified_zscore", threshold: float | None = None, dimensions: dict | None = None) -> DataFrame:
    """Scores of the places of a period, or of the periods of a place (exactly one is given)."""
    if (period is None) == (ref_area is None):
        raise ValueError("give exactly one of period and ref_area")
    rows = _rows(df, roles, dimensions, period, None if ref_area is None else [ref_area])
    keys = ("geo", "period")
    if method == "trend_residual" and ref_area is not None:
        return trend_residuals(_first(rows, *keys), threshold)
    return _scored(_first(rows, *keys), method, threshold)


def trend_residuals(values: DataFrame, threshold: float | None = None) -> DataFrame:
    """Residuals from a local regression over the periods of each place, scored like modified z-scores."""
    limit = Z_THRESHOLD if threshold is None else threshold

    def fit(pdf):
        import numpy as np

        from quarrylight.functions.lowess import lowess

        pdf = pdf.sort_values("period")
        x = pdf["x"].to_numpy(float)
        x = np.where(np.isnan(x) | (x == 0), np.arange(len(x), dtype=float), x)
        y = pdf["v"].to_numpy(float)
        n = len(y)
        fitted = lowess(x, y, max(0.3, min(0.6, 5 / n)) if n >= 4 else 1.0)
        rest = y - fitted
        med = np.median(rest)
        mad = np.median(np.abs(rest - med))
        sd = rest.std()
        z = MAD_FACTOR * (rest - med) / mad if mad else (rest - med) / sd if sd else np.zeros(n)
        return pdf.assign(value=y, trend_value=fitted.round(6), residual=rest.round(6), score=z.round(4), is_outlier=np.abs(z) >= limit)[["geo", "period", "value", "trend_value", "residual", "score", "is_outlier"]]

    series = values.select("geo", "period", "v", period_to_numeric(F.col("period")).alias("x"))
    return series.groupBy("geo").applyInPandas(fit, "geo string, period string, value double, trend_value double, residual double, score double, is_outlier boolean")


#: Slopes below this are stable.
FLAT = 1e-10


def trend(df: DataFrame, roles: Roles, refs: list[str] | None = None, dimensions: dict | None = None) -> DataFrame:
    """Least-squares line of each place with two points or more."""
    rows = _valid(_rows(df, roles, dimensions, refs=refs)).withColumn("x", period_to_numeric(F.col("period"))).where("x IS NOT NULL")
    x, y = F.col("x"), F.col("v")
    lines = rows.groupBy("geo").agg(
        F.count("*").alias("n"),
        F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"),
        F.covar_pop(x, y).alias("cxy"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.min_by("period", F.struct("x", "ord")).alias("first_period"),
        F.max_by("period", F.struct("x", "ord")).alias("last_period"),
    )
    slope = F.when(F.col("vx") == 0, 0.0).otherwise(F.try_divide("cxy", "vx"))
    r2 = F.when((F.col("vx") == 0) | (F.col("vy") == 0), 0.0).otherwise(F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")))
    turn = F.when(F.abs("slope") < FLAT, "stable").when(F.col("slope") > 0, "improving").otherwise("declining")
    out = lines.where("n >= 2").withColumn("slope", slope)
    return out.select("geo", F.round("slope", 6).alias("slope"), F.round(F.col("my") - F.col("slope") * F.col("mx"), 6).alias("intercept"), F.round(r2, 4).alias("r_squared"), turn.alias("direction"), F.col("n").alias("n_points"), "first_period", "last_period")


def benchmark(df: DataFrame, roles: Roles, refs: list[str], period: str, dimensions: dict | None = None) -> DataFrame:
    """Requested places against all places of a period; a missing place has nulls."""
    peers = _first(_rows(df, roles, dimensions, period), "geo").select("geo", "v")
    spark = df.sparkSession
    asked = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "pos int, geo string")
    stats = peers.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("med"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    mine = asked.join(peers, "geo", "left")
    # the requested list is a parameter: peers are counted against it, not against each other
    below = mine.where("v IS NOT NULL").select("geo", F.col("v").alias("own")).join(peers.select(F.col("v").alias("peer")), F.col("peer") <= F.col("own"))
    counts = below.groupBy("geo").agg(F.count_if(F.col("peer") < F.col("own")).alias("below"), F.count_if(F.col("peer") == F.col("own")).alias("equal"))
    out = mine.join(counts, "geo", "left").join(F.broadcast(stats), how="cross")
    z = F.when(F.col("sd") == 0, 0.0).otherwise(F.try_divide(F.col("v") - F.col("mean"), "sd"))
    rank_ = (F.col("below") + 0.5 * F.col("equal")) / F.col("n") * 100
    return out.select(
        "pos",
        "geo",
        F.col("v").alias("value"),
        F.round(rank_, 1).alias("percentile"),
        F.when(F.col("v").isNotNull(), F.round(z, 4)).alias("z_score"),
        F.round(F.col("v") - F.col("mean"), 4).alias("vs_mean"),
        F.round(F.col("v") - F.col("med"), 4).alias("vs_median"),
    )


def coverage(df: DataFrame, roles: Roles, dimensions: dict | None = None) -> DataFrame:
    """Periods with a value of each place, against all periods with one."""
    rows = _valid(_rows(df, roles, dimensions)).where("coalesce(period, '') <> ''")
    total = rows.agg(F.count_distinct("period")).scalar()
    each = rows.groupBy("geo").agg(F.count_distinct("period").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    return each.select("geo", "n_periods", "first_period", "last_period", F.round(F.col("n_periods") / total * 100, 1).alias("coverage_pct"), total.alias("total_periods"))


def join_indicators(one: DataFrame, two: DataFrame, roles: Roles) -> DataFrame:
    """Full outer join of two indicators on place and period; of duplicates the first valid one counts."""
    a = _first(_rows(one, roles), "geo", "period").select("geo", "period", F.col("label"), F.col("v").alias("value_1"))
    b = _first(_rows(two, roles), "geo", "period").select("geo", "period", F.col("v").alias("value_2"))
    return a.join(b, ["geo", "period"], "full")


def join_counts(joined: DataFrame) -> DataFrame:
    """One row of a joined pair: all rows, those with both values, and those with one of them alone."""
    one, two = F.col("value_1").isNotNull(), F.col("value_2").isNotNull()
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(one & two).alias("n_matched"), F.count_if(one & ~two).alias("n_only_1"), F.count_if(two & ~one).alias("n_only_2"))


def aggregate(df: DataFrame, roles: Roles, refs: list[str] | None = None, dimensions: dict | None = None) -> DataFrame:
    """Figures of each period over all valid rows, duplicates included."""
    rows = _valid(_rows(df, roles, dimensions, refs=refs))
    return rows.groupBy("period").agg(
        F.count("*").alias("n_ref_areas"),
        F.round(F.avg("v"), 4).alias("mean"),
        F.round(F.median("v"), 4).alias("median"),
        F.round(F.sum("v"), 4).alias("total"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.coalesce(F.round(F.stddev_samp("v"), 4), F.lit(0.0)).alias("std"),
    )


def merge_by_period(series: list[DataFrame], roles: Roles) -> DataFrame:
    """Mean of each of up to three indicators side by side, by period, with four digits as in `aggregate`."""
    rows = None
    for k, df in enumerate(series):
        part = _valid(_rows(df, roles)).select("period", F.lit(k).alias("slot"), "v")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("period").agg(*(F.round(F.avg(F.when(F.col("slot") == k, F.col("v"))), 4).alias(f"mean_{k + 1}") for k in range(len(series))))
