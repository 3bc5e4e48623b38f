"""Data structure definitions: which column of an indicator's table plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.analytics import Roles

# Types of columns that are no dimensions, and the parts by the type that plays them.
PARTS = {"geo_column": "geography", "time_column": "time_period", "obs_column": "observation_value", "freq_column": "periodicity"}
NO_DIMENSIONS = (*PARTS.values(), "attribute", "indicator_id")
_PAYLOAD = "status string, message string, error string, result struct<components: array<struct<name: string, column_type: string>>>"


def _first(components: Column, test) -> Column:
    return F.get(F.filter(components, test), F.lit(0))["name"]


def label_column(components: Column, code: Column) -> Column:
    """The first attribute whose name holds NAME and the code column's name without its _CODE or _ID."""
    base = F.replace(F.replace(code, F.lit("_CODE"), F.lit("")), F.lit("_ID"), F.lit(""))
    return _first(components, lambda c: (c["column_type"] == "attribute") & (c["name"] != code) & F.contains(c["name"], base) & F.contains(c["name"], F.lit("NAME")))


def bound(payloads: DataFrame, key: str = "idno", payload: str = "payload") -> DataFrame:
    """(idno, geo_column, time_column, obs_column, freq_column, dimensions, label_column, error) of schema payloads in JSON.

    A payload of another status than success has its message as error, one without the three parts that analytics need
    says which are missing.
    """
    p = F.from_json(payload, _PAYLOAD)
    status = F.lower(F.coalesce(F.col("_p.status"), F.lit("")))
    parts = payloads.select(key, p.alias("_p")).select(
        key,
        F.coalesce("_p.result.components", F.array().cast("array<struct<name:string,column_type:string>>")).alias("_c"),
        F.when(F.col("_p").isNull() | ~status.isin("", "success", "ok"), F.concat(F.lit("Schema API error: "), F.coalesce("_p.message", "_p.error", status))).alias("_e"),
    )
    named = parts.select(key, "_c", "_e", *(_of_type(kind).alias(name) for name, kind in PARTS.items()))
    dimensions = F.transform(F.filter("_c", lambda c: ~F.coalesce(c["column_type"].isin(*NO_DIMENSIONS), F.lit(False))), lambda c: c["name"])
    needed = list(PARTS.items())[:3]
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(name).isNull(), kind) for name, kind in needed))), ", ")
    error = F.coalesce("_e", F.when(missing != "", F.concat(F.lit("missing: "), missing)))
    return named.select(key, *PARTS, dimensions.alias("dimensions"), label_column(F.col("_c"), F.col("geo_column")).alias("label_column"), error.alias("error"))


def _of_type(kind: str) -> Column:
    return _first(F.col("_c"), lambda c: c["column_type"] == kind)


def roles_of(schema: DataFrame, idno: str, order: str = "row_ord") -> Roles:
    """The roles of one indicator, for the analytic operators; `order` is the column of arrival."""
    row = schema.where(F.col("idno") == idno).first()
    if row is None or row.error:
        raise ValueError(f"Schema for '{idno}': {row.error if row else 'not found'}")
    return Roles(row.geo_column, row.time_column, row.obs_column, order, row.label_column)
