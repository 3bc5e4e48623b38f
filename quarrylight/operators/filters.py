"""Filters beside those of the study search: by any facet key, by number and date strings, and over nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that have a column of their own; every other key is a facet.
FIXED = frozenset({"type", "idno", "idnos", "geographies", "authors", "periodicity", "document_type", "source", "year_start", "year_end"})


def wanted(values) -> list[str]:
    """Filter values as distinct texts in order; nulls and blanks are no values."""
    values = values if isinstance(values, (list, tuple, set)) else [values]
    return list(dict.fromkeys(t for v in values if v is not None and (t := str(v).strip())))


def dynamic_tests(filters: dict, facets: Column) -> list[Column]:
    """A predicate for each key that is a facet: one of its values is wanted. A key without values constrains nothing."""
    out = []
    for key, values in filters.items():
        if key not in FIXED and (some := wanted(values)):
            out.append(F.coalesce(F.arrays_overlap(F.try_element_at(facets, F.lit(key)), F.array(*map(F.lit, some))), F.lit(False)))
    return out


def dynamic(df: DataFrame, filters: dict, facets: str = "facets") -> DataFrame:
    for test in dynamic_tests(filters, F.col(facets)):
        df = df.where(test)
    return df


def resolve_facets(requested: list[str] | None, static: list[str], registered: list[str]) -> tuple[list[str], list[str]]:
    """The requested facets that exist; all of them, sorted, if none is requested."""
    if not requested:
        return sorted(static), sorted(registered)
    return [f for f in requested if f in static], [f for f in requested if f in registered and f not in static]


def count_test(text: str, column: Column) -> Column:
    """'>100', '<50', '=200' or '200' as a test of a count."""
    text = text.strip()
    sign, number = (text[0], text[1:]) if text.startswith(("<", ">", "=")) else ("=", text)
    if not number.strip().isdigit():
        raise ValueError(f"{text!r} is no count filter")
    n = F.lit(int(number))
    return column > n if sign == ">" else column < n if sign == "<" else column == n


def date_test(text: str, column: Column) -> Column:
    """'YYYY/MM/DD' or 'YYYY/MM/DD-YYYY/MM/DD', both ends included, as a test of a date."""
    days = [d.strip().replace("/", "-") for d in text.split("-")]
    if len(days) > 2 or any(len(d) != 10 for d in days):
        raise ValueError(f"{text!r} is no date filter")
    if days[0] > days[-1]:
        raise ValueError("created_from is after created_to")
    return column.between(F.lit(days[0]).cast("date"), F.lit(days[-1]).cast("date"))


def pruned_json(columns: list[Column]) -> Column:
    """A record as JSON without null fields and without records that are empty then."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def pruned(column: Column, kind: T.StructType) -> Column:
    """A nested record, null where all that it has is null."""
    fields = [pruned(column[f.name], f.dataType).alias(f.name) if isinstance(f.dataType, T.StructType) else column[f.name].alias(f.name) for f in kind]
    some = [(pruned(column[f.name], f.dataType) if isinstance(f.dataType, T.StructType) else column[f.name]).isNotNull() for f in kind]
    any_ = some[0]
    for x in some[1:]:
        any_ = any_ | x
    return F.when(any_, F.struct(*fields))
