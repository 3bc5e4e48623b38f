"""Study search without text ranking: filters, facets, sorts, keyset pages, collapse, explain, semi-joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.scalar import fold, title_words

#: How many values a filter may list.
LIMITS = {"types": 20, "countries": 300, "regions": 300, "collections": 100, "form_ids": 50, "data_class_ids": 50, "tags": 50, "topics": 500, "databases": 100, "nations": 300, "sids": 5000}
#: The column of each filter whose values are alternatives; True if it is an array.
ANY_OF = {
    "types": ("dataset_type", False),
    "countries": ("countries", True),
    "regions": ("regions", True),
    "collections": ("repositories", True),
    "form_ids": ("form_id", False),
    "data_class_ids": ("data_class_id", False),
    "tags": ("tags", True),
    "topics": ("topics", True),
    "databases": ("databases", True),
    "nations": ("nation", False),
    "sids": ("sid", False),
}
POSITIVE = ("countries", "regions", "form_ids", "data_class_ids", "topics", "sids")


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _any_of(column: Column, values: list) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, values)))


def _bounds(key: str, value: tuple, least: int, most: int | None = None) -> tuple:
    """The two ends of a range, either of which may be open."""
    for x in value:
        if x is not None and (x < least or most is not None and x > most):
            raise ValueError(f"{key}: {x} is out of range")
    low, high = value
    if low is not None and high is not None and low > high:
        raise ValueError(f"{key}: the lower bound is above the upper one")
    return low, high


def facet_tests(filters: dict, columns: dict[str, str] | None = None) -> dict[str, Column]:
    """One predicate for each filter, and `fq_<name>` for each user facet; an empty list is no constraint, an unknown key
    is an error. columns: other places of the columns, so that one set of filters serves tables of any layout."""
    at = lambda name: F.col((columns or {}).get(name, name))
    ends = {"years": ("year_from", "year_to"), "created": ("created_from", "created_to")}
    filters = {k: v for k, v in filters.items() if v is not None}
    for name, (low, high) in ends.items():
        if low in filters or high in filters:
            filters[name] = (filters.pop(low, None), filters.pop(high, None))
    out = {}
    for key, value in filters.items():
        if key in ANY_OF:
            value = list(dict.fromkeys(value))
            if len(value) > LIMITS[key]:
                raise ValueError(f"{key}: at most {LIMITS[key]} values")
            if key in POSITIVE and any(v <= 0 for v in value):
                raise ValueError(f"{key}: ids are positive")
            if value:
                name, several = ANY_OF[key]
                out[key] = _any_of(at(name), value) if several else at(name).isin(value)
        elif key == "repository":
            out[key] = F.array_contains(at("repositories"), value)
        elif key == "facets":
            for name, terms in value.items():
                if terms:
                    out[f"fq_{name}"] = _any_of(F.try_element_at(at("user_facets"), F.lit(name)), list(dict.fromkeys(terms)))
        elif key == "years":
            low, high = _bounds(key, value, 1, 9999)
            # one single year has to satisfy both bounds
            out[key] = F.exists(at("years"), lambda y: (y >= (low if low is not None else 1)) & (y <= (high if high is not None else 9999)))
        elif key == "created":
            low, high = _bounds(key, value, 0)
            tests = [at("created") >= low] if low is not None else []
            out[key] = _all([*tests, *([at("created") <= high] if high is not None else [])])
        elif key == "published":
            out[key] = at("published_mod") != 0 if value else F.lit(True)
        else:
            raise ValueError(f"unknown filter {key}")
    return {key: F.coalesce(test, F.lit(False)) for key, test in out.items()}


def filter_studies(df: DataFrame, **filters) -> DataFrame:
    return df.where(_all(list(facet_tests(filters).values())))


def type_counts(df: DataFrame, **filters) -> DataFrame:
    """Studies of each type; the types filter does not narrow these counts."""
    return filter_studies(df, **{k: v for k, v in filters.items() if k != "types"}).groupBy("dataset_type").agg(F.count_distinct("sid").alias("n"))


def facets(df: DataFrame, columns: dict[str, Column], filters: dict, size: int = 500, selected: dict[str, list[str]] | None = None) -> DataFrame:
    """Disjunctive facet counts in one scan: each facet under all filters but its own.

    Values by count, then name; `size` of them and the selected ones; `more` tells that some were left out.
    """
    tests = facet_tests(filters)
    parts = F.array(*(F.struct(F.lit(name).alias("facet"), values.cast("array<string>").alias("values"), _all([t for k, t in tests.items() if k != name]).alias("ok")) for name, values in columns.items()))
    rows = df.select(F.explode(parts).alias("p")).where("p.ok").select("p.facet", F.explode(F.array_distinct("p.values")).alias("value"))
    counts = rows.groupBy("facet", "value").agg(F.count("*").alias("n"))
    # only `size` values of a facet reach its task: the rank limit is applied before the shuffle
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    listed = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= size).drop("rn")
    if selected:
        chosen = reduce(lambda a, b: a | b, [(F.col("facet") == k) & F.col("value").isin(v) for k, v in selected.items()])
        listed = listed.unionByName(counts.where(chosen)).distinct()
    more = counts.groupBy("facet").agg((F.count("*") > size).alias("more"))
    return listed.join(F.broadcast(more), "facet").select("facet", "value", "n", "more")  # a row for each facet


def year_range(df: DataFrame, filters: dict) -> DataFrame:
    """The years facet: least and greatest year under all filters but its own."""
    tests = facet_tests({k: v for k, v in filters.items() if k != "years"})
    return df.where(_all(list(tests.values()))).agg(F.min(F.array_min("years")).alias("min_year"), F.max(F.array_max("years")).alias("max_year"))


def flat_facets(df: DataFrame, columns: dict[str, Column], size: int = 200) -> DataFrame:
    """Counts of rows for each value of each field, the most frequent `size` of each."""
    parts = F.array(*(F.struct(F.lit(name).alias("facet"), values.cast("array<string>").alias("values")) for name, values in columns.items()))
    counts = df.select(F.explode(parts).alias("p")).select("p.facet", F.explode("p.values").alias("value")).where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("rn") <= size).drop("rn")


#: Sort keys by name: (column, ascending). Missing values are last either way.
SORTS = {"title": ("title_sort", True), "nation": ("nation_sort", True), "year": ("year_start", False), "popularity": ("views", False), "created": ("created", False), "changed": ("changed", False), "relevance": ("score", False)}
#: Names that the catalog's own search has for these sorts.
CATALOG_SORTS = {"rank": "relevance", "relevance": "relevance", "title": "title", "nation": "nation", "country": "nation", "year": "year", "created": "created", "changed": "changed", "popularity": "popularity", "total_views": "popularity"}
TIES = (("year_start", False), ("title_sort", True), ("sid", True))


def sort_keys(by: str, ascending: bool | None = None) -> list[tuple[str, bool]]:
    column, default = SORTS[by]
    return [(column, default if ascending is None else ascending), *((c, a) for c, a in TIES if c != column)]


def catalog_sort_keys(by: str, order: str | None = None) -> list[tuple[str, bool]]:
    """Sort keys by a name of the catalog's search and its order, asc or desc (or the sort's own)."""
    if by not in CATALOG_SORTS or order not in (None, "asc", "desc"):
        raise ValueError(f"no sort {by} {order}")
    return sort_keys(CATALOG_SORTS[by], None if order is None else order == "asc")


def with_sort_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("title_sort", F.substring(fold(F.col("title")), 1, 256)).withColumn("nation_sort", fold(F.col("nation")))


def ordering(keys: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Nulls last; reversed, every key and the place of nulls flip."""
    if reverse:
        return [F.col(c).desc_nulls_first() if a else F.col(c).asc_nulls_first() for c, a in keys]
    return [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in keys]


def beyond(keys: list[tuple[str, bool]], values: list, before: bool = False) -> Column:
    """Rows after (or before) the row with these key values in the nulls-last order."""
    (column, ascending), value = keys[0], values[0]
    c = F.col(column)
    if value is None:
        past, same = (c.isNotNull() if before else F.lit(False)), c.isNull()
    else:
        forward = ascending != before
        past = c > F.lit(value) if forward else c < F.lit(value)
        past = past if before else past | c.isNull()
        same = c == F.lit(value)
    past, same = F.coalesce(past, F.lit(False)), F.coalesce(same, F.lit(False))
    return past if len(keys) == 1 else past | (same & beyond(keys[1:], values[1:], before))


def page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, values: list | None = None, before: bool = False) -> DataFrame:
    """A page of sorted rows by keyset: no offset is scanned."""
    if values is not None:
        df = df.where(beyond(keys, values, before))
    out = df.orderBy(*ordering(keys, before)).limit(limit)
    return out.orderBy(*ordering(keys)) if before else out


def collapse(df: DataFrame, key: str, score: str, tie: str, inner: int) -> DataFrame:
    """The best row of each key with its best `inner` rows; a missing key is a group of its own."""
    group = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.col(tie).cast("string")))
    best = Window.partitionBy("_group").orderBy(F.desc(score), F.asc(tie))
    top = df.withColumn("_group", group).withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= inner)
    hits = F.transform(F.array_sort(F.collect_list(F.struct("_rn", tie))), lambda x: x[tie])
    return top.groupBy("_group").agg(F.max(F.when(F.col("_rn") == 1, F.col(tie))).alias(tie), F.max(score).alias(score), hits.alias("inner_hits")).drop("_group")


def explain(df: DataFrame, tests: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """For each named test (expected text, actual, whether it matches) of the rows of df, and whether all match."""
    parts = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(e).alias("expected"), a.cast("string").alias("actual"), F.coalesce(m, F.lit(False)).alias("matched")) for k, (e, a, m) in tests.items()))
    every = _all([F.coalesce(m, F.lit(False)) for _, _, m in tests.values()])
    return df.select("chunk_id", F.explode(parts).alias("p"), every.alias("all_matched")).select("chunk_id", "p.*", "all_matched")


def exact_idno(df: DataFrame, query: str) -> DataFrame:
    """Studies whose idno is the query, but for case and marks."""
    return df.where(fold(F.col("idno")) == fold(F.lit(query.strip().strip('"'))))


def idno_first(df: DataFrame, query: str, search) -> DataFrame:
    """The rows whose idno is the query, if it looks like one and there are any; else what `search(query)` finds, as a
    plain word looks like an idno too."""
    if re.fullmatch(r"[A-Za-z0-9._-]{3,128}", query.strip()):
        exact = exact_idno(df, query)
        if not exact.isEmpty():
            return exact
    return search(query)


#: Words of a query that do not count for title matches.
STOPWORDS = tuple(
    """
    a able about across after all almost also am among an and any are as at be because been but by can cannot
    could dear did do does either else ever every for from get got had has have he her hers him his how however
    i if in into is it its just least let like likely may me might most must my neither no nor not of off often
    on only or other our own rather said say says she should since so some than that the their them then there
    these they this tis to too twas us wants was we were what when where which while who whom why will with
    would yet you your
    """.split()
)


def title_complete(df: DataFrame, query: str) -> DataFrame:
    """Studies whose title has all words of a query of three words or more."""
    needed = F.array_except(F.array_distinct(title_words(F.lit(query))), F.array(*map(F.lit, STOPWORDS)))
    return df.where((F.size(needed) >= 3) & (F.size(F.array_except(needed, title_words(F.coalesce("title", F.lit(""))))) == 0))


def variables_of(variables: DataFrame, studies: DataFrame, **filters) -> DataFrame:
    """Variables of the studies that pass the filters."""
    return variables.join(filter_studies(studies, **filters).select("sid"), "sid", "left_semi")


def citation_search(citations: DataFrame, found: DataFrame, query: str, boost: float = 10.0) -> DataFrame:
    """(citation_id, score): text matches (key, score) and the citations whose DOI is the query, case aside, added up.

    A DOI is a term without a length: its score is `boost` times its idf among the citations that have one.
    """
    same = F.coalesce(fold(F.trim("doi")) == fold(F.trim(F.lit(query))), F.lit(False))
    counts = citations.agg(F.count(F.nullif(F.trim("doi"), F.lit(""))).alias("_n"), F.count_if(same).alias("_d"))
    by_doi = citations.where(same).crossJoin(F.broadcast(counts)).select(F.col("citation_id").alias("key"), (boost * F.ln(1 + (F.col("_n") - F.col("_d") + 0.5) / (F.col("_d") + 0.5))).alias("score"))  # one row of counts
    return found.unionByName(by_doi).groupBy(F.col("key").alias("citation_id")).agg(F.sum("score").alias("score"))
