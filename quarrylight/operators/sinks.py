"""Mutations of stored tables. Each gives the new table (or the report) as a DataFrame; writing it is the caller's step,
by `foreachBatch` or by overwriting the partitions of the keys that are touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delete_sids(table: DataFrame, sids: DataFrame) -> DataFrame:
    """The table without these studies; ids that are no positive numbers are ignored."""
    return table.join(sids.where("sid > 0").select("sid").distinct(), "sid", "left_anti")


def extract_by_ids(studies: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, status): found or missing, for each requested id."""
    known = studies.select("sid", F.lit(True).alias("_known")).distinct()
    return ids.select("sid").distinct().join(known, "sid", "left").select("sid", F.when(F.col("_known"), "found").otherwise("missing").alias("status"))


def last_of(rows: DataFrame, what: Column, order: str | None) -> DataFrame:
    """(sid, _n): `what` of one row of each study, the last by `order`; without one, that with the greatest content."""
    return rows.groupBy("sid").agg(F.max_by(what, F.col(order) if order else F.xxhash64(F.to_json(F.struct(what)))).alias("_n"))


def partial_update(stored: DataFrame, changes: DataFrame, keep: tuple[str, ...] = ("all_text",), order: str | None = None) -> DataFrame:
    """Stored rows with the changed columns; `keep` columns stay where the change has none. A change of an absent row is
    left out (see `not_indexed`), and of several of one study the last by `order` counts."""
    new = last_of(changes, F.struct(*(c for c in changes.columns if c not in ("sid", order))), order)
    joined = stored.join(new, "sid", "left")

    def merged(c: str) -> Column:
        if c in ("sid", order) or c not in changes.columns:
            return F.col(c)
        fresh = F.col("_n").getField(c)
        return (F.coalesce(fresh, F.col(c)) if c in keep else F.when(F.col("_n").isNotNull(), fresh).otherwise(F.col(c))).alias(c)

    return joined.select(*map(merged, stored.columns))


def not_indexed(stored: DataFrame, changes: DataFrame) -> DataFrame:
    return changes.join(stored.select("sid"), "sid", "left_anti").select("sid")


def sync_filters(chunks: DataFrame, filters: DataFrame, order: str | None = None) -> DataFrame:
    """Chunks with the facets of their study replaced; filters: (sid, facets), of several rows the last by `order`."""
    return chunks.join(last_of(filters, F.col("facets"), order), "sid", "left").withColumn("facets", F.coalesce("_n", "facets")).drop("_n")


def sync_report(chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """(sid, updated_points, found) of a filter sync."""
    counts = chunks.groupBy("sid").agg(F.count("*").alias("n"))
    return filters.select("sid").distinct().join(counts, "sid", "left").select("sid", F.coalesce("n", F.lit(0)).alias("updated_points"), F.col("n").isNotNull().alias("found"))


def backfill_facets(chunks: DataFrame) -> DataFrame:
    """Rows without a facet map get the one that their (key, values) rows spell."""
    empty = F.coalesce(F.size("facets"), F.lit(0)) <= 0
    derived = F.map_from_entries(F.transform("filter_fields", lambda f: F.struct(f["key"], f["values"])))
    return chunks.withColumn("facets", F.when(empty & (F.coalesce(F.size("filter_fields"), F.lit(0)) > 0), derived).otherwise(F.col("facets")))


def put_facets(new: Column, old: Column) -> Column:
    return F.coalesce(new, old)


def patch_facets(new: Column, old: Column) -> Column:
    """Key by key: a new key replaces the old one, an empty list removes it."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_filter(F.map_concat(kept, new), lambda _, v: F.size(v) > 0)


def replace_per_study(stored: DataFrame, fresh: DataFrame, studies: DataFrame) -> DataFrame:
    """Rows of the studies are replaced by fresh ones, all of them, and others stay."""
    touched = studies.select("sid").distinct()
    return stored.join(touched, "sid", "left_anti").unionByName(fresh.join(touched, "sid", "left_semi"))


def sync_by_status(stored: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Upserts what was fetched and deletes what the source no longer has; fetched has the columns of stored and `status` (200, 404, other: left alone)."""
    seen = fetched.where("status IN (200, 404)")
    return stored.join(seen.select(key), key, "left_anti").unionByName(seen.where("status = 200").select(*stored.columns))


def outdated_fields(live: T.StructType, expected: T.StructType, path: str = "") -> list[str]:
    """Dotted paths that a live schema lacks or has in another type."""
    out = []
    have = {f.name: f.dataType for f in live}
    for f in expected:
        here = f"{path}{f.name}"
        if f.name not in have:
            out.append(here)
        elif isinstance(f.dataType, T.StructType) and isinstance(have[f.name], T.StructType):
            out += outdated_fields(have[f.name], f.dataType, f"{here}.")
        elif have[f.name] != f.dataType:
            out.append(here)
    return out


def dimensions(vectors: DataFrame, expected: int, column: str = "embedding") -> DataFrame:
    """One row: vectors, least and greatest size, and how many are not of the expected size."""
    size = F.size(column)
    return vectors.agg(F.count(column).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.count_if(size != expected).alias("drifted"))


def guard_dimensions(vectors: DataFrame, expected: int, column: str = "embedding") -> None:
    if (n := dimensions(vectors, expected, column).first()["drifted"]) > 0:
        raise ValueError(f"{n} vectors do not have {expected} dimensions")


def state_report(asked: DataFrame, written: DataFrame, failed: DataFrame, deleted: DataFrame, unattributed: bool = False) -> DataFrame:
    """(sid, state): deleted, failed or indexed; what was neither is left out, and with an error that no study is to blame for nothing is indexed."""
    marks = None
    for df, name in ((written, "w"), (failed, "f"), (deleted, "d")):
        part = df.select("sid", F.lit(name).alias("mark"))
        marks = part if marks is None else marks.unionByName(part)
    got = marks.groupBy("sid").agg(F.collect_set("mark").alias("m"))
    state = F.when(F.array_contains("m", "d"), "deleted").when(F.array_contains("m", "f"), "failed").when(F.lit(not unattributed), "indexed")
    return asked.select("sid").distinct().join(got, "sid").select("sid", state.alias("state")).where("state IS NOT NULL")


def import_state(studies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sid, state): a study is indexed if it has a chunk."""
    with_chunks = chunks.select("sid", F.lit(True).alias("_c")).distinct()
    return studies.select("sid").join(with_chunks, "sid", "left").select("sid", F.when(F.col("_c"), "indexed").otherwise("without_chunks").alias("state"))


def type_drift(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Of each type: catalog total, indexed, missing and stale studies; both sides have (sid, type)."""
    both = catalog.select("sid", F.col("type").alias("c")).join(index.select("sid", F.col("type").alias("i")), "sid", "full")
    return both.groupBy(F.coalesce("c", "i").alias("type")).agg(F.count("c").alias("catalog_total"), F.count("i").alias("indexed"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("stale"))


def register(known: set[str], denied: set[str], add: set[str] = frozenset(), remove: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """The facet registry and its deny list after adding and removing keys: an added key leaves the deny list."""
    known, denied = (set(known) | set(add)) - set(remove), (set(denied) - set(add)) | set(remove)
    return sorted(known), sorted(denied)


def queue_page(queue: DataFrame, size: int, exclude: DataFrame | None = None) -> DataFrame:
    """The next changes to work on: pending or failed ones, catalog changes first, by id."""
    rows = queue.where(F.col("status").isin("pending", "failed"))
    if exclude is not None:
        rows = rows.join(exclude.select("id"), "id", "left_anti")
    return rows.orderBy(F.desc("priority"), "id").limit(size)


def apply_classes(stored: DataFrame, changes: DataFrame, records: DataFrame, order: str | None = None) -> DataFrame:
    """The studies after a batch of changes (sid, change_class), the last one of each study: a delete removes it, a full
    upsert takes the record, a partial one keeps all_text, and a change of variables leaves it. stored and records: (sid,
    title, all_text); records that the source lacks change nothing, and of several of one study the last by `order` counts."""
    last = changes.groupBy("sid").agg(F.max_by("change_class", "id").alias("_class"))
    new = last_of(records, F.struct("title", "all_text"), order)
    rows = stored.select("sid", F.struct("title", "all_text").alias("_o")).join(last, "sid", "full").join(new, "sid", "left")
    kind, old, fresh = F.col("_class"), F.col("_o"), F.col("_n")
    taken = F.when(kind == "upsert_full", F.coalesce(fresh, old)).when((kind == "upsert_partial") & old.isNotNull() & fresh.isNotNull(), F.struct(fresh["title"], old["all_text"])).otherwise(old)
    return rows.where(F.coalesce(kind != "delete", F.lit(True))).select("sid", taken.alias("_t")).where("_t IS NOT NULL").select("sid", "_t.*")


def poisoned(attempts: DataFrame, deaths: int = 2) -> DataFrame:
    """Items (id, changed) that were begun `deaths` times or more since they last ended: (id, changed, deaths).

    attempts: (id, changed, seq, event), event begin or end. An item that changed is another one, and an end forgives
    what was before it.
    """
    ends = attempts.where("event = 'end'").groupBy("id", "changed").agg(F.max("seq").alias("_end"))
    begun = attempts.where("event = 'begin'").join(ends, ["id", "changed"], "left").where("_end IS NULL OR seq > _end")
    return begun.groupBy("id", "changed").agg(F.count("*").alias("deaths")).where(F.col("deaths") >= deaths)
