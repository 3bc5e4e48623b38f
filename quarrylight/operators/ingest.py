"""Ingest: quality report, validation, upserts, pruning, vector reuse, diffs, facet maps; retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHORT, SAMPLES = 20, 20


def quality_report(chunks: DataFrame) -> DataFrame:
    """Counts and up to SAMPLES sample idnos of each issue of (page_content, idno, type) rows."""
    content = F.trim(F.coalesce("page_content", F.lit("")))
    issues = F.array(
        F.when(content == "", "empty_page_content"),
        F.when((content != "") & (F.char_length(content) < SHORT), "very_short_page_content"),
        F.when(F.trim(F.coalesce("idno", F.lit(""))) == "", "missing_idno"),
        F.when(F.trim(F.coalesce("type", F.lit(""))) == "", "missing_type"),
    )
    rows = chunks.select("idno", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))
    counts = rows.groupBy("issue").agg(F.count("*").alias("n"))
    # samples: a bounded number for each issue, found without gathering all ids
    order = Window.partitionBy("issue").orderBy("idno")
    few = rows.where("idno IS NOT NULL AND trim(idno) <> ''").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= SAMPLES)
    return counts.join(few.groupBy("issue").agg(F.array_sort(F.collect_list("idno")).alias("samples")), "issue", "left")


#: Catalog types and their index names.
TYPE_MAP = {
    "survey": "microdata",
    "timeseries": "indicator",
    "timeseriesdb": "indicator-db",
    "timeseries-db": "indicator-db",
    "document": "document",
    "table": "table",
    "geospatial": "geospatial",
    "script": "script",
    "image": "image",
    "video": "video",
}


def validated(records: DataFrame) -> DataFrame:
    """Records with their index type and the reason of rejection, null if they are accepted."""
    kind = F.create_map(*(F.lit(x) for pair in TYPE_MAP.items() for x in pair))
    reason = F.when(F.coalesce("catalog_id", F.lit(0)) <= 0, "catalog_id").when(F.trim(F.coalesce("idno", F.lit(""))) == "", "idno").when(F.try_element_at(kind, F.col("dataset_type")).isNull(), "dataset_type")
    return records.select("catalog_id", "idno", F.try_element_at(kind, F.col("dataset_type")).alias("type"), reason.alias("rejected"))


def upsert_latest(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the one of the greatest version; changes win ties."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    names = [c for c in current.columns if c != key]
    best = F.max_by(F.struct(*names), F.struct(version, "_new")).alias("r")
    return rows.groupBy(key).agg(best).select(key, "r.*")


def prune_stale(stored: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """Stored chunks that stay: those of this run, of studies it did not touch, and of studies whose write failed."""
    touched = fresh.select("sid").distinct().join(failed.select("sid"), "sid", "left_anti").withColumn("_t", F.lit(1))
    kept = fresh.select("sid", "chunk_id").withColumn("_k", F.lit(1)).distinct()
    return stored.join(touched, "sid", "left").join(kept, ["sid", "chunk_id"], "left").where("_t IS NULL OR _k IS NOT NULL").drop("_t", "_k")


def vector_reuse(fresh: DataFrame, stored: DataFrame, forced: bool = False) -> DataFrame:
    """New chunks with the stored vector where model and input cap are the same; `embed` marks the rest."""
    old = stored.select("chunk_id", F.col("embedding").alias("_v"), F.col("cap").alias("_cap"), F.col("model").alias("_model"))
    same = (F.col("cap") == F.col("_cap")) & (F.col("model") == F.col("_model")) & F.lit(not forced)
    joined = fresh.join(old, "chunk_id", "left").withColumn("_reuse", F.coalesce(same, F.lit(False)) & F.col("_v").isNotNull())
    return joined.select("chunk_id", "cap", F.when(F.col("_reuse"), F.col("_v")).alias("embedding"), (~F.col("_reuse")).alias("embed"))


def diff(catalog: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys to index (missing) and to delete (stale)."""
    missing = catalog.select(key).distinct().join(index.select(key), key, "left_anti").withColumn("change", F.lit("missing"))
    stale = index.select(key).distinct().join(catalog.select(key), key, "left_anti").withColumn("change", F.lit("stale"))
    return missing.unionByName(stale)


def normalized_facets(facets: Column) -> Column:
    """A facet map with trimmed texts, without nulls, blanks and empty keys, as entries in key order."""
    clean = F.transform_values(facets, lambda _, v: F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    return F.array_sort(F.map_entries(F.map_filter(clean, lambda _, v: F.size(v) > 0)))


def new_facet_keys(df: DataFrame, facets: str, known: list[str], excluded: list[str]) -> DataFrame:
    """Facet keys in use that are neither registered nor on the deny list."""
    return df.select(F.explode(F.map_keys(facets)).alias("key")).distinct().where(~F.col("key").isin([*known, *excluded]))


def coalesce_latest(queue: DataFrame) -> DataFrame:
    """The last change of each object."""
    last = F.max_by(F.struct("id", "change_class", "changed"), F.struct("changed", "id")).alias("r")
    return queue.groupBy("object_id").agg(last).select("object_id", "r.*")


def acknowledged(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """Queue rows with their status: done only if the row did not change since it was read."""
    ok = acks.select("id", F.col("changed").alias("_changed"))
    joined = queue.join(ok, "id", "left")
    status = F.when(F.col("_changed").isNull(), "pending").when(F.col("_changed") == F.col("changed"), "done").otherwise("conflict")
    return joined.select("id", "changed", status.alias("status"))


def ranking_metrics(ranked: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k, precision@k, reciprocal rank and recall of grade 2, by query: ranked (query, doc, pos from 1), grades (query, doc, grade)."""
    gain = F.pow(F.lit(2.0), "grade") - 1
    ideal = grades.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    per = ideal.groupBy("query").agg(F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") >= 2).alias("relevant"), F.least(F.lit(2), F.max("grade")).alias("least"))
    hits = ranked.join(grades, ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0))).join(per, "query")
    out = hits.groupBy("query", "idcg", "relevant").agg(
        F.sum(F.when(F.col("pos") <= k, gain / F.log2(F.col("pos") + 1)).otherwise(0.0)).alias("dcg"),
        F.count_if((F.col("pos") <= k) & (F.col("grade") > 0)).alias("good"),
        F.min(F.when((F.col("grade") >= F.col("least")) & (F.col("grade") > 0), F.col("pos"))).alias("first"),
        F.count_if(F.col("grade") >= 2).alias("found"),
    )
    return out.select("query", F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.col("good") / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.try_divide("found", "relevant"), 6).alias("recall"))
