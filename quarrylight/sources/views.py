"""Source tables and the observation, study, chunk, variable, citation and queue views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_raw(spark: SparkSession, sf_dir: str, fmt: str = "yyyy") -> DataFrame:
    """One observation for each order: duplicates of (geo, period) in arrival order."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    # nation has one row for each country
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("n_name").alias("geo"),
        F.concat(F.lit("Nation "), "n_name").alias("geo_name"),
        F.date_format("o_orderdate", fmt).alias("period"),
        F.year("o_orderdate").alias("year"),
        F.col("c_mktsegment").alias("dim"),
        F.col("o_totalprice").alias("v"),
        F.col("o_orderkey").alias("row_ord"),
    )


def obs(spark: SparkSession, sf_dir: str, fmt: str = "yyyy") -> DataFrame:
    """Order value of each nation and period; decimal sums do not depend on the order of rows."""
    money = F.sum(F.col("v").cast("decimal(18,2)")).cast("double")
    return obs_raw(spark, sf_dir, fmt).groupBy("geo", "geo_name", "period").agg(money.alias("v"), F.min("row_ord").alias("row_ord"))


def obs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by supplier nation and ship year."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_orderkey")
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = joined.select(F.col("n_name").alias("geo"), F.date_format("l_shipdate", "yyyy").alias("period"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"), "l_orderkey")
    return rows.groupBy("geo", "period").agg(F.sum("v").cast("double").alias("v"), F.min("l_orderkey").alias("row_ord")).withColumn("geo_name", F.concat(F.lit("Nation "), "geo"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study for each document; every attribute is a function of the document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    k = F.col("doc_id")
    title = F.trim(F.substring(F.regexp_replace(F.substring("text", 1, 80), r"\s+", " "), 1, 60))
    year = (1990 + F.pmod(k * 7, F.lit(30))).cast("int")
    return d.select(
        (k + 1).cast("int").alias("sid"),
        F.concat(F.lit("IDNO_"), "source", F.lit("_"), k.cast("string")).alias("idno"),
        F.when(F.pmod(k, F.lit(17)) != 3, title).alias("title"),
        F.col("text").alias("abstract"),
        F.element_at(F.array(*map(F.lit, ("survey", "document", "table", "timeseries"))), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("dataset_type"),
        F.array((F.pmod(k, F.lit(5)) + 100).cast("int"), (F.pmod(k, F.lit(7)) + 200).cast("int")).alias("countries"),
        F.when(F.pmod(k, F.lit(11)) == 5, F.array().cast("array<int>")).otherwise(F.array(year, (year + F.pmod(k, F.lit(3)) * 5).cast("int"))).alias("years"),
        F.array("lang", "source").alias("tags"),
        F.when(F.pmod(k, F.lit(13)) != 4, year).alias("year_start"),
        F.pmod(k * 31, F.lit(1000)).alias("created"),
        F.pmod(k * 17, F.lit(50)).alias("views"),
        F.when(F.pmod(k, F.lit(9)) != 2, F.col("source")).alias("nation"),
        F.pmod(k, F.lit(10)).cast("int").alias("published_mod"),
        F.pmod(k * 13, F.lit(2000)).alias("changed"),
        F.array((F.pmod(k, F.lit(6)) + 300).cast("int"), (F.pmod(k, F.lit(4)) + 310).cast("int")).alias("regions"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.array("source", F.lit("central"))).otherwise(F.array("source")).alias("repositories"),
        (F.pmod(k, F.lit(5)) + 1).cast("int").alias("form_id"),
        F.when(F.pmod(k, F.lit(10)) != 7, (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("data_class_id"),
        F.array((F.pmod(k, F.lit(8)) + 400).cast("int"), (F.pmod(k, F.lit(9)) + 410).cast("int")).alias("topics"),
        F.when(F.pmod(k, F.lit(3)) != 1, F.array(F.concat(F.lit("DB_"), F.pmod(k, F.lit(5)).cast("string")))).alias("databases"),
        F.create_map(F.lit("theme"), F.array((F.pmod(k, F.lit(4)) + 1).cast("int"), (F.pmod(k, F.lit(6)) + 1).cast("int")), F.lit("method"), F.array((F.pmod(k, F.lit(3)) + 1).cast("int"))).alias("user_facets"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with vectors: chunk i belongs to study i mod 100 + 1."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return e.select(
        k.alias("chunk_id"),
        (F.pmod(k, F.lit(100)) + 1).cast("int").alias("sid"),
        F.pmod(k, F.lit(8)).cast("int").alias("page"),
        F.when(F.pmod(k, F.lit(6)) != 0, F.pmod(k, F.lit(3)) + 1).cast("string").alias("resource_id"),
        F.when(F.pmod(k, F.lit(10)) == 9, "title").otherwise("passages").alias("qfield"),
        "label",
        "embedding",
    )


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("uid"), (F.pmod("p_partkey", F.lit(200)) + 1).cast("int").alias("sid"), F.col("p_name").alias("name"), F.col("p_type").alias("label"), F.col("p_brand").alias("categories"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    return b.select(
        (k + 1).alias("citation_id"),
        F.trim(F.substring("text", 1, 40)).alias("title"),
        (2000 + F.pmod(k, F.lit(20))).cast("int").alias("pub_year"),
        F.element_at(F.array(*map(F.lit, ("book", "journal", "report"))), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("ctype"),
        F.pmod(k, F.lit(4)).cast("int").alias("published"),
        F.concat(F.lit("10.1000/Ref."), k.cast("string")).alias("doi"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, ("upsert_full", "upsert_partial", "variables", "delete")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("object_id"), F.element_at(kinds, (F.pmod("event_id", F.lit(4)) + 1).cast("int")).alias("change_class"), F.col("event_id").alias("changed"), "event_type", "value")


#: The same views as SQL text, for oracles.
SQL = {
    "obs_raw": """obs_raw AS (SELECT n_name AS geo, 'Nation ' || n_name AS geo_name, strftime(o_orderdate, '%Y') AS period, year(o_orderdate)::INTEGER AS year, strftime(o_orderdate, '%Y-%m') AS month,
  c_mktsegment AS dim, o_totalprice AS v, o_orderkey AS row_ord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "obs": "obs AS (SELECT geo, geo_name, period, sum(v::DECIMAL(18,2))::DOUBLE AS v, min(row_ord) AS row_ord FROM obs_raw GROUP BY ALL)",
    "obs_month": "obs_month AS (SELECT geo, geo_name, month AS period, sum(v::DECIMAL(18,2))::DOUBLE AS v, min(row_ord) AS row_ord FROM obs_raw GROUP BY ALL)",
    "obs2": """obs2 AS (SELECT n_name AS geo, 'Nation ' || n_name AS geo_name, strftime(l_shipdate, '%Y') AS period, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v, min(l_orderkey) AS row_ord
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)""",
    "studies": r"""studies AS (SELECT (doc_id + 1)::INTEGER AS sid, 'IDNO_' || source || '_' || doc_id AS idno,
  CASE WHEN doc_id % 17 <> 3 THEN trim(substr(regexp_replace(substr(text, 1, 80), '\s+', ' ', 'g'), 1, 60)) END AS title, text AS abstract,
  ['survey', 'document', 'table', 'timeseries'][doc_id % 4 + 1] AS dataset_type, [(doc_id % 5 + 100)::INTEGER, (doc_id % 7 + 200)::INTEGER] AS countries,
  CASE WHEN doc_id % 11 = 5 THEN []::INTEGER[] ELSE [(1990 + doc_id * 7 % 30)::INTEGER, (1990 + doc_id * 7 % 30 + doc_id % 3 * 5)::INTEGER] END AS years, [lang, source] AS tags,
  CASE WHEN doc_id % 13 <> 4 THEN (1990 + doc_id * 7 % 30)::INTEGER END AS year_start, doc_id * 31 % 1000 AS created, doc_id * 17 % 50 AS views,
  CASE WHEN doc_id % 9 <> 2 THEN source END AS nation, (doc_id % 10)::INTEGER AS published_mod,
  doc_id * 13 % 2000 AS changed, [(doc_id % 6 + 300)::INTEGER, (doc_id % 4 + 310)::INTEGER] AS regions, CASE WHEN doc_id % 4 = 0 THEN [source, 'central'] ELSE [source] END AS repositories, (doc_id % 5 + 1)::INTEGER AS form_id,
  CASE WHEN doc_id % 10 <> 7 THEN (doc_id % 3 + 1)::INTEGER END AS data_class_id, [(doc_id % 8 + 400)::INTEGER, (doc_id % 9 + 410)::INTEGER] AS topics, CASE WHEN doc_id % 3 <> 1 THEN ['DB_' || doc_id % 5] END AS databases,
  [(doc_id % 4 + 1)::INTEGER, (doc_id % 6 + 1)::INTEGER] AS theme, [(doc_id % 3 + 1)::INTEGER] AS method FROM documents)""",
    "chunks": """chunks AS (SELECT vec_id AS chunk_id, (vec_id % 100 + 1)::INTEGER AS sid, (vec_id % 8)::INTEGER AS page, CASE WHEN vec_id % 6 <> 0 THEN (vec_id % 3 + 1)::VARCHAR END AS resource_id,
  CASE WHEN vec_id % 10 = 9 THEN 'title' ELSE 'passages' END AS qfield, label, embedding FROM embeddings)""",
    "variables": "variables AS (SELECT p_partkey AS uid, (p_partkey % 200 + 1)::INTEGER AS sid, p_name AS name, p_type AS label, p_brand AS categories FROM part)",
    "citations": """citations AS (SELECT item_id + 1 AS citation_id, trim(substr(text, 1, 40)) AS title, (2000 + item_id % 20)::INTEGER AS pub_year, ['book', 'journal', 'report'][item_id % 3 + 1] AS ctype,
  (item_id % 4)::INTEGER AS published, '10.1000/Ref.' || item_id AS doi FROM benchmark)""",
    "queue": "queue AS (SELECT event_id AS id, user_id AS object_id, ['upsert_full', 'upsert_partial', 'variables', 'delete'][event_id % 4 + 1] AS change_class, event_id AS changed, event_type, value FROM events)",
}
_NEEDS = {"obs": ("obs_raw",), "obs_month": ("obs_raw",)}


def with_views(names: str, body: str) -> str:
    """The SQL text with the named views before it."""
    order: list[str] = []
    for name in names.split():
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    return "WITH " + ",\n".join(SQL[n] for n in order) + (",\n" if body.startswith(",") else "\n") + body.lstrip(",")
