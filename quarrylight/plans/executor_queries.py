"""Queries of the keyword and hybrid executors, of document building, filters, sinks and pages, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import nested as NJ
from quarrylight.operators import bulk as B
from quarrylight.operators import documents as D
from quarrylight.operators import filters as X
from quarrylight.operators import hybrid as H
from quarrylight.operators import inverted
from quarrylight.operators import paging as P
from quarrylight.operators import schemas as C
from quarrylight.operators import search as Q
from quarrylight.operators import sinks as K
from quarrylight.operators import text as T
from quarrylight.operators import vectors as N
from quarrylight.plans.search_queries import _BLOCK, TERMS, _bm25_sql, _fold, _knn_sql, _tokens, _vector, documents_index
from quarrylight.sources import scratch, stores
from quarrylight.sources import views as V
from quarrylight.sources.views import table, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# keyword executor

BOOSTS = {"idno": 60.0, "title": 40.0, "nation": 30.0, "authoring_entity": 10.0, "abstract": 10.0, "keywords": 1.0, "methodology": 1.0, "var_keywords": 1.0}
WORDS = ("anea", "attion", "erinr")  # the last one is a typo
PHRASE = ("eriner", "anea", "thanea")  # texts have the first two the other way round
_MORE = {
    "authoring_entity": "'Office of ' || tags[2]",
    "keywords": "concat_ws(' ', tags[1], tags[2], dataset_type)",
    "methodology": "substr(abstract, 101, 200)",
    "var_keywords": "substr(abstract, 301, 150)",
}


def _phrase_sql(name: str, words: list[str], slop: int, n: int) -> str:
    """{name} (sid, score): BM25 of a phrase in t{n}, from the definition: every choice of tokens is looked at."""
    places = ", ".join(f"list_filter(range(1, len(t) + 1), lambda i: t[i] = '{w}') AS p{j}" for j, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE len(p{j}) > 0) AS d{j}" for j in range(len(words)))
    joined = "".join(f" JOIN (SELECT sid, unnest(p{j}) - {j} AS a{j} FROM {name}_p) AS u{j} USING (sid)" for j in range(1, len(words)))
    spread = f"greatest({', '.join(f'a{j}' for j in range(len(words)))}) - least({', '.join(f'a{j}' for j in range(len(words)))})"
    near = " AND ".join(f"abs(a{j} - a0) <= {slop}" for j in range(1, len(words)))
    idf = " + ".join(f"ln(1 + (n - d{j} + 0.5) / (d{j} + 0.5))" for j in range(len(words)))
    return f"""{name}_p AS (SELECT sid, len(t) AS dl, {places} FROM t{n} WHERE len(t) > 0), {name}_s AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM {name}_p),
 {name}_m AS (SELECT sid, a0, min({spread}) AS moves FROM (SELECT sid, unnest(p0) AS a0 FROM {name}_p){joined} WHERE {near} GROUP BY sid, a0),
 {name}_f AS (SELECT sid, sum(1 / (1 + moves)) AS f FROM {name}_m WHERE moves <= {slop} GROUP BY sid),
 {name} AS (SELECT sid, ({idf}) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM {name}_f JOIN {name}_p USING (sid), {name}_s)"""


def _fields_sql() -> str:
    more = ", ".join(f"{sql} AS {name}" for name, sql in _MORE.items())
    parts = [f"t{n} AS (SELECT sid, {_tokens(f"coalesce({f}, '')")} AS t FROM ls)" for n, f in enumerate([*BOOSTS, "concat_ws(' ', title, nation)"])]
    return f", ls AS (SELECT *, {more} FROM studies), " + ", ".join(parts)


def _lexical_sql(words: tuple[str, ...] = WORDS) -> str:
    """lex (sid, score) over the studies view, from the contract: no code is shared with the operator but the fold."""
    near = {w: f"x = '{w}'" + (f" OR (left(x, 2) = '{w[:2]}' AND levenshtein(x, '{w}') <= {k})" if (k := T.edits(w)) else "") for w in words}
    out, union, bonus = [], [], []
    for n, (boost, tests, need) in enumerate([*((b, near, 2) for b in BOOSTS.values()), (1.0, {w: f"x = '{w}'" for w in words}, 3)]):
        tf = ", ".join(f"len(list_filter(t, lambda x: {c})) AS f{i}" for i, c in enumerate(tests.values()))
        df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(3))
        part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(3))
        m = " + ".join(f"(f{i} > 0)::INTEGER" for i in range(3))
        out.append(f"""c{n} AS (SELECT sid, len(t) AS dl, {tf} FROM t{n} WHERE len(t) > 0),
 s{n} AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM c{n}), b{n} AS (SELECT sid, {boost} * ({part}) AS score FROM c{n}, s{n} WHERE {m} >= {need})""")
        union.append(f"SELECT * FROM b{n}")
        if n < len(BOOSTS):
            out.append(_phrase_sql(f"ph{n}", list(words), 2, n))
            bonus.append(f"SELECT sid, score * {2 * boost} AS score FROM ph{n}")
    return _fields_sql() + ", " + ", ".join(out) + f""", sums AS (SELECT sid, sum(score) AS score FROM ({' UNION ALL '.join(union)}) GROUP BY sid),
 bonus AS (SELECT sid, max(score) AS more FROM ({' UNION ALL '.join(bonus)}) GROUP BY sid),
 lex AS (SELECT sid, score + coalesce(more, 0) AS score FROM sums LEFT JOIN bonus USING (sid))"""


def studies_index(spark, d):
    """The stored index of the studies' fields, built at its first use."""
    s = V.studies(spark, d)
    fields = {f: F.col(f) for f in BOOSTS if f not in _MORE} | {
        "authoring_entity": F.concat(F.lit("Office of "), F.get("tags", F.lit(1))),
        "keywords": F.concat_ws(" ", F.get("tags", F.lit(0)), F.get("tags", F.lit(1)), "dataset_type"),
        "methodology": F.substring("abstract", 101, 200),
        "var_keywords": F.substring("abstract", 301, 150),
        "*all_text": F.filter(F.array("title", "nation"), lambda x: x.isNotNull()),
    }
    return inverted.stored(s, "sid", fields, scratch.base(spark))


def _lexical(spark, d, query=" ".join(WORDS)):
    return studies_index(spark, d).lexical(BOOSTS, query, "all_text").withColumnRenamed("key", "sid")


@_query("lexical_full", with_views("studies", _lexical_sql() + " SELECT sid, round(score, 4) AS score FROM lex"))
def lexical_full(spark, d):
    return _lexical(spark, d).withColumn("score", F.round("score", 4))


@_query("lexical_phrase", with_views("studies", _lexical_sql(PHRASE) + " SELECT sid, round(score, 4) AS score FROM lex"))
def lexical_phrase(spark, d):
    return _lexical(spark, d, " ".join(PHRASE)).withColumn("score", F.round("score", 4))


_QUOTED = ", ".join(_phrase_sql(f"q{n}", ["attion", "to"], 0, n) for n in range(len(BOOSTS) + 1))
_BEST = " UNION ALL ".join(f"SELECT sid, score * {b} AS score FROM q{n}" for n, b in enumerate([*BOOSTS.values(), 1.0]))


@_query("lexical_quoted", with_views("studies", f"{_fields_sql()}, {_QUOTED} SELECT sid, round(max(score), 4) AS score FROM ({_BEST}) GROUP BY sid"))
def lexical_quoted(spark, d):
    return _lexical(spark, d, "“Attion to”").withColumn("score", F.round("score", 4))


@_query("lexical_quoted_words", with_views("studies", f"{_lexical_sql()}, {_QUOTED}, q AS (SELECT sid, max(score) AS more FROM ({_BEST}) GROUP BY sid) SELECT sid, round(score + more, 4) AS score FROM lex JOIN q USING (sid)"))
def lexical_quoted_words(spark, d):
    return _lexical(spark, d, 'anea "attion to" attion erinr').withColumn("score", F.round("score", 4))


_HYBRID = _knn_sql() + _BLOCK + _lexical_sql() + """, kw AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS pos FROM lex QUALIFY pos <= 50),
 sem AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS pos FROM blk WHERE sid IN (SELECT sid FROM studies) QUALIFY pos <= 50), u AS (SELECT sid, pos, 'lexical' AS l FROM kw UNION ALL SELECT sid, pos, 'semantic' FROM sem),
 f AS (SELECT sid, sum(1 / (60 + pos)) AS score, list_sort(list(l)) AS matched_by FROM u GROUP BY sid),
 done AS (SELECT sid FROM studies WHERE list_has_all(regexp_extract_all(lower(coalesce(title, '')), '\\p{L}+|\\p{Nd}+'), ['anea', 'attion', 'eriner'])),
 hd AS (SELECT sid, 0 AS block, row_number() OVER (ORDER BY (sid IN (SELECT sid FROM done)) DESC, score DESC, sid)::DOUBLE AS pos, matched_by FROM f),
 rows_ AS (SELECT * FROM hd UNION ALL SELECT sid, 1, -score, ['lexical'] FROM lex WHERE sid NOT IN (SELECT sid FROM hd)), o AS (SELECT rows_.*, dataset_type FROM rows_ JOIN studies USING (sid))"""


def _hybrid(spark, d, types=None, ascending=False):
    studies = V.studies(spark, d)
    semantic = N.semantic_block(V.chunks(spark, d), _vector(spark, d), floor=0.5, cutoff=0.6)
    return H.hybrid(_lexical(spark, d), semantic, studies, Q.title_complete(studies, "anea attion eriner"), types, ascending=ascending)


@_query("hybrid_full", with_views("chunks studies", _HYBRID + " SELECT sid, block, round(pos, 4) AS pos, matched_by, dataset_type FROM o WHERE dataset_type IN ('survey', 'table')"))
def hybrid_full(spark, d):
    return _hybrid(spark, d, ["survey", "table"]).withColumn("pos", F.round("pos", 4))


@_query("hybrid_ascending", with_views("chunks studies", _HYBRID + " SELECT sid, -block AS block, round(-pos, 4) AS pos, dataset_type FROM o ORDER BY 2, 3, sid LIMIT 30"))
def hybrid_ascending(spark, d):
    """The page of the worst matches: the tail from its end, then the head from its end."""
    rows = _hybrid(spark, d, ascending=True).withColumn("pos", F.round("pos", 4))
    return rows.orderBy("block", "pos", "sid").limit(30).select("sid", "block", "pos", "dataset_type")


@_query("hybrid_totals", with_views("chunks studies", _HYBRID + " SELECT dataset_type, count(*) AS n FROM o GROUP BY dataset_type"))
def hybrid_totals(spark, d):
    return H.type_totals(_hybrid(spark, d))


@_query("keyword_agreement", with_views("chunks studies", _knn_sql() + _BLOCK + _lexical_sql() + " SELECT sid, round(score, 6) AS score FROM blk WHERE sid IN (SELECT sid FROM lex)"))
def keyword_agreement(spark, d):
    semantic = N.semantic_block(V.chunks(spark, d), _vector(spark, d), floor=0.5, cutoff=0.6)
    return H.agreement(semantic, _lexical(spark, d)).withColumn("score", F.round("score", 6))


@_query("semantic_enrich", with_views("chunks studies", _knn_sql() + _BLOCK + " SELECT sid, round(blk.score, 6) AS score, idno, dataset_type FROM blk JOIN studies USING (sid) WHERE published_mod <> 0"))
def semantic_enrich(spark, d):
    block = N.semantic_block(V.chunks(spark, d), _vector(spark, d), floor=0.5, cutoff=0.6)
    studies = Q.filter_studies(V.studies(spark, d), published=True)
    return block.join(studies.select("sid", "idno", "dataset_type"), "sid").withColumn("score", F.round("score", 6))


_VAR_WORDS = ("red", "anodized", "steel")


def _best_sql(fields: dict[str, float]) -> str:
    out, union = [], []
    for n, (field, boost) in enumerate(fields.items()):
        tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(_VAR_WORDS))
        df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(3))
        part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(3))
        out.append(f"t{n} AS (SELECT uid, {_tokens(field)} AS t FROM variables), c{n} AS (SELECT uid, len(t) AS dl, {tf} FROM t{n} WHERE len(t) > 0), s{n} AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM c{n}), b{n} AS (SELECT uid, {boost} * ({part}) AS score FROM c{n}, s{n} WHERE f0 + f1 + f2 > 0)")
        union.append(f"SELECT * FROM b{n}")
    return ", " + ", ".join(out) + f" SELECT uid, round(max(score), 4) AS score FROM ({' UNION ALL '.join(union)}) GROUP BY uid"


@_query("variables_best_fields", with_views("variables", _best_sql({"label": 10.0, "name": 5.0, "categories": 1.0})))
def variables_best_fields(spark, d):
    return T.multi_field(V.variables(spark, d), "uid", {"label": 10.0, "name": 5.0, "categories": 1.0}, list(_VAR_WORDS), best=True).withColumn("score", F.round("score", 4))


@_query("passage_hybrid_sum", with_views("chunks", _knn_sql() + ", " + _bm25_sql("documents", "doc_id", "text", 1, "b") + ", v AS (SELECT chunk_id, score FROM k ORDER BY score DESC, chunk_id LIMIT 40), w AS (SELECT chunk_id, score FROM chunks JOIN b ON sid = doc_id + 1) SELECT chunk_id, round(0.3 * coalesce(w.score, 0) + coalesce(v.score, 0), 6) AS score FROM w FULL JOIN v USING (chunk_id)"))
def passage_hybrid_sum(spark, d):
    """A passage's text is its study's."""
    c = V.chunks(spark, d)
    texts = documents_index(spark, d).scores(TERMS, ["text"]).select((F.col("key") + 1).alias("sid"), "score")
    return H.summed(c.join(texts, "sid").select("chunk_id", "score"), N.knn(c, _vector(spark, d), 40), "chunk_id").withColumn("score", F.round("score", 6))


@_query("retrieve_in_order", with_views("studies", ", a AS (SELECT unnest([9, 3, 77, 5]) AS sid, unnest([1, 2, 3, 4]) AS rank) SELECT sid, rank, idno FROM a JOIN studies USING (sid)"))
def retrieve_in_order(spark, d):
    return H.in_order(V.studies(spark, d).select("sid", "idno"), [9, 3, 77, 5], "sid").select(F.col("sid").cast("int").alias("sid"), "rank", "idno")


# documents


@_query("study_documents", with_views("studies", f""" SELECT sid, trim(idno) AS idno, nullif(trim(title), '') AS title, nullif(trim(abstract, ' '), '') AS abstract, substr({_fold('title')}, 1, 256) AS title_sort, substr({_fold('nation')}, 1, 256) AS nation_sort, year_start, created::INTEGER AS created,
 list_filter([trim(title), nation, dataset_type], lambda x: x IS NOT NULL AND x <> '') AS all_text, array_to_string(tags, ',') AS tags, nation AS nations FROM studies"""))
def study_documents(spark, d):
    out = D.study_documents(V.studies(spark, d))
    return out.select("*", F.array_join(F.col("facets")["tags"], ",").alias("tags"), F.get(F.try_element_at("facets", F.lit("nation")), F.lit(0)).alias("nations")).drop("facets")


def _chunk_source(spark, d):
    c = V.chunks(spark, d)
    return c.select("sid", "qfield", F.when(F.pmod("chunk_id", F.lit(9)) == 0, " ").otherwise(F.concat(F.lit(" text "), F.col("chunk_id").cast("string"))).alias("page_content"))


_CHUNK_DOCS = """, g AS (SELECT sid, qfield, CASE WHEN chunk_id % 9 <> 0 THEN 'text ' || chunk_id END AS page_content FROM chunks),
 doc AS (SELECT sha256(concat_ws(chr(31), coalesce(dataset_type, ''), coalesce(idno, ''), qfield, coalesce(page_content, ''))) AS chunk_id, g.sid, idno, dataset_type AS type, qfield, created, page_content, page_content IS NULL AS skip FROM g LEFT JOIN studies USING (sid))"""


@_query("chunk_documents", with_views("chunks studies", _CHUNK_DOCS + " SELECT * FROM doc"))
def chunk_documents(spark, d):
    return D.chunk_documents(_chunk_source(spark, d), V.studies(spark, d))


@_query("chunk_skip_report", with_views("chunks studies", _CHUNK_DOCS + " SELECT type, count(*) FILTER (WHERE NOT skip) AS written, count(*) FILTER (WHERE skip) AS skipped FROM doc GROUP BY type"))
def chunk_skip_report(spark, d):
    return D.skip_report(D.chunk_documents(_chunk_source(spark, d), V.studies(spark, d)))


@_query("variable_documents", with_views("studies variables", " SELECT uid, sid, name, label, nullif(trim(title), '') AS title FROM variables LEFT JOIN studies USING (sid)"))
def variable_documents(spark, d):
    return D.variable_documents(V.variables(spark, d), V.studies(spark, d))


@_query("citation_documents", with_views("citations", f" SELECT citation_id, nullif(trim(title), '') AS title, substr({_fold('title')}, 1, 256) AS title_sort, lower(doi) AS doi, 'Ann B' || citation_id AS authors, pub_year FROM citations"))
def citation_documents(spark, d):
    c = V.citations(spark, d)
    return D.citation_documents(c.withColumn("authors", F.concat(F.lit('[{"fname":"Ann","lname":"B'), F.col("citation_id").cast("string"), F.lit('"}]')))).withColumn("authors", F.replace("authors", F.lit("Ann B"), F.lit("Ann B")))


@_query("metadata_by_type", with_views("studies", " SELECT sid, CASE WHEN dataset_type IN ('survey', 'document', 'timeseries') THEN idno END AS idno, CASE WHEN dataset_type IN ('survey', 'document', 'timeseries') THEN 'T' || sid END AS title FROM studies"))
def metadata_by_type(spark, d):
    s = V.studies(spark, d)
    name = F.concat(F.lit("T"), F.col("sid").cast("string"))
    statement = F.struct(F.struct(name.alias("title"), "idno").alias("title_statement"))
    body = F.when(F.col("dataset_type") == "survey", F.to_json(F.struct(statement.alias("study_desc")))).when(F.col("dataset_type") == "document", F.to_json(F.struct(statement.alias("document_description")))).otherwise(F.to_json(F.struct(F.struct("idno", name.alias("name")).alias("series_description"))))
    return D.typed_metadata(s.select("sid", F.col("dataset_type").alias("schematype"), body.alias("metadata"))).select("sid", "idno", "title")


@_query("sanitize_strings", r"SELECT doc_id, trim(regexp_replace(substr(text, 1, 1000), '\s+', ' ', 'g')) AS clean FROM documents")
def sanitize_strings(spark, d):
    return table(spark, d, "documents").select("doc_id", D.sanitized(F.col("text")).alias("clean"))


@_query("search_preference", """SELECT DISTINCT event_type, substr(sha1('{"q":"' || event_type || '","n":10}'), 1, 16) AS preference FROM events""")
def search_preference(spark, d):
    return table(spark, d, "events").select("event_type", D.preference([F.col("event_type").alias("q"), F.lit(10).alias("n")]).alias("preference")).distinct()


# filters

_FACETS = "fct AS (SELECT sid, tags[1] AS lang, tags[2] AS src FROM studies)"


def _faceted(spark, d):
    tag = lambda i: F.array(F.get("tags", F.lit(i)))
    return V.studies(spark, d).select("sid", F.map_from_arrays(F.array(F.lit("lang"), F.lit("src")), F.array(tag(0), tag(1))).alias("facets"))


@_query("dynamic_filters", with_views("studies", f", {_FACETS} SELECT sid FROM fct WHERE lang IN ('en', 'fr') AND src IN ('src1', 'src4')"))
def dynamic_filters(spark, d):
    return X.dynamic(_faceted(spark, d), {"lang": [" en", "fr", None], "src": ["src1", "src4"], "none": [" "], "type": "ignored"}).select("sid")


@_query("count_date_filters", "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def count_date_filters(spark, d):
    o = table(spark, d, "orders")
    return o.where(X.count_test(">500", F.col("o_orderkey")) & X.date_test("1995/01/01-1996/06/30", F.col("o_orderdate").cast("date"))).select("o_orderkey")


@_query("prune_nulls", with_views("studies", """ SELECT sid, CASE WHEN title IS NULL AND nation IS NULL THEN NULL ELSE (title IS NOT NULL)::INTEGER + (nation IS NOT NULL)::INTEGER END AS fields FROM studies"""))
def prune_nulls(spark, d):
    s = V.studies(spark, d).select("sid", F.struct("title", F.struct("nation").alias("place")).alias("r"))
    r = X.pruned(F.col("r"), s.schema["r"].dataType)
    rows = s.select("sid", r.alias("r"))
    return rows.select("sid", F.when(F.col("r").isNotNull(), F.col("r.title").isNotNull().cast("int") + F.col("r.place.nation").isNotNull().cast("int")).alias("fields"))


# sinks


def _ids(spark, d, where: str):
    return V.studies(spark, d).where(where).select("sid")


@_query("study_extract_ids", with_views("studies", ", a AS (SELECT unnest(range(90, 110)) AS sid UNION SELECT 99999999) SELECT sid::INTEGER AS sid, CASE WHEN sid IN (SELECT sid FROM studies) THEN 'found' ELSE 'missing' END AS status FROM a"))
def study_extract_ids(spark, d):
    ids = spark.range(90, 110).unionByName(spark.range(99999999, 100000000)).select(F.col("id").cast("int").alias("sid"))
    return K.extract_by_ids(V.studies(spark, d), ids)


@_query("delete_sids", with_views("chunks studies", " SELECT chunk_id, sid FROM chunks WHERE sid % 4 <> 0"))
def delete_sids(spark, d):
    c = V.chunks(spark, d)
    return K.delete_sids(c, c.select("sid").where("sid % 4 = 0").unionByName(spark.createDataFrame([(-1,), (0,)], "sid int"))).select("chunk_id", "sid")


@_query("partial_update", with_views("studies", " SELECT sid, CASE WHEN sid % 3 = 0 THEN 'new ' || sid ELSE idno END AS idno, CASE WHEN sid % 6 = 0 THEN 'text' ELSE tags[1] END AS all_text FROM studies"))
def partial_update(spark, d):
    s = V.studies(spark, d).select("sid", "idno", F.get("tags", F.lit(0)).alias("all_text"))
    changes = s.where("sid % 3 = 0").select("sid", F.concat(F.lit("new "), F.col("sid").cast("string")).alias("idno"), F.when(F.col("sid") % 6 == 0, "text").alias("all_text"))
    return K.partial_update(s, changes.unionByName(spark.createDataFrame([(-5, "x", None)], changes.schema)))


@_query("filter_sync", with_views("chunks studies", f", {_FACETS} SELECT chunk_id, c.sid, CASE WHEN c.sid % 2 = 0 AND lang IS NOT NULL THEN lang ELSE 'old' END AS lang FROM chunks c LEFT JOIN fct ON fct.sid = c.sid"))
def filter_sync(spark, d):
    c = V.chunks(spark, d).select("chunk_id", "sid", F.create_map(F.lit("lang"), F.array(F.lit("old"))).alias("facets"))
    out = K.sync_filters(c, _faceted(spark, d).where("sid % 2 = 0"))
    return out.select("chunk_id", "sid", F.get(F.col("facets")["lang"], F.lit(0)).alias("lang"))


@_query("filter_sync_report", with_views("chunks studies", ", n AS (SELECT sid, count(*) AS n FROM chunks GROUP BY sid) SELECT s.sid, coalesce(n, 0) AS updated_points, n IS NOT NULL AS found FROM studies s LEFT JOIN n USING (sid)"))
def filter_sync_report(spark, d):
    return K.sync_report(V.chunks(spark, d), V.studies(spark, d))


@_query("facet_backfill", with_views("studies", " SELECT sid, CASE WHEN sid % 2 = 0 THEN 'kept' ELSE tags[1] END AS lang FROM studies"))
def facet_backfill(spark, d):
    s = V.studies(spark, d)
    facets = F.when(F.col("sid") % 2 == 0, F.create_map(F.lit("lang"), F.array(F.lit("kept"))))
    fields = F.array(F.struct(F.lit("lang").alias("key"), F.array(F.get("tags", F.lit(0))).alias("values")))
    return K.backfill_facets(s.select("sid", facets.alias("facets"), fields.alias("filter_fields"))).select("sid", F.get(F.col("facets")["lang"], F.lit(0)).alias("lang"))


@_query("facet_patch", with_views("studies", f", {_FACETS} SELECT sid, CASE WHEN sid % 2 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN sid % 2 = 1 THEN src END AS src FROM fct"))
def facet_patch(spark, d):
    none = F.array().cast("array<string>")
    new = F.when(F.col("sid") % 2 == 0, F.map_from_arrays(F.array(F.lit("lang"), F.lit("src")), F.array(F.array(F.lit("xx")), none))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))
    rows = _faceted(spark, d).select("sid", K.patch_facets(new, F.col("facets")).alias("f"))
    return rows.select("sid", *(F.get(F.try_element_at("f", F.lit(k)), F.lit(0)).alias(k) for k in ("lang", "src")))


@_query("variables_replace", with_views("variables", " SELECT uid, sid, name FROM variables WHERE sid % 5 <> 0 UNION ALL SELECT uid + 1000000000, sid, 'v' || uid FROM variables WHERE sid % 5 = 0 AND uid % 2 = 0"))
def variables_replace(spark, d):
    v = V.variables(spark, d).select(F.col("uid").cast("long").alias("uid"), "sid", "name")
    fresh = v.where("uid % 2 = 0").select((F.col("uid") + 1_000_000_000).alias("uid"), "sid", F.concat(F.lit("v"), F.col("uid").cast("string")).alias("name"))
    return K.replace_per_study(v, fresh, v.where("sid % 5 = 0"))


@_query("citation_sync", with_views("citations", " SELECT citation_id, CASE WHEN citation_id % 3 = 0 THEN 'N' || citation_id ELSE title END AS title FROM citations WHERE citation_id % 3 <> 1"))
def citation_sync(spark, d):
    c = V.citations(spark, d).select("citation_id", "title")
    status = F.when(F.col("citation_id") % 3 == 0, 200).when(F.col("citation_id") % 3 == 1, 404).otherwise(503)
    return K.sync_by_status(c, c.select("citation_id", F.concat(F.lit("N"), F.col("citation_id").cast("string")).alias("title"), status.alias("status")), "citation_id")


@_query("vector_dimensions", "SELECT count(embedding) AS n, min(len(embedding))::INTEGER AS least, max(len(embedding))::INTEGER AS most, count(*) FILTER (WHERE len(embedding) <> 64) AS drifted FROM embeddings")
def vector_dimensions(spark, d):
    return K.dimensions(table(spark, d, "embeddings"), 64)


@_query("state_report", with_views("studies", " SELECT sid, CASE WHEN sid % 7 = 0 THEN 'deleted' WHEN sid % 5 = 0 THEN 'failed' ELSE 'indexed' END AS state FROM studies WHERE sid % 2 = 0 OR sid % 5 = 0 OR sid % 7 = 0"))
def state_report(spark, d):
    return K.state_report(V.studies(spark, d), _ids(spark, d, "sid % 2 = 0"), _ids(spark, d, "sid % 5 = 0"), _ids(spark, d, "sid % 7 = 0"))


@_query("import_state", with_views("chunks studies", " SELECT sid, CASE WHEN sid IN (SELECT sid FROM chunks) THEN 'indexed' ELSE 'without_chunks' END AS state FROM studies"))
def import_state(spark, d):
    return K.import_state(V.studies(spark, d), V.chunks(spark, d))


@_query("type_drift", with_views("studies", """, c AS (SELECT sid, dataset_type AS type FROM studies WHERE sid % 3 <> 0), i AS (SELECT sid, dataset_type AS type FROM studies WHERE sid % 4 <> 0)
SELECT coalesce(c.type, i.type) AS type, count(c.sid) AS catalog_total, count(i.sid) AS indexed, count(*) FILTER (WHERE i.sid IS NULL) AS missing, count(*) FILTER (WHERE c.sid IS NULL) AS stale FROM c FULL JOIN i USING (sid) GROUP BY ALL"""))
def type_drift(spark, d):
    s = V.studies(spark, d).select("sid", F.col("dataset_type").alias("type"))
    return K.type_drift(s.where("sid % 3 <> 0"), s.where("sid % 4 <> 0"))


def _queue(spark, d):
    q = V.queue(spark, d)
    return q.select("id", "object_id", "change_class", F.element_at(F.array(*map(F.lit, ("pending", "failed", "done"))), (F.pmod("id", F.lit(3)) + 1).cast("int")).alias("status"), (F.pmod("id", F.lit(10)) == 0).cast("int").alias("priority"))


@_query("queue_scan", with_views("queue", " SELECT id, change_class FROM queue WHERE id % 3 <> 2 AND id % 20 <> 0 ORDER BY (id % 10 = 0)::INTEGER DESC, id LIMIT 200"))
def queue_scan(spark, d):
    q = _queue(spark, d)
    return K.queue_page(q, 200, q.where("id % 20 = 0")).select("id", "change_class")


@_query("cdc_change_classes", with_views("queue studies", """, l AS (SELECT object_id AS sid, arg_max(change_class, id) AS cls FROM queue GROUP BY object_id), o AS (SELECT sid, idno AS title, tags[1] AS all_text FROM studies WHERE sid % 2 = 0), n AS (SELECT sid, 'new' AS title, 'fresh' AS all_text FROM studies WHERE sid % 3 <> 0)
SELECT sid, CASE WHEN cls IN ('upsert_full', 'upsert_partial') AND n.title IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN cls = 'upsert_full' AND n.title IS NOT NULL THEN n.all_text ELSE o.all_text END AS all_text
 FROM (SELECT sid FROM o UNION SELECT sid FROM l) LEFT JOIN o USING (sid) LEFT JOIN n USING (sid) LEFT JOIN l USING (sid) WHERE coalesce(cls, '') <> 'delete' AND (o.title IS NOT NULL OR (cls = 'upsert_full' AND n.title IS NOT NULL))"""))
def cdc_change_classes(spark, d):
    s = V.studies(spark, d)
    stored = s.where("sid % 2 = 0").select("sid", F.col("idno").alias("title"), F.get("tags", F.lit(0)).alias("all_text"))
    records = s.where("sid % 3 <> 0").select("sid", F.lit("new").alias("title"), F.lit("fresh").alias("all_text"))
    return K.apply_classes(stored, V.queue(spark, d).select(F.col("object_id").alias("sid"), "id", "change_class"), records)


@_query("cdc_poison_items", """WITH a AS (SELECT user_id AS id, event_id // 200 AS changed, event_id AS seq, event_id % 3 = 0 AS done FROM events), e AS (SELECT id, changed, max(seq) AS last FROM a WHERE done GROUP BY ALL)
SELECT id, changed, count(*) AS deaths FROM a LEFT JOIN e USING (id, changed) WHERE NOT done AND (last IS NULL OR seq > last) GROUP BY ALL HAVING count(*) >= 2""")
def cdc_poison_items(spark, d):
    ended = F.pmod("event_id", F.lit(3)) == 0
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 200).alias("changed"), F.col("event_id").alias("seq"), F.when(ended, "end").otherwise("begin").alias("event"))
    return K.poisoned(e)


# pages and totals


@_query("hit_total_capped", "SELECT cap, least(n, cap) AS found, n > cap AS found_is_lower_bound FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 3 = 0), (SELECT unnest([50, 1000000000])::BIGINT AS cap)")
def hit_total_capped(spark, d):
    s = V.studies(spark, d).where("(sid - 1) % 3 = 0")
    few, all_ = (P.hit_total(s, cap).select(F.lit(cap).cast("long").alias("cap"), "found", "found_is_lower_bound") for cap in (50, 1_000_000_000))
    return few.unionByName(all_)


@_query("hit_total_exact", with_views("studies", " SELECT count(*) AS found, false AS found_is_lower_bound FROM studies WHERE published_mod = 1"))
def hit_total_exact(spark, d):
    return P.hit_total(V.studies(spark, d).where("published_mod = 1"))


@_query("page_rank", with_views("studies", " SELECT sid, row_number() OVER (ORDER BY views DESC, sid)::INTEGER AS rank FROM studies QUALIFY rank BETWEEN 31 AND 50"))
def page_rank(spark, d):
    return P.ranked_page(V.studies(spark, d), [F.desc("views"), F.asc("sid")], 30, 20).select("sid", "rank")


@_query("chunks_per_study", with_views("chunks", " SELECT sid, count(*) AS n FROM chunks GROUP BY sid"))
def chunks_per_study(spark, d):
    return V.chunks(spark, d).groupBy("sid").agg(F.count("*").alias("n"))


@_query("scroll_points", with_views("chunks", " SELECT chunk_id, sid, page FROM chunks WHERE qfield = 'passages' AND chunk_id > 120 ORDER BY chunk_id LIMIT 64"))
def scroll_points(spark, d):
    return Q.page(V.chunks(spark, d).where("qfield = 'passages'"), [("chunk_id", True)], 64, [120]).select("chunk_id", "sid", "page")


@_query("request_histogram", "SELECT event_type AS route, least(10, greatest(1, floor(value / 10) + 1))::INTEGER AS bucket, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL")
def request_histogram(spark, d):
    e = table(spark, d, "events").where("value >= 0")
    return e.groupBy(F.col("event_type").alias("route"), F.least(F.lit(10), F.greatest(F.lit(1), (F.floor(F.col("value") / 10) + 1))).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# nested records


_FIRST = "list_slice(regexp_extract_all(coalesce(text, ''), '[a-zA-Z]+'), 1, 4)"


@_query("microdata_text", f"""WITH w AS (SELECT doc_id, lang, source, {_FIRST} AS w FROM documents), n AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
 t AS (SELECT doc_id, x, 2 * i AS pl FROM n UNION ALL SELECT doc_id, 'L ' || x, 2 * i + 1 FROM n UNION ALL SELECT doc_id, lang, 100 FROM w UNION ALL SELECT doc_id, 'g' || source, 101 FROM w UNION ALL SELECT doc_id, lang, 102 FROM w),
 u AS (SELECT doc_id, x, min(pl) AS pl FROM t WHERE length(x) > 1 GROUP BY ALL) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'content' ELSE 'content' || chr(10) || string_agg(x, chr(10) ORDER BY pl) END AS text FROM u GROUP BY doc_id""")
def microdata_text(spark, d):
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0)), 1, 4)
    variables = F.transform(words, lambda w: F.struct(w.alias("name"), F.lit("a question").alias("qstn"), F.concat(F.lit("L "), w).alias("labl")))
    record = F.struct(
        F.struct(F.lit("not searched").alias("title")).alias("other"),
        F.struct(F.col("lang").alias("title"), F.lit("skipped").alias("abstract"), F.array(F.concat(F.lit("g"), "source"), "lang").alias("groups")).alias("study_desc"),
        F.struct(variables.alias("variables"), F.lit(3).alias("count")).alias("data_dictionary"),
    )
    kind = F.when(F.pmod("doc_id", F.lit(5)) == 0, "document").otherwise("microdata")
    return table(spark, d, "documents").select("doc_id", NJ.with_microdata_text(F.lit("content"), kind, F.to_json(record)).alias("text"))


@_query("filter_records", """WITH p AS (SELECT doc_id AS k, lang, source FROM documents) SELECT (k + 1)::INTEGER AS sid, lang, source FROM p WHERE k % 5 = 0 UNION ALL SELECT (k + 100001)::INTEGER, lang, 'second' FROM p WHERE k % 5 = 0
 UNION ALL SELECT (k + 1)::INTEGER, lang, source FROM p WHERE k % 5 IN (1, 2)""")
def filter_records(spark, d):
    k = F.col("doc_id")

    def study(sid, source):
        return F.concat(F.lit('{"core_fields": {"catalog_id": '), sid.cast("string"), F.lit('}, "filters": {"lang": ["'), F.col("lang"), F.lit('"], "source": "'), source, F.lit('"}}'))

    own = study(k + 1, F.col("source"))
    form = F.pmod(k, F.lit(5))
    payload = (
        F.when(form == 0, F.concat(F.lit('{"study": {}, "studies": ['), own, F.lit(', {"filters": {}}, 7, '), study(k + 100_001, F.lit("second")), F.lit("]}")))
        .when(form == 1, F.concat(F.lit('{"study": '), own, F.lit("}")))
        .when(form == 2, own)
        .when(form == 3, F.concat(F.lit('{"study": {"core_fields": {"catalog_id": "x"}, "filters": {}}, "k": "'), k.cast("string"), F.lit('"}')))
        .otherwise("{not json")
    )
    found = NJ.filter_records(table(spark, d, "documents").select(payload.alias("payload")))
    return found.select("sid", F.get_json_object("filters", "$.lang[0]").alias("lang"), F.get_json_object("filters", "$.source").alias("source"))


# schemas, sorts and shortcuts


@_query("schema_bind", """SELECT n_nationkey AS idno, CASE WHEN n_nationkey % 7 <> 3 AND n_nationkey % 5 <> 4 THEN 'REF_' || n_regionkey || '_CODE' END AS geo_column, CASE WHEN n_nationkey % 5 <> 4 THEN 'TIME' END AS time_column, CASE WHEN n_nationkey % 5 <> 4 THEN 'OBS' END AS obs_column, NULL::VARCHAR AS freq_column,
 CASE WHEN n_nationkey % 5 <> 4 THEN ['SEX', 'D' || n_regionkey] ELSE [] END AS dimensions, CASE WHEN n_nationkey % 7 <> 3 AND n_nationkey % 5 <> 4 AND n_nationkey % 2 = 0 THEN 'REF_' || n_regionkey || '_NAME' END AS label_column,
 CASE WHEN n_nationkey % 5 = 4 THEN 'Schema API error: gone ' || n_nationkey WHEN n_nationkey % 7 = 3 THEN 'missing: geography' END AS error FROM nation""")
def schema_bind(spark, d):
    """Schema payloads made of the nations: one in five failed, one in seven without a geography."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")

    def part(name, kind):
        return F.struct(name.alias("name"), F.lit(kind).alias("column_type"))

    listed = F.array(
        part(F.lit("SEX"), "dimension"),
        part(F.concat(F.lit("REF_"), r, F.lit("_CODE")), "geography"),
        part(F.lit("TIME"), "time_period"),
        part(F.lit("SEX_NAME"), "attribute"),
        part(F.when(k % 2 == 0, F.concat(F.lit("REF_"), r, F.lit("_NAME"))).otherwise(F.lit("OTHER")), "attribute"),
        part(F.lit("OBS"), "observation_value"),
        part(F.concat(F.lit("D"), r), "dimension"),
    )
    components = F.filter(listed, lambda c: (k % 7 != 3) | (c["column_type"] != "geography"))
    good = F.to_json(F.struct(F.lit("Success").alias("status"), F.struct(F.lit(1).alias("sid"), components.alias("components")).alias("result")))
    payload = F.when(k % 5 == 4, F.concat(F.lit('{"status": "failed", "message": "gone '), k.cast("string"), F.lit('"}'))).otherwise(good)
    return C.bound(table(spark, d, "nation").select(k.alias("idno"), payload.alias("payload")))


@_query("catalog_sort", with_views("studies", f"SELECT sid, nation FROM studies ORDER BY {_fold('nation')} DESC NULLS LAST, year_start DESC NULLS LAST, substr({_fold('title')}, 1, 256) NULLS LAST, sid LIMIT 40"))
def catalog_sort(spark, d):
    return Q.page(Q.with_sort_columns(V.studies(spark, d)), Q.catalog_sort_keys("country", "desc"), 40).select("sid", "nation")


@_query("idno_fast_path", with_views("studies", f"{_fields_sql()} SELECT sid, 'idno' AS found_by FROM studies WHERE idno = 'IDNO_src3_3' UNION ALL SELECT sid, 'words' FROM studies WHERE sid IN (SELECT sid FROM t0 JOIN t1 USING (sid) JOIN t2 USING (sid) JOIN t3 USING (sid) JOIN t4 USING (sid) JOIN t5 USING (sid) JOIN t6 USING (sid) JOIN t7 USING (sid) JOIN t8 USING (sid) WHERE len(list_filter(t0.t || t1.t || t2.t || t3.t || t4.t || t5.t || t6.t || t7.t, lambda x: x = 'attion' OR (left(x, 2) = 'at' AND levenshtein(x, 'attion') <= 1))) > 0 OR list_contains(t8.t, 'attion'))"))
def idno_fast_path(spark, d):
    """One query that is an idno, and one that only looks like one."""
    s = V.studies(spark, d)

    def by_words(query):
        return _lexical(spark, d, query).select("sid")

    return Q.idno_first(s, " idno_SRC3_3 ", by_words).select("sid", F.lit("idno").alias("found_by")).unionByName(Q.idno_first(s, "attion", by_words).select("sid", F.lit("words").alias("found_by")))


# bulk writes with an outcome for each item

_FRESH, _LOST, _SHORT = "chunk_id % 3 <> 0", "chunk_id % 500 = 7", "chunk_id % 250 = 11"
_SENT_SQL = f""", sent AS (SELECT chunk_id, sid, CASE WHEN {_LOST} THEN 'missing vector' WHEN {_SHORT} THEN 'vector has 8 dimensions, not 64' END AS error FROM chunks WHERE {_FRESH})"""


def _index_run(spark, d):
    """Two thirds of the chunks are written over all of them; some have no vector, and some a short one."""
    chunks, folder = V.chunks(spark, d).select("chunk_id", "sid", "embedding"), scratch.shared(spark, "bulk")
    vector = F.when(F.expr(_LOST), F.lit(None)).when(F.expr(_SHORT), F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    fresh = chunks.where(_FRESH).withColumn("embedding", vector)
    documents = fresh.select("sid").distinct().withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    root = f"{folder}/store"
    run = B.index_run(fresh, documents, chunks.select("sid", "chunk_id"), lambda: stores.VectorFiles(f"{root}/chunks", 1, "chunk_id", "embedding", 64), lambda: stores.VectorFiles(f"{root}/studies", 1, "_key", "embedding", 1), f"{folder}/outcomes")
    return run, stores.vector_files(spark, f"{root}/chunks", "chunk_id long, sid int, embedding array<float>", "chunk_id")


@_query("bulk_outcomes", with_views("chunks", f"{_SENT_SQL} SELECT 'chunk' AS kind, chunk_id::VARCHAR AS id, sid::BIGINT AS sid, error IS NULL AS ok, error, error IS NULL AS stored FROM sent UNION ALL SELECT DISTINCT 'study', sid::VARCHAR, sid::BIGINT, true, NULL, false FROM sent"))
def bulk_outcomes(spark, d):
    """The outcome of each item, and whether the store has it as a chunk."""
    run, stored = _index_run(spark, d)
    there = stored.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.lit(True).alias("stored"))
    return run.outcomes.join(there, ["kind", "id"], "left").select("kind", "id", "sid", "ok", "error", F.coalesce("stored", F.lit(False)).alias("stored"))


@_query("bulk_rollup", with_views("chunks", f"{_SENT_SQL}, r AS (SELECT sid, count(*) FILTER (WHERE error IS NULL) AS n_written, count(error) AS n_failed, array_to_string(list_sort(list_distinct(list(error) FILTER (WHERE error IS NOT NULL))), '; ') AS errors FROM sent GROUP BY sid) SELECT r.sid::BIGINT AS sid, n_written, n_failed, coalesce(errors, '') AS errors, CASE WHEN n_failed > 0 THEN 'failed' ELSE 'indexed' END AS state, (SELECT count(*) FROM chunks c WHERE c.sid = r.sid AND (n_failed > 0 OR {_FRESH})) AS n_kept FROM r"))
def bulk_rollup(spark, d):
    """Of each study: chunks written and failed, its errors and state, and how many stored chunks stay."""
    run, _ = _index_run(spark, d)
    kept = run.kept.groupBy("sid").agg(F.count("*").alias("n_kept"))
    return B.rollup(run.outcomes).join(run.states, "sid").join(kept, "sid").select("sid", "n_written", "n_failed", F.array_join("errors", "; ").alias("errors"), "state", "n_kept")


@_query("fetch_needed", with_views("queue", "SELECT object_id AS sid, CASE WHEN doc_id IS NULL THEN 'missing' ELSE 'found' END AS status, lang, source FROM (SELECT DISTINCT object_id FROM queue WHERE object_id > 0 AND change_class IN ('upsert_full', 'upsert_partial')) LEFT JOIN documents ON doc_id = object_id"))
def fetch_needed(spark, d):
    """The records that the changes of a queue need, asked for in batches."""
    needed = V.queue(spark, d).where("change_class IN ('upsert_full', 'upsert_partial')").select(F.col("object_id").alias("sid"))
    got = B.fetch(needed, stores.parquet_records(f"{d}/documents.parquet", "doc_id", ["lang", "source"]), scratch.shared(spark, "fetch"), "lang string, source string")
    return got.select("sid", "status", "body.lang", "body.source")
