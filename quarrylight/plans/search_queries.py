"""Search, vector, text and ingest queries over the study views, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions import scalar as S
from quarrylight.operators import cells
from quarrylight.operators import ingest as I
from quarrylight.operators import inverted
from quarrylight.operators import search as Q
from quarrylight.operators import sketches
from quarrylight.operators import text as T
from quarrylight.operators import vectors as N
from quarrylight.sources import scratch
from quarrylight.sources import views as V
from quarrylight.sources.views import table, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: DuckDB's form of `fold`.
def _fold(x: str) -> str:
    return f"replace(replace(replace(strip_accents(lower({x})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all({_fold(x)}, '[\p{{L}}\p{{N}}]+')"


FILTERS = {"types": ["survey", "table"], "countries": [100, 102, 204], "years": (2000, 2012), "tags": ["en", "fr"], "published": True}
_SQL_TESTS = {
    "types": "dataset_type IN ('survey', 'table')",
    "countries": "list_has_any(countries, [100, 102, 204])",
    "years": "len(list_filter(years, lambda y: y BETWEEN 2000 AND 2012)) > 0",
    "tags": "list_has_any(tags, ['en', 'fr'])",
    "published": "published_mod <> 0",
}


def _where(without: str = "") -> str:
    return " AND ".join(v for k, v in _SQL_TESTS.items() if k != without)


@_query("study_filter_all", with_views("studies", f"SELECT sid, idno FROM studies WHERE {_where()}"))
def study_filter_all(spark, d):
    return Q.filter_studies(V.studies(spark, d), **FILTERS).select("sid", "idno")


ALL_FILTERS = {
    "types": ["survey", "table", "document"], "countries": [100, 101, 102, 204], "regions": [300, 302, 303, 311, 312], "year_from": 1992, "year_to": 2018, "repository": "central",
    "collections": [f"src{i}" for i in range(0, 16, 2)], "form_ids": [1, 2, 3, 4], "data_class_ids": [1, 2], "tags": ["en", "fr", "de", "es"], "topics": [400, 404, 411, 412, 413],
    "databases": ["DB_0", "DB_1", "DB_2", "DB_3"], "facets": {"theme": [1, 2, 3], "method": [1, 2], "empty": []}, "sids": list(range(1, 5000)), "created_from": 10, "created_to": 990, "published": True,
}
_ALL_SQL = """dataset_type IN ('survey', 'table', 'document') AND list_has_any(countries, [100, 101, 102, 204]) AND list_has_any(regions, [300, 302, 303, 311, 312]) AND len(list_filter(years, lambda y: y BETWEEN 1992 AND 2018)) > 0
 AND list_contains(repositories, 'central') AND list_has_any(repositories, ['src0', 'src2', 'src4', 'src6', 'src8', 'src10', 'src12', 'src14']) AND form_id IN (1, 2, 3, 4) AND data_class_id IN (1, 2) AND list_has_any(tags, ['en', 'fr', 'de', 'es'])
 AND list_has_any(topics, [400, 404, 411, 412, 413]) AND list_has_any(databases, ['DB_0', 'DB_1', 'DB_2', 'DB_3']) AND list_has_any(theme, [1, 2, 3]) AND list_has_any(method, [1, 2]) AND sid BETWEEN 1 AND 4999 AND created BETWEEN 10 AND 990 AND published_mod <> 0"""


@_query("study_filters_16", with_views("studies", f"SELECT sid, idno FROM studies WHERE {_ALL_SQL}"))
def study_filters_16(spark, d):
    return Q.filter_studies(V.studies(spark, d), **ALL_FILTERS).select("sid", "idno")


@_query("chunk_filters_16", with_views("studies chunks", f"SELECT chunk_id, sid FROM chunks WHERE sid IN (SELECT sid FROM studies WHERE {_ALL_SQL.replace('IN (1, 2, 3, 4)', 'IN (1, 2, 3, 4, 5)')})"))
def chunk_filters_16(spark, d):
    """The same filters where a chunk holds its study's facets in a struct of its own."""
    s = V.studies(spark, d)
    kept = [c for c in s.columns if c not in ("title", "abstract", "sid")]
    inside = V.chunks(spark, d).select("chunk_id", "sid").join(s.select("sid", F.struct(*kept).alias("filter_facets")), "sid")
    tests = Q.facet_tests(ALL_FILTERS | {"form_ids": [1, 2, 3, 4, 5]}, {c: f"filter_facets.{c}" for c in kept})
    return inside.where(Q._all(list(tests.values()))).select("chunk_id", "sid")


@_query("browse_sort_changed", with_views("studies", f"SELECT sid, changed FROM studies ORDER BY changed DESC NULLS LAST, year_start DESC NULLS LAST, substr({_fold('title')}, 1, 256) NULLS LAST, sid LIMIT 40"))
def browse_sort_changed(spark, d):
    return Q.page(Q.with_sort_columns(V.studies(spark, d)), Q.sort_keys("changed"), 40).select("sid", "changed")


@_query("study_year_multivalued", with_views("studies", "SELECT sid, years FROM studies WHERE len(list_filter(years, lambda y: y BETWEEN 2001 AND 2003)) > 0"))
def study_year_multivalued(spark, d):
    return Q.filter_studies(V.studies(spark, d), years=(2001, 2003)).select("sid", "years")


@_query("study_types_postfilter_counts", with_views("studies", f"SELECT dataset_type, count(DISTINCT sid) AS n FROM studies WHERE {_where('types')} GROUP BY ALL"))
def study_types_postfilter_counts(spark, d):
    return Q.type_counts(V.studies(spark, d), **FILTERS)


def _facets_sql(size: int, selected: str = "false") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{name}' AS facet, unnest(list_distinct({values}::VARCHAR[])) AS value FROM studies WHERE {_where(name)}" for name, values in (("types", "[dataset_type]"), ("countries", "countries"), ("tags", "tags"))
    )
    return f""", p AS ({parts}), c AS (SELECT facet, value, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn, count(*) OVER (PARTITION BY facet) > {size} AS more FROM c)
SELECT facet, value, n, more FROM r WHERE rn <= {size} OR {selected}"""


def _facet_columns():
    return {"types": F.array("dataset_type"), "countries": F.col("countries"), "tags": F.col("tags")}


@_query("facets_disjunctive", with_views("studies", _facets_sql(500)))
def facets_disjunctive(spark, d):
    return Q.facets(V.studies(spark, d), _facet_columns(), FILTERS)


@_query("facets_selected_beyond_size", with_views("studies", _facets_sql(2, "(facet = 'tags' AND value IN ('de', 'src7'))")))
def facets_selected_beyond_size(spark, d):
    return Q.facets(V.studies(spark, d), _facet_columns(), FILTERS, 2, {"tags": ["de", "src7"]})


@_query("facets_years_range", with_views("studies", f"SELECT min(list_min(years)) AS min_year, max(list_max(years)) AS max_year FROM studies WHERE {_where('years')}"))
def facets_years_range(spark, d):
    return Q.year_range(V.studies(spark, d), FILTERS)


@_query("facets_user", with_views("studies", "SELECT 'fq_source' AS facet, tags[2] AS value, count(*) AS n, false AS more FROM studies WHERE published_mod <> 0 GROUP BY tags[2]"))
def facets_user(spark, d):
    return Q.facets(V.studies(spark, d), {"fq_source": F.array(F.get("tags", F.lit(1)))}, {"published": True})


@_query("facets_flat", with_views("chunks", """, p AS (SELECT 'qfield' AS facet, qfield AS value FROM chunks UNION ALL SELECT 'resource', resource_id FROM chunks UNION ALL SELECT 'label', label::VARCHAR FROM chunks)
SELECT facet, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY ALL"""))
def facets_flat(spark, d):
    return Q.flat_facets(V.chunks(spark, d), {"qfield": F.array("qfield"), "resource": F.array("resource_id"), "label": F.array("label")})


_SORTED = f", s AS (SELECT *, substr({_fold('title')}, 1, 256) AS title_sort, {_fold('nation')} AS nation_sort FROM studies)"


def _sorted(spark, d):
    return Q.with_sort_columns(V.studies(spark, d))


@_query("browse_sort_title", with_views("studies", _SORTED + ", o AS (SELECT sid, title_sort, row_number() OVER (ORDER BY title_sort NULLS LAST, year_start DESC NULLS LAST, sid) AS pos FROM s) SELECT sid, title_sort FROM o WHERE pos <= 100"))
def browse_sort_title(spark, d):
    return Q.page(_sorted(spark, d), Q.sort_keys("title"), 100).select("sid", "title_sort")


@_query("browse_sort_nulls_last", with_views("studies", _SORTED + ", o AS (SELECT sid, nation, row_number() OVER (ORDER BY nation_sort DESC NULLS LAST, year_start DESC NULLS LAST, title_sort NULLS LAST, sid) AS pos FROM s) SELECT sid, nation FROM o WHERE pos > 850 AND pos <= 950"))
def browse_sort_nulls_last(spark, d):
    return _sorted(spark, d).orderBy(*Q.ordering(Q.sort_keys("nation", False))).offset(850).limit(100).select("sid", "nation")


@_query("browse_offset", with_views("studies", _SORTED + " SELECT sid, views FROM s ORDER BY views DESC NULLS LAST, year_start DESC NULLS LAST, title_sort NULLS LAST, sid LIMIT 40 OFFSET 120"))
def browse_offset(spark, d):
    return _sorted(spark, d).orderBy(*Q.ordering(Q.sort_keys("popularity"))).offset(120).limit(40).select("sid", "views")


_YEAR_ORDER = "year_start DESC NULLS LAST, title_sort NULLS LAST, sid"


def _anchor(spark, d, sid: int = 101):
    """Sort values of the row that a cursor stands on."""
    keys = Q.sort_keys("year")
    row = _sorted(spark, d).where(F.col("sid") == sid).select(*(c for c, _ in keys)).first()
    return keys, list(row)


@_query("browse_keyset_after", with_views("studies", _SORTED + f", o AS (SELECT sid, year_start, row_number() OVER (ORDER BY {_YEAR_ORDER}) AS pos FROM s), a AS (SELECT pos AS here FROM o WHERE sid = 101) SELECT sid, year_start FROM o, a WHERE pos > here AND pos <= here + 50"))
def browse_keyset_after(spark, d):
    keys, values = _anchor(spark, d)
    return Q.page(_sorted(spark, d), keys, 50, values).select("sid", "year_start")


@_query("browse_keyset_before", with_views("studies", _SORTED + f", o AS (SELECT sid, year_start, row_number() OVER (ORDER BY {_YEAR_ORDER}) AS pos FROM s), a AS (SELECT pos AS here FROM o WHERE sid = 101) SELECT sid, year_start FROM o, a WHERE pos < here AND pos >= here - 50"))
def browse_keyset_before(spark, d):
    keys, values = _anchor(spark, d)
    return Q.page(_sorted(spark, d), keys, 50, values, before=True).select("sid", "year_start")


_DOT = "list_inner_product(embedding::DOUBLE[], q)"
_SCORE = f"(1 + {_DOT} / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(q, q)))) / 2"


def _knn_sql(where: str = "true") -> str:
    return f", qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), k AS (SELECT c.*, {_SCORE} AS score FROM chunks c, qv WHERE {where})"


def _vector(spark, d):
    return N.vector_of(table(spark, d, "embeddings"), "vec_id", 7)


@_query("collapse_inner_hits", with_views("chunks", _knn_sql() + """, r AS (SELECT coalesce(resource_id, '#' || chunk_id) AS g, chunk_id, score, row_number() OVER (PARTITION BY coalesce(resource_id, '#' || chunk_id) ORDER BY score DESC, chunk_id) AS rn FROM k)
SELECT max(chunk_id) FILTER (WHERE rn = 1) AS chunk_id, round(max(score), 6) AS score, list(chunk_id ORDER BY rn) AS inner_hits FROM r WHERE rn <= 3 GROUP BY g"""))
def collapse_inner_hits(spark, d):
    return Q.collapse(N.scored(V.chunks(spark, d), _vector(spark, d)), "resource_id", "score", "chunk_id", 3).withColumn("score", _six())


@_query("explain_filters", with_views("chunks", """, c AS (SELECT * FROM chunks WHERE chunk_id = 12), p AS (SELECT chunk_id, 'page' AS field, '>= 2' AS expected, page::VARCHAR AS actual, page >= 2 AS matched FROM c UNION ALL
 SELECT chunk_id, 'qfield', 'passages', qfield, qfield = 'passages' FROM c UNION ALL SELECT chunk_id, 'resource_id', '1', resource_id, coalesce(resource_id = '1', false) FROM c)
SELECT *, bool_and(matched) OVER () AS all_matched FROM p"""))
def explain_filters(spark, d):
    tests = {"page": (">= 2", F.col("page"), F.col("page") >= 2), "qfield": ("passages", F.col("qfield"), F.col("qfield") == "passages"), "resource_id": ("1", F.col("resource_id"), F.col("resource_id") == "1")}
    return Q.explain(V.chunks(spark, d).where("chunk_id = 12").limit(1), tests)


@_query("exact_idno", with_views("studies", f"SELECT sid, idno FROM studies WHERE {_fold('idno')} = 'idno_src3_3'"))
def exact_idno(spark, d):
    return Q.exact_idno(V.studies(spark, d), '"IDNO_SRC3_3"').select("sid", "idno")


@_query("title_complete", with_views("studies", rf"SELECT sid FROM studies WHERE list_has_all(regexp_extract_all({_fold('title')}, '\p{{L}}+|\p{{Nd}}+'), ['anea', 'attion', 'eriner'])"))
def title_complete(spark, d):
    return Q.title_complete(V.studies(spark, d), "what is the anea of attion with their eriner").select("sid")


@_query("quoted_phrase_split", r"""WITH q AS (SELECT event_id, 'data "' || event_type || ' rate" of ' || user_id || ' "x' AS q FROM events)
SELECT event_id, list_transform(regexp_extract_all(q, '"([^"]*)"', 1), lambda x: trim(x)) AS phrases, trim(regexp_replace(replace(regexp_replace(q, '"[^"]*"', ' ', 'g'), '"', ' '), '\s+', ' ', 'g')) AS rest FROM q""")
def quoted_phrase_split(spark, d):
    e = table(spark, d, "events")
    q = F.concat(F.lit("data “"), "event_type", F.lit(" rate” of "), F.col("user_id").cast("string"), F.lit(' "x'))
    phrases, rest = S.quoted_phrases(q)
    return e.select("event_id", phrases.alias("phrases"), rest.alias("rest"))


@_query("variables_semi_join", with_views("studies variables", f"SELECT uid, sid, name FROM variables WHERE sid IN (SELECT sid FROM studies WHERE {_where()})"))
def variables_semi_join(spark, d):
    return Q.variables_of(V.variables(spark, d), V.studies(spark, d), **FILTERS).select("uid", "sid", "name")


@_query("variables_sort_title_name", with_views("studies variables", _SORTED + " SELECT uid, name, title_sort FROM variables JOIN s USING (sid) ORDER BY title_sort NULLS LAST, name, uid LIMIT 200"))
def variables_sort_title_name(spark, d):
    rows = V.variables(spark, d).join(_sorted(spark, d).select("sid", "title_sort"), "sid")
    return rows.orderBy(F.col("title_sort").asc_nulls_last(), "name", "uid").limit(200).select("uid", "name", "title_sort")


@_query("citations_filter_sort", with_views("citations", "SELECT citation_id, title, pub_year FROM citations WHERE published = 1 AND ctype IN ('book', 'report') AND pub_year BETWEEN 2003 AND 2015 ORDER BY pub_year DESC, title, citation_id LIMIT 50"))
def citations_filter_sort(spark, d):
    rows = V.citations(spark, d).where("published = 1 AND ctype IN ('book', 'report') AND pub_year BETWEEN 2003 AND 2015")
    return rows.orderBy(F.desc("pub_year"), "title", "citation_id").limit(50).select("citation_id", "title", "pub_year")


@_query("citations_doi_exact", with_views("citations", "SELECT citation_id, doi FROM citations WHERE lower(doi) = '10.1000/ref.12'"))
def citations_doi_exact(spark, d):
    return V.citations(spark, d).where(S.fold(F.col("doi")) == S.fold(F.lit("10.1000/REF.12"))).select("citation_id", "doi")


CITED = {"title": 5.0, "authors": 3.0, "subtitle": 2.0, "keywords": 2.0, "abstract": 1.0, "notes": 1.0}
_CITED = {"title": "substr(text, 1, 40)", "authors": "'Ann Author ' || item_id % 7", "subtitle": "substr(text, 41, 40)", "keywords": "'ref ' || ['book', 'journal', 'report'][item_id % 3 + 1]", "abstract": "text", "notes": "CASE WHEN item_id % 5 = 0 THEN 'ref 12' END"}


def _cited_sql(words: list[str], doi: str) -> str:
    out, best = [], []
    for n, (f, boost) in enumerate(CITED.items()):
        tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
        df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(words)))
        part = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(len(words)))
        out.append(f"c{n} AS (SELECT k, len(t) AS dl, {tf} FROM (SELECT item_id + 1 AS k, {_tokens(f'coalesce({_CITED[f]}, {chr(39) * 2})')} AS t FROM benchmark) WHERE len(t) > 0), s{n} AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM c{n})")
        best.append(f"SELECT k, {boost} * ({part}) AS s FROM c{n}, s{n} WHERE {' + '.join(f'f{i}' for i in range(len(words)))} > 0")
    return f"""WITH {', '.join(out)}, b AS (SELECT k, max(s) AS s FROM ({' UNION ALL '.join(best)}) GROUP BY k),
 doi AS (SELECT item_id + 1 AS k, 10 * ln(1 + ((SELECT count(*) FROM benchmark) - 1 + 0.5) / 1.5) AS s FROM benchmark WHERE lower('10.1000/Ref.' || item_id) = '{doi}')
SELECT k AS citation_id, round(sum(s), 4) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM doi) GROUP BY k"""


@_query("citations_query", _cited_sql(["10", "1000", "ref", "12"], "10.1000/ref.12"))
def citations_query(spark, d):
    query = "10.1000/REF.12"
    rows = table(spark, d, "benchmark")
    fields = {
        "title": F.substring("text", 1, 40), "authors": F.concat(F.lit("Ann Author "), F.pmod("item_id", F.lit(7)).cast("string")), "subtitle": F.substring("text", 41, 40),
        "keywords": F.concat(F.lit("ref "), F.element_at(F.array(*map(F.lit, ("book", "journal", "report"))), (F.pmod("item_id", F.lit(3)) + 1).cast("int"))), "abstract": F.col("text"), "notes": F.when(F.pmod("item_id", F.lit(5)) == 0, "ref 12"),
    }
    index = inverted.stored(rows.withColumn("citation_id", F.col("item_id") + 1), "citation_id", fields, scratch.base(spark))
    return Q.citation_search(V.citations(spark, d), index.best_field(CITED, query), query).withColumn("score", F.round("score", 4))


@_query("authors_format", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ann B ' || event_type || '; U' || user_id WHEN 1 THEN 'Plain ' || event_type WHEN 2 THEN '' ELSE '' END AS authors FROM events""")
def authors_format(spark, d):
    k = F.pmod("event_id", F.lit(4))
    user = F.col("user_id").cast("string")
    raw = F.when(k == 0, F.concat(F.lit('[{"fname":"Ann","initial":"B","lname":"'), "event_type", F.lit('"},{"fname":"U'), user, F.lit('"}]'))).when(k == 1, F.concat(F.lit("Plain "), "event_type")).when(k == 2, "[{}]")
    return table(spark, d, "events").select("event_id", S.format_authors(raw).alias("authors"))


@_query("excerpts", r"SELECT doc_id, nullif(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400), '') AS excerpt FROM documents")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt"))


# vectors and fusion: ranks are by the full score, the output is rounded


def _six():
    return F.round("score", 6).alias("score")



@_query("knn_topk", with_views("chunks", _knn_sql() + " SELECT chunk_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 20"))
def knn_topk(spark, d):
    return N.knn(V.chunks(spark, d), _vector(spark, d), 20).select("chunk_id", _six())


@_query("knn_prefiltered", with_views("chunks", _knn_sql("label = 3 AND qfield = 'passages'") + " SELECT chunk_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 20"))
def knn_prefiltered(spark, d):
    return N.knn(V.chunks(spark, d), _vector(spark, d), 20, (F.col("label") == 3) & (F.col("qfield") == "passages")).select("chunk_id", _six())


@_query("knn_threshold", with_views("chunks", _knn_sql() + " SELECT chunk_id, round(score, 6) AS score FROM k WHERE k.score >= 0.6 ORDER BY k.score DESC, chunk_id LIMIT 500"))
def knn_threshold(spark, d):
    return N.knn(V.chunks(spark, d), _vector(spark, d), 500, threshold=0.6).select("chunk_id", _six())


_BLOCK = """, n AS (SELECT * FROM k ORDER BY score DESC, chunk_id LIMIT 1000), b AS (SELECT sid, max(score) AS score FROM n GROUP BY sid),
 blk AS (SELECT sid, score FROM b WHERE score >= greatest(0.5, (SELECT max(score) FROM b) * 0.6) ORDER BY score DESC, sid LIMIT 50)"""


@_query("semantic_policy", with_views("chunks", _knn_sql() + _BLOCK + " SELECT sid, round(score, 6) AS score FROM blk"))
def semantic_policy(spark, d):
    return N.semantic_block(V.chunks(spark, d), _vector(spark, d), floor=0.5, cutoff=0.6).withColumn("score", _six())


@_query("semantic_policy_contract", with_views("chunks", _knn_sql() + _BLOCK.replace("0.5", "0.7").replace("0.6", "0.94") + " SELECT sid, round(score, 6) AS score FROM blk"))
def semantic_policy_contract(spark, d):
    return N.semantic_block(V.chunks(spark, d), _vector(spark, d)).withColumn("score", _six())


@_query("semantic_collapse", with_views("chunks", _knn_sql("qfield = 'passages' AND page >= 0 AND try_cast(resource_id AS INTEGER) > 0") + """, n AS (SELECT *, resource_id::INTEGER AS resource FROM k ORDER BY score DESC, chunk_id LIMIT 1000),
 o AS (SELECT *, row_number() OVER (PARTITION BY sid, resource, page ORDER BY score DESC, chunk_id) AS rn FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, resource, page) AS place FROM o WHERE rn = 1)
SELECT sid, place, resource, page + 1 AS page, round(score, 4) AS score FROM p WHERE place <= 5"""))
def semantic_collapse(spark, d):
    return N.passages(V.chunks(spark, d), _vector(spark, d))


#: A keyword list for fusion: studies with a word, most viewed first.
_KEYWORD = ", kw AS (SELECT sid, row_number() OVER (ORDER BY views DESC, sid) AS pos FROM studies WHERE contains(abstract, ' tion ') ORDER BY views DESC, sid LIMIT 50), sem AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS pos FROM blk)"


def _keyword(spark, d, limit: int | None = 50):
    rows = V.studies(spark, d).where(F.contains("abstract", F.lit(" tion "))).select("sid", "views")
    rows = rows.orderBy(F.desc("views"), "sid").limit(limit) if limit else rows
    return rows.select("sid", F.row_number().over(Window.orderBy(F.desc("views"), "sid")).alias("pos"))


def _semantic(spark, d):
    block = N.semantic_block(V.chunks(spark, d), _vector(spark, d), floor=0.5, cutoff=0.6)
    return block.select("sid", F.row_number().over(Window.orderBy(F.desc("score"), "sid")).alias("pos"))


_RRF = ", u AS (SELECT sid, pos, 0 AS l FROM kw UNION ALL SELECT sid, pos, 1 FROM sem), f AS (SELECT sid, sum(1 / (60 + pos)) AS score, list_sort(list(DISTINCT l)) AS matched_by, min(l * 1000 + pos) AS seen FROM u GROUP BY sid)"


@_query("rrf_fuse", with_views("chunks studies", _knn_sql() + _BLOCK + _KEYWORD + _RRF + " SELECT sid, round(score, 10) AS score, matched_by, row_number() OVER (ORDER BY f.score DESC, sid) AS pos FROM f"))
def rrf_fuse(spark, d):
    return N.rrf([_keyword(spark, d), _semantic(spark, d)], "sid").withColumn("score", F.round("score", 10))


@_query("rrf_passage", with_views("chunks studies", _knn_sql() + _BLOCK + _KEYWORD + _RRF + " SELECT sid, round(score, 10) AS score, matched_by, row_number() OVER (ORDER BY f.score DESC, seen) AS pos FROM f"))
def rrf_passage(spark, d):
    return N.rrf([_keyword(spark, d), _semantic(spark, d)], "sid", tie_first_seen=True).withColumn("score", F.round("score", 10))


_ALL_KW = ", ak AS (SELECT sid, row_number() OVER (ORDER BY sid) AS pos FROM studies WHERE contains(abstract, ' tion '))"


@_query("hybrid_head_tail", with_views("chunks studies", _knn_sql() + _BLOCK + _KEYWORD + _RRF + ", h AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS pos FROM f) SELECT sid, 0 AS block, pos FROM h UNION ALL SELECT sid, 1, sid FROM studies WHERE contains(abstract, ' tion ') AND sid NOT IN (SELECT sid FROM h)"))
def hybrid_head_tail(spark, d):
    head = N.rrf([_keyword(spark, d), _semantic(spark, d)], "sid")
    tail = V.studies(spark, d).where(F.contains("abstract", F.lit(" tion "))).select("sid", F.col("sid").alias("pos"))
    return N.head_and_tail(head, tail, "sid")


@_query("hybrid_other_sort", with_views("chunks studies", _knn_sql() + _BLOCK + ", w AS (SELECT sid FROM blk UNION SELECT sid FROM studies WHERE contains(abstract, ' tion ')) SELECT s.sid, created FROM studies s JOIN w USING (sid) ORDER BY created DESC, sid LIMIT 60"))
def hybrid_other_sort(spark, d):
    s = V.studies(spark, d)
    ids = _semantic(spark, d).select("sid").unionByName(s.where(F.contains("abstract", F.lit(" tion "))).select("sid")).dropDuplicates(["sid"])
    return s.join(ids, "sid", "left_semi").orderBy(F.desc("created"), "sid").limit(60).select("sid", "created")


def _fuse_sql(how: str) -> str:
    return f""", x AS (SELECT sid, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM chunks), p AS (SELECT sid, i, {how}(x) AS x FROM x GROUP BY ALL), l AS (SELECT sid, sqrt(sum(x * x)) AS len FROM p GROUP BY sid)
SELECT p.sid, (i - 1)::INTEGER AS i, round(x / len, 6) AS x FROM p JOIN l USING (sid)"""


@_query("fuse_mean", with_views("chunks", _fuse_sql("avg")))
def fuse_mean(spark, d):
    return N.fuse(V.chunks(spark, d), "sid").select("sid", F.posexplode("embedding").alias("i", "x")).select("sid", "i", F.round("x", 6).alias("x"))


@_query("fuse_max_pool", with_views("chunks", _fuse_sql("max")))
def fuse_max_pool(spark, d):
    return N.fuse(V.chunks(spark, d), "sid", "max").select("sid", F.posexplode("embedding").alias("i", "x")).select("sid", "i", F.round("x", 6).alias("x"))


@_query("recommend", with_views("chunks", f""", x AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM chunks WHERE sid = 5), p AS (SELECT i, avg(x) AS x FROM x GROUP BY i), qv AS (SELECT list(x ORDER BY i) AS q FROM p)
SELECT chunk_id, round({_SCORE}, 5) AS score FROM chunks, qv WHERE sid <> 5 ORDER BY {_SCORE} DESC, chunk_id LIMIT 25"""))
def recommend(spark, d):
    return N.recommend(V.chunks(spark, d), 5, 25).select("chunk_id", F.round("score", 5).alias("score"))


def chunk_cells(spark, d):
    """The stored cells of the passages' vectors, built at their first use."""
    return cells.stored(V.chunks(spark, d), "chunk_id", scratch.base(spark))


@_query("knn_cells", with_views("chunks", _knn_sql() + " SELECT chunk_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 20"))
def knn_cells(spark, d):
    return chunk_cells(spark, d).exact(_vector(spark, d), 20).select("chunk_id", F.round("score", 6).alias("score"))


@_query("knn_cells_filtered", with_views("chunks", _knn_sql("qfield = 'title' AND label = 3") + " SELECT chunk_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, chunk_id LIMIT 10"))
def knn_cells_filtered(spark, d):
    return chunk_cells(spark, d).exact(_vector(spark, d), 10, F.expr("qfield = 'title' AND label = 3")).select("chunk_id", F.round("score", 6).alias("score"))


@_query("distinct_studies", with_views("chunks", "SELECT coalesce(qfield, 'all') AS part, count(DISTINCT sid) AS n FROM chunks GROUP BY GROUPING SETS ((qfield), ())"))
def distinct_studies(spark, d):
    """Distinct studies by sketches of each (qfield, page), merged."""
    parts = sketches.sketched(V.chunks(spark, d), "sid", "qfield", "page")
    fields = sketches.merged(parts, "qfield")
    whole = sketches.merged(parts).select(F.lit("all").alias("part"), "sketch")
    return sketches.estimated(fields.select(F.col("qfield").alias("part"), "sketch").unionByName(whole))


# text

TERMS = ["tion", "hation", "ereading", "the"]
_terms = "['tion', 'hation', 'ereading', 'the']"


@_query("tokenize_terms", f"SELECT doc_id, unnest({_tokens('text')}) AS term, count(*) AS n FROM documents GROUP BY ALL".replace("SELECT doc_id, unnest(", "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(").replace(") AS term, count(*) AS n FROM documents GROUP BY ALL", ") AS term FROM documents) GROUP BY ALL"))
def tokenize_terms(spark, d):
    return T.postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", F.col("tf").alias("n"))


@_query("df_idf", f", t AS (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents), c AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM c".replace(", t AS", "WITH t AS", 1))
def df_idf(spark, d):
    return T.document_frequency(table(spark, d, "documents"), "doc_id", "text")


def _bm25_sql(view: str, key: str, field: str, minimum: int, name: str) -> str:
    parts = " + ".join(f"CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a)) ELSE 0 END" for i in range(4))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(TERMS))
    d = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(4))
    m = " + ".join(f"(f{i} > 0)::INTEGER" for i in range(4))
    return f"""{name}_t AS (SELECT {key}, {_tokens(f"coalesce({field}, '')")} AS t FROM {view}), {name}_c AS (SELECT {key}, len(t) AS dl, {tf} FROM {name}_t), {name}_s AS (SELECT count(*) AS n, avg(dl) AS a, {d} FROM {name}_c WHERE dl > 0),
 {name} AS (SELECT {key}, {parts} AS score, {m} AS matched FROM {name}_c, {name}_s WHERE {m} >= {minimum})"""


@_query("bm25_single_field", "WITH " + _bm25_sql("documents", "doc_id", "text", 1, "b") + " SELECT doc_id, round(score, 6) AS score, matched FROM b")
def bm25_single_field(spark, d):
    return documents_index(spark, d).scores(TERMS, ["text"]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


def documents_index(spark, d):
    """The stored index of the documents, built at its first use."""
    return inverted.stored(table(spark, d, "documents").select("doc_id", "text"), "doc_id", {"text": F.col("text")}, scratch.base(spark))


@_query("bm25_scan", "WITH " + _bm25_sql("documents", "doc_id", "text", 1, "b") + " SELECT doc_id, round(score, 6) AS score, matched FROM b")
def bm25_scan(spark, d):
    return T.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("score", 6).alias("score"), "matched")


@_query("bm25_top", "WITH " + _bm25_sql("documents", "doc_id", "text", 1, "b") + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 25")
def bm25_top(spark, d):
    return documents_index(spark, d).top(TERMS, "text", 25).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@_query("index_segments", "WITH " + _bm25_sql("(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' the ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)", "doc_id", "text", 1, "b") + " SELECT doc_id, round(score, 6) AS score, matched FROM b")
def index_segments(spark, d):
    """Segments: two thirds and all documents as they were, then a third changed and a seventh deleted."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    index = inverted.Index(spark, scratch.shared(spark, "segments")).add(docs, "doc_id", {"text": F.col("text")})
    changed = docs.where((k % 3 == 0) & (k % 7 != 0)).withColumn("text", F.concat("lang", F.lit(" the "), "text"))
    index = index.add(changed, "doc_id", {"text": F.col("text")}, deleted=docs.where(k % 7 == 0).select(k.alias("key")))
    return index.scores(TERMS, ["text"]).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "matched")


@_query("msm_match_set", "WITH " + _bm25_sql("documents", "doc_id", "text", 3, "b") + " SELECT doc_id FROM b")
def msm_match_set(spark, d):
    return documents_index(spark, d).scores(TERMS, ["text"]).where(F.col("matched") >= T.required(len(TERMS))).select(F.col("key").alias("doc_id"))


@_query("lexical_multi_field", with_views("studies", ", " + _bm25_sql("studies", "sid", "title", 3, "b1") + ", " + _bm25_sql("studies", "sid", "abstract", 3, "b2") + ", u AS (SELECT sid, 40 * score AS s FROM b1 UNION ALL SELECT sid, 10 * score FROM b2) SELECT sid, round(sum(s), 4) AS score FROM u GROUP BY sid"))
def lexical_multi_field(spark, d):
    return T.multi_field(V.studies(spark, d), "sid", {"title": 40.0, "abstract": 10.0}, TERMS).withColumn("score", F.round("score", 4))


@_query("fuzzy_expand", f"WITH t AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM documents), q AS (SELECT unnest(['hation', 'ereading', 'the']) AS query_term, unnest([1, 1, 0]) AS k) SELECT query_term, term FROM t, q WHERE left(term, 2) = left(query_term, 2) AND levenshtein(term, query_term) <= k")
def fuzzy_expand(spark, d):
    return documents_index(spark, d).forms(["hation", "ereading", "the"])


@_query("phrase_exact", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_tokens('text')}, ' ') || ' ', ' with bleonen this from ')")
def phrase_exact(spark, d):
    return T.phrase(table(spark, d, "documents"), "text", "With bleonen. THIS from,").select("doc_id")


@_query("all_terms_match", f"SELECT doc_id FROM documents WHERE list_has_all({_tokens('text')}, ['tion', 'herean'])")
def all_terms_match(spark, d):
    return T.all_terms(table(spark, d, "documents"), "text", ["tion", "herean"]).select("doc_id")


# ingest, change queue, metrics

_BAD = "bad AS (SELECT CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 9 = 1 THEN substr(text, 1, 5) ELSE text END AS page_content, CASE WHEN doc_id % 15 <> 2 THEN 'D' || (doc_id % 40) END AS idno, CASE WHEN doc_id % 25 <> 3 THEN lang ELSE '' END AS type FROM documents)"


@_query("quality_report", f"""WITH {_BAD}, i AS (SELECT idno, unnest(list_filter([CASE WHEN trim(page_content) = '' THEN 'empty_page_content' END, CASE WHEN trim(page_content) <> '' AND length(trim(page_content)) < 20 THEN 'very_short_page_content' END,
 CASE WHEN coalesce(idno, '') = '' THEN 'missing_idno' END, CASE WHEN type = '' THEN 'missing_type' END], lambda x: x IS NOT NULL)) AS issue FROM bad), s AS (SELECT issue, idno, row_number() OVER (PARTITION BY issue ORDER BY idno) AS rn FROM (SELECT DISTINCT issue, idno FROM i WHERE idno IS NOT NULL))
SELECT c.issue, c.n, l.samples FROM (SELECT issue, count(*) AS n FROM i GROUP BY issue) c LEFT JOIN (SELECT issue, list(idno ORDER BY idno) AS samples FROM s WHERE rn <= 20 GROUP BY issue) l USING (issue)""")
def quality_report(spark, d):
    k = F.col("doc_id")
    m = lambda n: F.pmod(k, F.lit(n))
    rows = table(spark, d, "documents").select(
        F.when(m(9) == 0, " ").when(m(9) == 1, F.substring("text", 1, 5)).otherwise(F.col("text")).alias("page_content"),
        F.when(m(15) != 2, F.concat(F.lit("D"), m(40).cast("string"))).alias("idno"),
        F.when(m(25) != 3, F.col("lang")).otherwise("").alias("type"),
    )
    return I.quality_report(rows)


@_query("ingest_reject_split", with_views("studies", "SELECT sid - 1 AS catalog_id, idno, CASE t WHEN 'survey' THEN 'microdata' WHEN 'timeseries' THEN 'indicator' WHEN 'timeseriesdb' THEN 'indicator-db' WHEN 'timeseries-db' THEN 'indicator-db' WHEN 'novel' THEN NULL ELSE t END AS type, CASE WHEN sid - 1 <= 0 THEN 'catalog_id' WHEN t = 'novel' THEN 'dataset_type' END AS rejected FROM (SELECT *, CASE WHEN sid % 3 = 0 THEN ['script', 'image', 'video', 'timeseriesdb', 'timeseries-db', 'geospatial', 'novel'][sid % 7 + 1] ELSE dataset_type END AS t FROM studies)"))
def ingest_reject_split(spark, d):
    others = F.array(*map(F.lit, ("script", "image", "video", "timeseriesdb", "timeseries-db", "geospatial", "novel")))
    kind = F.when(F.col("sid") % 3 == 0, F.get(others, F.col("sid") % 7)).otherwise(F.col("dataset_type"))
    return I.validated(V.studies(spark, d).select((F.col("sid") - 1).alias("catalog_id"), "idno", kind.alias("dataset_type")))


@_query("upsert_latest", with_views("queue", ", c AS (SELECT object_id, id AS version, value FROM queue WHERE id % 3 = 0), n AS (SELECT object_id, id AS version, value FROM queue WHERE id % 3 <> 0), u AS (SELECT * FROM c UNION ALL SELECT * FROM n) SELECT object_id, max(version) AS version, arg_max(value, version) AS value FROM u GROUP BY object_id"))
def upsert_latest(spark, d):
    q = V.queue(spark, d).select("object_id", F.col("id").alias("version"), "value")
    return I.upsert_latest(q.where("version % 3 = 0"), q.where("version % 3 <> 0"), "object_id", "version")


@_query("prune_stale", with_views("chunks", "SELECT sid, chunk_id FROM chunks WHERE sid > 30 OR sid = 4 OR chunk_id % 2 = 0"))
def prune_stale(spark, d):
    c = V.chunks(spark, d).select("sid", "chunk_id")
    # every chunk has an even or odd id by study: a fresh run of 30 studies keeps the even ones
    fresh = c.where("sid <= 30 AND chunk_id % 2 = 0").unionByName(c.where("sid <= 30").select("sid", F.lit(-1).cast("long").alias("chunk_id")).distinct())
    return I.prune_stale(c, fresh, spark.createDataFrame([(4,)], "sid int"))


@_query("vector_reuse", with_views("chunks", "SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 256 ELSE 512 END AS cap, chunk_id % 3 <> 0 AND chunk_id % 5 <> 0 AS reused FROM chunks"))
def vector_reuse(spark, d):
    c = V.chunks(spark, d)
    stored = c.where("chunk_id % 5 <> 0").select("chunk_id", "embedding", F.lit(512).alias("cap"), F.lit("m1").alias("model"))
    fresh = c.select("chunk_id", F.when(F.pmod("chunk_id", F.lit(3)) == 0, 256).otherwise(512).alias("cap"), F.lit("m1").alias("model"))
    out = I.vector_reuse(fresh, stored)
    return out.select("chunk_id", "cap", (~F.col("embed") & F.col("embedding").isNotNull()).alias("reused"))


@_query("diff_missing_stale", with_views("studies chunks", ", i AS (SELECT DISTINCT sid * 3 AS sid FROM chunks), c AS (SELECT sid FROM studies WHERE sid % 2 = 0) SELECT sid, 'missing' AS change FROM c WHERE sid NOT IN (SELECT sid FROM i) UNION ALL SELECT sid, 'stale' FROM i WHERE sid NOT IN (SELECT sid FROM c)"))
def diff_missing_stale(spark, d):
    return I.diff(V.studies(spark, d).where("sid % 2 = 0").select("sid"), V.chunks(spark, d).select((F.col("sid") * 3).alias("sid")), "sid")


def _facet_map():
    return F.map_from_arrays(
        F.array(*map(F.lit, ("tags", "blank", "lang"))), F.array(F.transform(F.col("tags"), lambda t: F.concat(F.lit(" "), t, F.lit(" "))), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.get("tags", F.lit(0)), F.get("tags", F.lit(0))))
    )


@_query("facet_normalize", with_views("studies", "SELECT sid, 'lang' AS key, [tags[1]] AS \"values\" FROM studies UNION ALL SELECT sid, 'tags', tags FROM studies"))
def facet_normalize(spark, d):
    rows = V.studies(spark, d).select("sid", F.explode(I.normalized_facets(_facet_map())).alias("e"))
    return rows.select("sid", F.col("e.key").alias("key"), F.col("e.value").alias("values"))


@_query("facet_autoregister", "SELECT DISTINCT source AS key FROM documents WHERE source NOT IN ('src1', 'src2', 'src3')")
def facet_autoregister(spark, d):
    return I.new_facet_keys(table(spark, d, "documents").select(F.create_map("source", "lang").alias("facets")), "facets", ["src1", "src2"], ["src3"])


@_query("cdc_coalesce_latest", with_views("queue", "SELECT object_id, max(id) AS id, arg_max(change_class, changed) AS change_class, max(changed) AS changed FROM queue GROUP BY object_id"))
def cdc_coalesce_latest(spark, d):
    return I.coalesce_latest(V.queue(spark, d))


@_query("cdc_ack_version", with_views("queue", "SELECT id, changed, CASE WHEN id % 3 = 0 THEN 'pending' WHEN id % 5 = 0 THEN 'conflict' ELSE 'done' END AS status FROM queue"))
def cdc_ack_version(spark, d):
    q = V.queue(spark, d)
    acks = q.where("id % 3 <> 0").select("id", F.when(F.pmod("id", F.lit(5)) == 0, F.col("changed") - 1).otherwise(F.col("changed")).alias("changed"))
    return I.acknowledged(q, acks)


_EVAL = """g AS (SELECT label AS query, vec_id AS doc, (vec_id % 4)::INTEGER AS grade FROM embeddings), r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc * 37 % 101, doc) AS pos FROM g QUALIFY pos <= 15),
 i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS k FROM g), p AS (SELECT query, sum(CASE WHEN k <= 10 THEN (2.0 ** grade - 1) / log2(k + 1) ELSE 0 END) AS idcg, count(*) FILTER (WHERE grade >= 2) AS relevant, least(2, max(grade)) AS least_ FROM i GROUP BY query),
 h AS (SELECT r.query, pos, grade, idcg, relevant, least_ FROM r JOIN g USING (query, doc) JOIN p ON p.query = r.query)
SELECT query, round(coalesce(sum(CASE WHEN pos <= 10 THEN (2.0 ** grade - 1) / log2(pos + 1) ELSE 0 END) / nullif(any_value(idcg), 0), 0), 6) AS ndcg, round(count(*) FILTER (WHERE pos <= 10 AND grade > 0) / 10, 6) AS "precision",
 round(coalesce(1 / min(pos) FILTER (WHERE grade >= least_ AND grade > 0), 0), 6) AS mrr, round(count(*) FILTER (WHERE grade >= 2) / nullif(any_value(relevant), 0), 6) AS recall FROM h GROUP BY query"""


@_query("eval_metrics", "WITH " + _EVAL)
def eval_metrics(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("query"), F.col("vec_id").alias("doc"), F.pmod("vec_id", F.lit(4)).cast("int").alias("grade"))
    order = Window.partitionBy("query").orderBy(F.pmod(F.col("doc") * 37, F.lit(101)), "doc")
    return I.ranking_metrics(e.select("query", "doc", F.row_number().over(order).alias("pos")).where("pos <= 15"), e)
