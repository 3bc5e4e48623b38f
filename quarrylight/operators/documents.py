"""Documents of the index, built from catalog records: studies, chunks, variables, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import fold, format_authors

#: Characters of a sort key; characters of a text field that comes from outside.
SORT_CHARS, SANE_CHARS = 256, 1000


def clean_text(c: Column) -> Column:
    """Trimmed text, null if blank."""
    out = F.trim(c)
    return F.when(out != "", out)


def sanitized(c: Column) -> Column:
    """At most SANE_CHARS characters, without NUL, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.substring(c, 1, SANE_CHARS), F.lit("\x00"), F.lit("")), r"\s+", " "))


def as_int(c: Column) -> Column:
    return c.cast("string").try_cast("int")


def all_text(values: Column) -> Column:
    """The texts of a list, trimmed, without blanks."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def sort_key(c: Column) -> Column:
    return F.substring(fold(c), 1, SORT_CHARS)


def chunk_id(kind: Column, idno: Column, field: Column, text: Column) -> Column:
    """Identity by content: another text is another chunk."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in (kind, idno, field, text))), 256)


def preference(columns: list[Column]) -> Column:
    """16 hex digits that are the same for the same search."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)


def study_documents(studies: DataFrame) -> DataFrame:
    """One document for each study: clean texts, sort keys, whole numbers, facets."""
    return studies.select(
        "sid", clean_text(F.col("idno")).alias("idno"), clean_text(F.col("title")).alias("title"), clean_text(F.col("abstract")).alias("abstract"),
        sort_key(F.col("title")).alias("title_sort"), sort_key(F.col("nation")).alias("nation_sort"),
        as_int(F.col("year_start")).alias("year_start"), as_int(F.col("created")).alias("created"), all_text(F.array("title", "nation", "dataset_type")).alias("all_text"),
        F.map_filter(F.map_from_arrays(F.array(F.lit("tags"), F.lit("nation")), F.array(all_text("tags"), all_text(F.array("nation")))), lambda _, v: F.size(v) > 0).alias("facets"),
    )


def chunk_documents(chunks: DataFrame, studies: DataFrame) -> DataFrame:
    """Chunks stamped with their study's figures; chunks of an unknown study keep nulls, blank ones are marked `skip`."""
    stamp = studies.select("sid", "idno", F.col("dataset_type").alias("type"), "created")
    rows = chunks.join(stamp, "sid", "left")
    content = clean_text(F.col("page_content"))
    return rows.select(chunk_id(F.col("type"), F.col("idno"), F.col("qfield"), content).alias("chunk_id"), "sid", "idno", "type", "qfield", "created", content.alias("page_content"), content.isNull().alias("skip"))


def variable_documents(variables: DataFrame, studies: DataFrame) -> DataFrame:
    """Variables with their study's title."""
    return variables.join(studies.select("sid", "title"), "sid", "left").select("uid", "sid", clean_text(F.col("name")).alias("name"), clean_text(F.col("label")).alias("label"), clean_text(F.col("title")).alias("title"))


def citation_documents(citations: DataFrame) -> DataFrame:
    return citations.select("citation_id", clean_text(F.col("title")).alias("title"), sort_key(F.col("title")).alias("title_sort"), fold(clean_text(F.col("doi"))).alias("doi"), format_authors(F.col("authors")).alias("authors"), as_int(F.col("pub_year")).alias("pub_year"))


def skip_report(documents: DataFrame, key: str = "type") -> DataFrame:
    """Chunks written and skipped by type."""
    return documents.groupBy(key).agg(F.count_if(~F.col("skip")).alias("written"), F.count_if("skip").alias("skipped"))


#: Fields of each kind of metadata record.
KINDS = {
    "survey": "struct<study_desc:struct<title_statement:struct<title:string,idno:string>>>",
    "document": "struct<document_description:struct<title_statement:struct<title:string,idno:string>>>",
    "timeseries": "struct<series_description:struct<idno:string,name:string>>",
}


def typed_metadata(records: DataFrame, kind: str = "schematype", body: str = "metadata") -> DataFrame:
    """(idno, title) of JSON records by their kind; of a kind that is not known both are null."""
    def of(k: str) -> Column:
        return F.from_json(F.col(body), KINDS[k])

    survey, paper, series = of("survey")["study_desc"]["title_statement"], of("document")["document_description"]["title_statement"], of("timeseries")["series_description"]
    k = F.col(kind)
    idno = F.when(k == "survey", survey["idno"]).when(k == "document", paper["idno"]).when(k == "timeseries", series["idno"])
    title = F.when(k == "survey", survey["title"]).when(k == "document", paper["title"]).when(k == "timeseries", series["name"])
    return records.select("*", idno.alias("idno"), title.alias("title"))
