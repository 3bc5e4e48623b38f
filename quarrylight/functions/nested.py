"""Nested metadata: searchable text of microdata records, and the filters of extract payloads.

The walk has to keep the order in which texts appear in a record, which neither maps nor VARIANT keep, so it is a small
Arrow function; payloads are read as VARIANT by column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Regions of a record that are looked at first, and keys whose texts count.
REGIONS = ("data_dictionary", "study_description", "study_desc", "file_description")
LABELS = ("labl", "label", "name", "var_lab", "title")
GROUPS = ("data_dictionary", "file_description")
#: How deep the walk goes, how many items of a list it looks at, how many texts it keeps.
DEPTH, ITEMS, LINES = 6, 500, 2000


def _counts(key: str) -> bool:
    """Whether a text under this key is searchable."""
    key = key.lower()
    return key in LABELS or key in GROUPS or "variable" in key or "group" in key


def texts_under(root: object) -> Iterator[str]:
    """Texts of a nested value in the order in which they stand there; single characters and blanks are none."""
    waiting = [(root, 0)]
    while waiting:
        node, depth = waiting.pop()
        if depth > DEPTH:
            continue
        if isinstance(node, str):
            if len(node) > 1 and (text := node.strip()):
                yield text
            continue
        inside = []
        if isinstance(node, dict):
            inside = [v for k, v in node.items() if isinstance(v, (dict, list)) or isinstance(v, str) and _counts(k)]
        elif isinstance(node, list):
            inside = node[:ITEMS]
        waiting += [(v, depth + 1) for v in reversed(inside)]


def searchable(record: object) -> str:
    """The distinct texts of a record's regions (or of all of it, if they have none), a line each."""
    if not isinstance(record, dict):
        return ""
    found = dict.fromkeys(t for key in REGIONS if key in record for t in texts_under(record[key]))
    return "\n".join(islice(found or dict.fromkeys(texts_under(record)), LINES))


def _read(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _searchable_texts(metadata: pd.Series) -> pd.Series:
    return metadata.map(lambda text: searchable(_read(text)))


def microdata_text(metadata: Column) -> Column:
    """Searchable text of a JSON record; '' if it is none."""
    return F.pandas_udf(_searchable_texts, StringType())(metadata)


def with_microdata_text(content: Column, kind: Column, metadata: Column, labels: Column | None = None, groups: Column | None = None) -> Column:
    """Content with the searchable text of a microdata record behind it, and lists of labels and groups, if there are."""
    lists = [F.nullif(F.array_join(F.filter(x, lambda e: F.coalesce(e != "", F.lit(False))), "\n"), F.lit("")) for x in (labels, groups) if x is not None]
    more = F.trim(F.concat_ws("\n", F.nullif(microdata_text(metadata), F.lit("")), *lists))
    return F.when((kind == "microdata") & metadata.isNotNull() & (more != ""), F.concat_ws("\n", content, more)).otherwise(content)


def filter_records(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(sid, filters as JSON) of extract payloads, which hold a list of studies, one study, or a study's own fields.

    A study needs a positive catalog id and an object of filters; a list of studies hides the other two forms.
    """
    v = F.col("_v")

    def part(source: Column, path: str, kind: str) -> Column:
        return F.try_variant_get(source, path, kind)

    def sound(study: Column) -> Column:
        return (_sid(study) > 0) & part(study, "$.filters", "map<string,variant>").isNotNull()

    def _sid(study: Column) -> Column:
        at = "$.core_fields.catalog_id"
        return F.coalesce(part(study, at, "int"), part(study, at, "string").try_cast("int"), F.lit(0))

    several = part(v, "$.studies", "array<variant>")
    single = part(v, "$.study", "variant")
    studies = F.when(several.isNotNull(), several).when(F.coalesce(sound(single), F.lit(False)), F.array(single)).otherwise(F.array(v))
    rows = payloads.select(F.try_parse_json(column).alias("_v")).where("_v IS NOT NULL").select(F.explode(studies).alias("_s"))
    return rows.where(sound(F.col("_s"))).select(_sid(F.col("_s")).alias("sid"), F.to_json(part(F.col("_s"), "$.filters", "variant")).alias("filters"))
