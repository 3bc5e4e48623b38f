"""Keyword search over texts as they are: postings, BM25, minimum match and phrases. `inverted` searches a stored index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalar import folded, tokens

K1, B = 1.2, 0.75


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions): to be written partitioned by term for repeated searches."""
    rows = df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def document_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, idf)."""
    n = df.agg(F.count("*")).scalar()
    terms = df.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", F.round(F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def required(n: int) -> int:
    """How many of n terms have to match: all of up to two, else three quarters rounded down."""
    return n if n <= 2 else int(0.75 * n)


def term_counts(df: DataFrame, key: str, fields: dict[str, Column], tests: list) -> DataFrame:
    """(key, field, dl, tf): of each field the number of tokens, and of tokens that pass each test.

    Texts are split once: the counts, a few numbers a row, are dealt out by key, and both the statistics and the scores
    read that exchange. Generating the rows keeps Spark from copying the split into every use of it.
    """
    none = F.struct(F.lit(0).alias("dl"), F.array(*(F.lit(0) for _ in tests)).alias("tf"))

    def add(acc: Column, token: Column) -> Column:
        return F.struct((acc["dl"] + 1).alias("dl"), F.array(*(F.get(acc["tf"], F.lit(i)) + test(token).cast("int") for i, test in enumerate(tests))).alias("tf"))

    each = F.array(*(F.struct(F.lit(name).alias("field"), F.aggregate(tokens(F.coalesce(text, F.lit(""))), none, add).alias("c")) for name, text in fields.items()))
    return df.select(key, F.explode(each).alias("f")).select(key, "f.field", "f.c.dl", "f.c.tf").repartition(key)


def field_scores(counts: DataFrame, key: str, n: int, known: DataFrame | None = None) -> DataFrame:
    """(key, field, score, matched, tf): BM25 of each field over n tests; an empty field is no document of its index.

    known: (field, _n, _avg) of the whole index, if counts hold only what matched.
    """
    has = counts.where("dl > 0")
    df = F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(n))).alias("_df")
    if known is None:
        stats = has.groupBy("field").agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), df)
    else:
        stats = has.groupBy("field").agg(df).join(F.broadcast(known), "field")  # a row for each field
    rows = has.join(F.broadcast(stats), "field")  # a row for each field

    def part(i: int) -> Column:
        f, d = F.get("tf", F.lit(i)), F.get("_df", F.lit(i))
        idf = F.ln(1 + (F.col("_n") - d + 0.5) / (d + 0.5))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))).otherwise(0.0)

    score = reduce(lambda a, b: a + b, [part(i) for i in range(n)])
    return rows.select(key, "field", score.alias("score"), F.size(F.filter("tf", lambda x: x > 0)).alias("matched"), "tf")


def bm25(df: DataFrame, key: str, text: str, terms: list[str], minimum: int = 1) -> DataFrame:
    """(key, score, matched): documents with at least `minimum` of the terms."""
    terms = list(dict.fromkeys(terms))
    counts = term_counts(df, key, {"text": F.col(text)}, [lambda t, w=w: t == w for w in terms])
    return field_scores(counts, key, len(terms)).where(F.col("matched") >= minimum).select(key, "score", "matched")


def multi_field(df: DataFrame, key: str, boosts: dict[str, float], terms: list[str], best: bool = False) -> DataFrame:
    """Boosted field scores added up (or the best of them), each field with its own minimum match."""
    terms = list(dict.fromkeys(terms))
    counts = term_counts(df, key, {f: F.col(f) for f in boosts}, [lambda t, w=w: t == w for w in terms])
    rows = field_scores(counts, key, len(terms)).where(F.col("matched") >= (1 if best else required(len(terms))))
    boosted = F.col("score") * F.element_at(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair)), F.col("field"))
    return rows.groupBy(key).agg((F.max(boosted) if best else F.sum(boosted)).alias("score"))


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def phrase(df: DataFrame, text: str, words: str) -> DataFrame:
    """Rows with the phrase's tokens in a row."""
    return df.where(has_phrase(F.col(text), words))


def _inside(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(text, F.lit(""))), " "), F.lit(" "))


def has_phrase(text: Column, words: str) -> Column:
    return F.contains(_inside(text), F.lit(f" {' '.join(query_tokens(words))} "))


def query_tokens(text: str) -> list[str]:
    """Tokens of a query, on the driver."""
    return re.findall(r"[^\W_]+", folded(text))


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """Distinct words outside quotes, and phrases within balanced ones."""
    plain = query.translate(_QUOTES)
    phrases = [p.strip() for p in re.findall(r'"([^"]*)"', plain) if query_tokens(p)]
    return list(dict.fromkeys(query_tokens(unquoted(query)))), phrases


_QUOTES = {ord(c): '"' for c in "“”„«»"}


def unquoted(query: str) -> str:
    """A query without its phrases."""
    return re.sub(r'"[^"]*"', " ", query.translate(_QUOTES)).replace('"', " ")


def all_terms(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    return df.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(tokens(F.coalesce(F.col(text), F.lit(""))), t)))
