"""URL filter: host and path rules first, else logistic regression on hashed character trigrams of host and path.

Scoring is a chain of column expressions, so it runs inside the scan's stage: no shuffle and nothing but DataFrame
functions. The model is trained once on the driver from a labelled URL table of at most TRAIN_ROWS rows.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the model's verdict on
the empty string. Equal rows give equal verdicts; of rules of one length the first given wins.
"""

from __future__ import annotations

import csv
import json
import math
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

BUCKETS, TRAIN_ROWS, EPOCHS, RATE, DECAY, THRESHOLD = 2048, 10_000, 300, 0.5, 1e-3, 0.4
#: Multipliers of the trigram hash.
_M1, _M2, _M3 = 961, 31, 7

#: The labelled URL table: url, blocked (1 or 0), part (train, or test for held-out rows).
TABLE = Path(__file__).with_name("labelled_urls.csv")


def labelled(part: str = "train", path: Path | str = TABLE) -> tuple[tuple[str, int], ...]:
    """(url, 1 to block) of one part of a labelled URL table."""
    with open(path, encoding="utf-8", newline="") as f:
        return tuple((r["url"], int(r["blocked"])) for r in csv.DictReader(f) if r["part"] == part)


def _parts(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def _grams(host: str, path: str) -> set[int]:
    code = [ord(c) for c in f"^{host}|{path}$"]
    return {(a * _M1 + b * _M2 + c * _M3) % BUCKETS for a, b, c in zip(code, code[1:], code[2:])}


@cache
def train(table: tuple[tuple[str, int], ...]) -> tuple[float, tuple[float, ...]]:
    """Bias and bucket weights by full-batch gradient descent; deterministic."""
    if len(table) > TRAIN_ROWS:
        raise ValueError(f"at most {TRAIN_ROWS} labelled URLs")
    rows = [(sorted(_grams(*_parts(url))), y) for url, y in table]
    bias, w = 0.0, [0.0] * BUCKETS
    for _ in range(EPOCHS):
        step, back = [0.0] * BUCKETS, 0.0
        for grams, y in rows:
            z = bias + sum(w[g] for g in grams) / math.sqrt(len(grams))
            e = y - 1 / (1 + math.exp(-z))
            back += e
            for g in grams:
                step[g] += e / math.sqrt(len(grams))
        bias += RATE * back / len(rows)
        w = [x + RATE * (s / len(rows) * 10 - DECAY * x) for x, s in zip(w, step, strict=True)]
    return round(bias, 4), tuple(round(x, 4) for x in w)


def _rule_order(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    fold = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(fold, F.lit("")), F.coalesce(path, F.lit(""))


def probability(host: Column, path: Column, table: tuple[tuple[str, int], ...]) -> Column:
    """The model's probability that the url is to be blocked."""
    bias, weights = train(tuple(table))
    code = F.transform(F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), ""), F.ascii)
    code = F.filter(code, lambda c: c > 0)
    grams = F.array_distinct(
        F.zip_with(
            F.zip_with(F.slice(code, 1, F.size(code) - 2), F.slice(code, 2, F.size(code) - 2), lambda a, b: a * _M1 + b * _M2),
            F.slice(code, 3, F.size(code) - 2),
            lambda ab, c: F.pmod(ab + c * _M3, F.lit(BUCKETS)),
        )
    )
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, g))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.size(grams)))))


def judge(pages: DataFrame, rules=RULES, table: tuple[tuple[str, int], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row; table: labelled URLs, the module's own if None."""
    host, path = parts(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, prefix in reversed(_rule_order(rules)):
        fit = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit(f".{at}"))) & F.startswith(F.col("path"), F.lit(prefix))
        fits, verdicts = F.when(fit, F.lit(at + prefix)).otherwise(fits), F.when(fit, F.lit(verdict)).otherwise(verdicts)
    score = probability(F.col("host"), F.col("path"), labelled() if table is None else table)
    return df.select("page_id", "host", "path", fits.alias("rule"), verdicts.alias("ruled"), F.round(score, 6).alias("score")).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def _oracle() -> str:
    bias, weights = train(labelled())
    fit = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _rule_order(RULES)]
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM u),
 p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM h),
 c AS (SELECT *, list_transform(string_split('^' || host || '|' || path || '$', ''), lambda x: unicode(x)) AS code FROM p),
 g AS (SELECT *, list_distinct(list_transform(range(1, len(code) - 1), lambda i: (code[i] * {_M1} + code[i + 1] * {_M2} + code[i + 2] * {_M3}) % {BUCKETS})) AS grams FROM c),
 s AS (SELECT page_id, host, path, 1 / (1 + exp(-({bias} + list_sum(list_transform(grams, lambda k: ({json.dumps(weights)}::DOUBLE[])[k + 1])) / sqrt(len(grams))))) AS score FROM g)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fit)} END AS rule,
 CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fit)} WHEN round(score, 6) >= {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict FROM s"""


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLES = {"op5_url_filters": _oracle()}
