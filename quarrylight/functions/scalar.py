"""Column builders with the engine's scalar semantics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: digits may be grouped by underscores; no type suffixes, no words.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def parse_obs(value: Column) -> Column:
    """An observation as a finite double, else null. Text may have blanks around it; nan and infinities are null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def period_to_numeric(period: Column) -> Column:
    """A period on a year axis: YYYY, YYYY-Qn or YYYY-MM, else a plain number, else null."""
    p = F.trim(period)
    year = F.regexp_extract(p, r"^(\d{4})", 1).try_cast("double")
    quarter = F.regexp_extract(p, r"Q(\d)$", 1).try_cast("double")
    month = F.regexp_extract(p, r"^\d{4}-(\d{2})$", 1).try_cast("double")
    return (
        F.when(p.rlike(r"^\d{4}$"), p.try_cast("double"))
        .when(p.rlike(r"^\d{4}-?Q\d$"), year + (quarter - 1) / 4)
        .when(p.rlike(r"^\d{4}-\d{2}$"), year + (month - 1) / 12)
        .otherwise(parse_obs(p))
    )


def _plain_letters() -> dict[str, str]:
    """Letters whose compatibility decomposition is one letter and marks, with that letter; and marks, with nothing."""
    out = {}
    for c in map(chr, range(0xAA, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if base != c and len(base) <= 1 and c == c.lower():
            out[c] = base
    return out


_PLAIN = _plain_letters()
#: `translate` drops what has no counterpart, so marks come last.
MARKED = "".join(sorted(_PLAIN, key=lambda c: _PLAIN[c] == ""))
PLAIN = "".join(_PLAIN[c] for c in MARKED)
#: Letters that become two.
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def fold(text: Column) -> Column:
    """Lower case without marks, for sorting and matching."""
    low = F.lower(text)
    out = F.translate(low, MARKED, PLAIN)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(low.rlike(r"[^\x00-\x7F]"), out).otherwise(low)


def folded(text: str) -> str:
    """The same of a text on the driver, such as a query."""
    out = "".join(_PLAIN.get(c, c) for c in text.lower())
    for a, b in LIGATURES:
        out = out.replace(a, b)
    return out


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def title_words(text: Column) -> Column:
    """Folded runs of letters, and of digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0))


def quoted_phrases(query: Column) -> tuple[Column, Column]:
    """The phrases in balanced quotes, and the rest of the query; typographic quotes count."""
    q = F.translate(query, "“”„«»", '"""""')
    phrases = F.filter(F.transform(F.regexp_extract_all(q, F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.trim(F.regexp_replace(F.replace(F.regexp_replace(q, '"[^"]*"', " "), F.lit('"'), F.lit(" ")), r"\s+", " "))
    return phrases, rest


def idno_like(query: Column) -> Column:
    return F.trim(query).rlike(r"^[A-Za-z0-9._-]{3,128}$")


def excerpt(text: Column, size: int = 400) -> Column:
    """White space collapsed, at most so many characters; null if blank."""
    out = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, size)
    return F.when(out != "", out)


def positive_int(value: Column) -> Column:
    n = value.cast("string").try_cast("int")
    return F.when(n > 0, n)


def split_list(value: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped; null if none."""
    out = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(out) > 0, out)


def format_authors(value: Column) -> Column:
    """A JSON list of {fname, initial, lname} as 'F I L; ...'; other text stays; blank is ''."""
    people = F.from_json(value, "array<struct<fname:string,initial:string,lname:string>>")
    names = F.transform(people, lambda p: F.trim(F.concat_ws(" ", *(F.when(F.trim(p[k]) != "", F.trim(p[k])) for k in ("fname", "initial", "lname")))))
    joined = F.array_join(F.filter(names, lambda x: x != ""), "; ")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "").when(F.startswith(F.trim(value), F.lit("[")) & people.isNotNull(), joined).otherwise(F.trim(value))
