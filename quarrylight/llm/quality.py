"""Quality rules, line first.

Every line is judged by itself: does it end like a sentence, is it a navigation bar or a path through a site,
boilerplate (of four languages), shouting or symbol noise? Three or more short lines in a row that end like no sentence
are a menu, and fail together. Failing lines are removed. A document is then rejected if it lost more than `max_loss` of
its words, or if the base rule (too short, or too much of it in repeated five-word windows) fails.

Defined results: a null or empty text has no words, fails the base rule and is not kept; lines without a word are
neither removed nor counted, and part no menu; rows with equal doc_id are judged one by one; a long text is measured by
itself, whatever its length; an empty table gives an empty one; columns other than doc_id and text are carried by `clean`
untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.kernel import Words, blocks, cover, grams

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A line ends like a sentence if one of these is its last byte but closing quotes and brackets.
TERMINAL = ".!?:;"
CLOSING = "\"')]"
#: Phrases of page furniture in English, French, German and Spanish, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "click here", "read more", "subscribe to our", "sign up for", "share this", "back to top", "skip to content", "log in to",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "accepter les cookies", "cliquez ici", "lire la suite", "abonnez-vous",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "weiterlesen", "newsletter abonnieren",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "aceptar cookies", "haga clic aquí", "leer más", "suscríbete",
)
#: A line with CRUMBS of these between words is a path through a site.
CRUMB_MARKS, CRUMBS = (" > ", " » ", " › ", " :: "), 2

#: An unfinished line is page furniture if it is short; a long one is prose that was cut off.
UNFINISHED, NAV_BARS, SHOUT_LETTERS = (4, 30), 3, 10
#: MENU lines in a row of at most so many words and bytes are a menu. The bytes leave scripts without spaces alone.
MENU, MENU_WORDS, MENU_BYTES = 3, 3, 40
MAX_LOSS_PERCENT = 30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, n_lost_words long, base_failed boolean, kept boolean"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "n_lost_words", "base_failed", "kept"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _END, _CLOSE = _table(SYMBOLS), _table(TERMINAL), _table(CLOSING)


def _lower(flat: np.ndarray) -> bytes:
    """Text in lower case, letters of Latin-1 alone, each of as many bytes as before."""
    out = np.frombuffer(flat.tobytes().lower(), np.uint8).copy()
    # U+00C0 to U+00DE but the multiplication sign: C3 80 to C3 9E
    capital = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out.tobytes()


def measure(flat: np.ndarray, at: np.ndarray, max_loss_percent: int = MAX_LOSS_PERCENT) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Figures of each row, and the lines: start, end, row and whether it failed."""
    rows = len(at) - 1
    words = Words(flat, at)

    def per(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return total[end] - total[start]

    symbol, bar = _SYMBOL[flat], flat == ord("|")
    out = {"n_words": words.count.astype(np.int64)}
    out["word_chars"] = per(~words.gap & ((flat & 0xC0) != 0x80), at[:-1], at[1:])
    out["n_symbols"] = per(symbol, at[:-1], at[1:])

    # lines: between line feeds, within a row
    feed = np.flatnonzero(flat == 0x0A)
    start = np.sort(np.concatenate((at[:-1], feed + 1)))
    end = np.sort(np.concatenate((feed, at[1:])))
    row = np.searchsorted(feed, at[:-1]) + np.arange(rows)  # index of each row's first line
    line_row = np.zeros(len(start), np.int64)
    line_row[row[1:]] += 1
    line_row = np.cumsum(line_row)
    first_word, last_word = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = last_word - first_word

    seen: set[bytes] = set()
    current, repeated, phrase = -1, np.zeros(len(start), bool), np.zeros(len(start), bool)
    data = flat.tobytes()
    lowered = _lower(flat)
    furniture = [p.encode() for p in BOILERPLATE]
    some = [p for p in furniture if p in lowered]
    marks = [m for m in map(str.encode, CRUMB_MARKS) if m in data]
    for i in np.flatnonzero(n > 0):
        if line_row[i] != current:
            current, seen = line_row[i], set()
        line = data[start[i] : end[i]]
        if line in seen:
            repeated[i] = True
        else:
            seen.add(line)
        if some:
            low = lowered[start[i] : end[i]]
            phrase[i] = any(p in low for p in some)
        if marks and not phrase[i]:
            phrase[i] = sum(map(line.count, marks)) >= CRUMBS
    out["n_dup_lines"] = np.bincount(line_row[repeated], minlength=rows).astype(np.int64)

    # the last byte of the line that is neither white space nor closing
    mark = np.where(words.gap | _CLOSE[flat], -1, np.arange(len(flat)))
    last = np.maximum.accumulate(np.concatenate(([-1], mark)))[end]
    ended = (last >= start) & _END[flat[np.maximum(last, 0)]] if len(flat) else np.zeros(len(start), bool)
    upper = per((flat >= 65) & (flat <= 90), start, end)
    lower = per((flat >= 97) & (flat <= 122), start, end)
    # runs of lines with a word that are short and unfinished, within a row
    worded = np.flatnonzero(n > 0)
    short = (~ended & (n <= MENU_WORDS) & (end - start <= MENU_BYTES))[worded]
    parted = np.ones(len(worded), bool)
    parted[1:] = (short[1:] != short[:-1]) | (line_row[worded][1:] != line_row[worded][:-1])
    stretch = np.cumsum(parted) - 1
    menu = np.zeros(len(start), bool)
    menu[worded] = short & (np.bincount(stretch)[stretch] >= MENU if len(worded) else False)
    failed = (n > 0) & (
        (~ended & (n >= UNFINISHED[0]) & (n <= UNFINISHED[1]))
        | (per(bar, start, end) >= NAV_BARS)
        | (10 * per(symbol, start, end) >= 3 * n)
        | ((upper > lower) & (upper >= SHOUT_LETTERS))
        | repeated
        | phrase
        | menu
    )
    out["n_lines"] = np.bincount(line_row[n > 0], minlength=rows).astype(np.int64)
    out["n_failed_lines"] = np.bincount(line_row[failed], minlength=rows).astype(np.int64)
    out["n_lost_words"] = np.bincount(line_row, weights=np.where(failed, n, 0), minlength=rows).astype(np.int64)

    # five-word windows found twice or more in a row
    five = grams(words.hashes(), 5)
    fits = words.fits(5)[: len(five)]
    key = five ^ (words.row()[: len(five)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key, place = key[fits], np.flatnonzero(fits)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        found = np.searchsorted(twice, key)
        again = place[twice[np.minimum(found, len(twice) - 1)] == key]
        covered = cover(len(words.start), again, again + 5)
        out["n_repeat_words"] = per(covered, words.first[:-1], words.first[1:])
    else:
        out["n_repeat_words"] = np.zeros(rows, np.int64)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["n_lost_words"] <= max_loss_percent * out["n_words"])
    return out, (start, end, line_row, failed)


def score(docs: DataFrame, max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """One row per document: the figures and the verdict. Needs doc_id and text; no shuffle."""

    def run(batches):
        for batch in batches:
            for i, j, flat, at in blocks(batch.column("text")):
                got, _ = measure(flat, at, max_loss_percent)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), *(pa.array(got[c]) for c in FIGURES)], names=["doc_id", *FIGURES])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """The kept documents without their failing lines; all columns stay."""

    def run(batches):
        for batch in batches:
            where = batch.schema.get_field_index("text")
            field = batch.schema.field(where)
            for i, j, flat, at in blocks(batch.column(where)):
                got, (start, end, row, failed) = measure(flat, at, max_loss_percent)
                data = flat.tobytes()
                lines: list[list[bytes]] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(~failed):
                    lines[row[k]].append(data[start[k] : end[k]])
                text = pa.array([b"\n".join(x).decode() for x in lines], pa.string())
                yield batch.slice(i, j - i).set_column(where, field, text.cast(field.type)).filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    from quarrylight.llm.store import documents

    return score(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_CAPITALS = "".join(map(chr, [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
_WORD = r"[^\x20\x09-\x0D]+"
VERDICT_SQL = rf"""
 d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
 l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM w),
 l1 AS (SELECT rid, line, k, len(regexp_extract_all(line, '{_WORD}')) AS n, rtrim(line, ' "'')]' || chr(9) || chr(11) || chr(12) || chr(13)) AS tail FROM l0),
 l2 AS (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY k) > 1 AS again, NOT (tail <> '' AND contains('{TERMINAL}', right(tail, 1))) AS open FROM l1 WHERE n > 0),
 m0 AS (SELECT rid, k, open AND n <= {MENU_WORDS} AND strlen(line) <= {MENU_BYTES} AS short FROM l2),
 m1 AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) - row_number() OVER (PARTITION BY rid, short ORDER BY k) AS stretch FROM m0),
 m AS (SELECT rid, k, short AND count(*) OVER (PARTITION BY rid, short, stretch) >= {MENU} AS menu FROM m1),
 l3 AS (SELECT *, menu OR (open AND n BETWEEN {UNFINISHED[0]} AND {UNFINISHED[1]})
        OR len(line) - len(replace(line, '|', '')) >= {NAV_BARS}
        OR 10 * (len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) >= 3 * n
        OR (len(regexp_extract_all(line, '[A-Z]')) > len(regexp_extract_all(line, '[a-z]')) AND len(regexp_extract_all(line, '[A-Z]')) >= {SHOUT_LETTERS})
        OR again OR {" OR ".join(f"contains(translate(line, '{_CAPITALS}', '{_CAPITALS.lower()}'), '{_quoted(p)}')" for p in BOILERPLATE)}
        OR {" + ".join(f"(length(line) - length(replace(line, '{m}', ''))) // {len(m)}" for m in CRUMB_MARKS)} >= {CRUMBS} AS failed FROM l2 JOIN m USING (rid, k)),
 l AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
       coalesce(sum(n) FILTER (WHERE failed), 0)::BIGINT AS n_lost_words FROM l3 GROUP BY rid),
 g0 AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
 g1 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS c FROM g0),
 g AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM g1, range(0, 5) AS r(o) WHERE c > 1 GROUP BY rid),
 f AS (SELECT rid, doc_id, text, len(ws)::BIGINT AS n_words, coalesce(len(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
       (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words FROM w LEFT JOIN l USING (rid) LEFT JOIN g USING (rid)),
 v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)"""
ORACLE = f"WITH {VERDICT_SQL} SELECT doc_id, {', '.join(FIGURES[:-2])}, base_failed, NOT base_failed AND 100 * n_lost_words <= {MAX_LOSS_PERCENT} * n_words AS kept FROM v"
QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE}
