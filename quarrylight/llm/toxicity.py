"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases a text, maps look-alike letters to Latin ones and digits or signs inside words to the letters
they stand for, and keeps runs of letters parted by single spaces. The lexicon is learnt: from at most FIT_DOCS
labelled documents (those with the smallest hash of doc_id), words and word beginnings are weighed by the log odds of
toxic against other documents, those that are clearly toxic are kept, and phrases around them that only occur in
other documents become exceptions. All such entries and phrases are taken: the labelled documents bound how many there
are. A document's score is a logistic function of the matched weight, without what exception phrases cover, in
proportion to its length, and of the number of matches.

Defined results: a null or empty text scores like one without a match; a row without a doc_id is not held out;
documents without labels are scored but not learnt from; repeated rows are scored one by one, and equal texts score alike; without any labelled row all scores are
0. Label rows of one document count once each. Of entries that begin at one letter the heaviest counts; terms of equal
support are taken longest first, then in order of their letters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import blocks
from quarrylight.llm.store import documents, stage

#: Labelled documents that the lexicon is learnt from, at most; held-out remainder.
FIT_DOCS, HELD_OUT = 20_000, 2
THRESHOLD = 0.3
#: An entry is in MIN_DOCS toxic documents and is at least so sure, of which beginnings of words have PREFIX letters.
MIN_DOCS, PURITY, PREFIX = 4, 0.9, (3, 4, 5, 6, 7, 8)

#: Look-alikes of Latin letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
#: Digits and signs that stand for letters within a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Characters without a width, dropped.
INVISIBLE = "­​‌‍⁠﻿"
#: Exception phrases known beforehand: the words have another sense there.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser rule", "idiot proof", "idiot board")

_FOLD = str.maketrans({**HOMOGLYPHS, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **dict.fromkeys(INVISIBLE)})
_SWAP = str.maketrans(SUBSTITUTES)
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@$!](?=[^\W_]))*")
_MIXED = re.compile(r"[0-9@$!]")


def _swap(m: re.Match) -> str:
    t = m[0]
    return t.translate(_SWAP) if any(c.isalpha() for c in t) else t


def fold(text: str) -> str:
    """Words of letters, each with a space before and after it."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    words = _TOKEN.findall(low)
    joined = f" {' '.join(words)} "
    return _TOKEN.sub(_swap, joined) if _MIXED.search(joined) else joined


@dataclass
class Lexicon:
    """weights: of entries (a leading space starts a word, a trailing one ends it); exceptions: phrases; curve: bias and slopes."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    _automaton: object = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        (self.weights, self.exceptions, self.curve), self._automaton = state, None

    def automaton(self):
        if self._automaton is None and self.weights:
            a = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                a.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                a.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matched(self, folded: str) -> tuple[float, int, int]:
        """Weight of the words that entries match, each by its heaviest, how many they are, and the number of words."""
        a = self.automaton()
        n = folded.count(" ") - 1
        if a is None:
            return 0.0, 0, n
        best: dict[int, float] = {}
        spared = []
        for end, (size, w) in a.iter(folded):
            start = end - size + 1
            if w < 0:
                spared.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if spared:
            best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in spared)}
        return sum(best.values()), len(best), n

    def features(self, folded: str) -> tuple[float, float]:
        weight, hits, n = self.matched(folded)
        return math.log1p(100 * weight / max(n, 20)), min(hits, 5) / 5

    def score(self, folded: str) -> float:
        bias, a, b = self.curve
        x, y = self.features(folded)
        z = bias + a * x + b * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str) -> set[str]:
    """Words and word beginnings of a folded text."""
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIX if len(w) > k}


def choose(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries and weights, of (term, toxic documents, other documents) and the numbers of documents."""
    base = toxic / max(toxic + other, 1)
    sure = {}
    for term, pos, neg in counts:
        if pos >= MIN_DOCS and pos >= PURITY * (pos + neg) and (pos + 1) * math.log(1 / max(base, 1e-6)) > 6 + 3 * neg:
            sure[term] = pos, math.log((pos + 0.5) / (toxic + 1) * (other + 1) / (neg + 0.5))
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}  # toxic documents of kept entries, by their beginnings
    for term in sorted(sure, key=lambda e: (-sure[e][0], -len(e), e)):
        core, (pos, weight) = term.strip(), sure[term]
        starts = [f" {core[:k]}" for k in PREFIX if k < len(core)]
        if longer.get(term) != pos and not any(kept.get(x, -1.0) >= 0.9 * weight for x in starts):
            kept[term] = weight
            for x in starts:
                longer[x] = max(longer.get(x, 0), pos)
    return kept


def phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Each matched word of a folded text with the word before it, and with the word after it."""
    out: set[str] = set()
    automaton = lexicon.automaton()
    for end, (size, w) in automaton.iter(text) if automaton else ():
        if w < 0:
            continue
        start = end - size + 1
        stop = text.index(" ", start + 1)
        left, right = text.rfind(" ", 0, start), text.find(" ", stop + 1)
        if left >= 0:
            out.add(text[left + 1 : stop])
        if right >= 0:
            out.add(text[start + 1 : right])
    return out


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two figures, by Newton steps with a little shrinkage."""
    x, w, hold = np.column_stack((np.ones(len(x)), x)), np.zeros(3), np.array([1e-3, 0.05, 0.05])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
    return tuple(round(float(v), 6) for v in w)


def _counted(sample: DataFrame, parts) -> DataFrame:
    """(term, pos, neg): toxic and other documents for each of the strings that parts gives of a document."""

    def run(batches):
        for batch in batches:
            sides = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                sides[y].update(parts(text))
            names = list(sides[0].keys() | sides[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sides[1][t] for t in names], pa.int64()), pa.array([sides[0][t] for t in names], pa.int64())], names=["term", "pos", "neg"])

    return sample.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from labelled rows outside the held-out remainder. The driver gets clearly toxic terms and phrases of at most fit_docs documents, and a pair of figures of each."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT)
    chosen = rows.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(fit_docs)

    def folded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([fold(t or "") for t in batch.column("text").to_pylist()], pa.string())], names=["y", "text"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("y", "text")
    sample = stage(joined.mapInArrow(folded, "y int, text string"), "toxicity-fit")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1):
        return Lexicon()
    sure = _counted(sample, terms).where((F.col("pos") >= MIN_DOCS) & (F.col("pos") >= PURITY * (F.col("pos") + F.col("neg"))))
    out = Lexicon(choose([tuple(r) for r in sure.collect()], totals[1], totals.get(0, 0)), exceptions)
    spared = _counted(sample, lambda text: phrases(text, out)).where((F.col("neg") >= MIN_DOCS) & (F.col("pos") == 0))
    out = Lexicon(out.weights, (*exceptions, *sorted(r["term"] for r in spared.select("term").collect())))

    def figures(batches):
        for batch in batches:
            got = np.array([out.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["y", "a", "b"])

    pairs = np.array(sorted(map(tuple, sample.mapInArrow(figures, "y int, a double, b double").collect())))
    out.curve = curve(pairs[:, 1:], pairs[:, 0])
    return out


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. No shuffle."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, flat, at in blocks(batch.column("text")):
                data = flat.tobytes()
                got = [lexicon.score(fold(data[a:b].decode())) for a, b in zip(at[:-1], at[1:], strict=True)]
                held = [d is not None and zlib.crc32(str(d).encode()) % 4 == HELD_OUT for d in ids[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j], pa.int64()), pa.array(held, pa.bool_()), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict = {}
