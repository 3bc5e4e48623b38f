"""Alignment of two tokenizers over the same bytes, by byte-owner arrays.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (SentencePiece) the text, before which it puts a
space itself; so the tokens of both cover the same bytes. For a run of texts (about a megabyte), `np.repeat` of token
numbers by token lengths gives the owner of each byte in A and in B. Where a pair of consecutive bytes differs in one
owner, another overlap of an A and a B token begins; where it differs in both, both tokens end: a cut. The tokens
between two cuts are a group, and every A token of a group is linked with every B token of it.

`alignments` returns tokens, cuts and overlaps of each document, `pair_counts` in how many documents of the corpus an A
and a B token are linked, and `digest` what each document's links count. For the counts, a task packs its documents to
blocks of BLOCK bytes: one row holds the block's distinct id pairs, and for each document which of them it links how
often. The pairs of the blocks are counted and joined back by pair (a pair has one row a block, and a skewed join can
be split), and each block's answers meet its row by block number. Only the highest count of each A id is broadcast: at
most as many rows as A has ids.

Tokens never cross a place before a space or a line feed that follows no white space: A's pattern parts white space from
what precedes it, and no piece of B holds a line feed, or a space after another character. So a worker encodes each
distinct part between two such places once (a bounded memo) and puts a text's tokens together from them. `Encoder` looks
at both vocabularies; if one allows tokens across these places, whole texts are encoded instead, with the same result.

Defined results: a null or empty text, and one of which A's or B's token bytes are not the space and the text (as with
U+2581 in it, which B reads as a space), has no tokens: zeros, and '' for a digest. Rows that repeat a doc_id, or have
none, are documents of their own. Very long texts are aligned section by section, parted where no token crosses; a group with very many tokens on both sides is
linked by its distinct ids and their numbers. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.kernel import blocks
from quarrylight.llm.store import documents, stage

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose distinct pairs share a row.
BLOCK = 8 << 20
#: Compressed bytes of a row group of stored blocks. Parquet looks at a group's size after 100 rows and is read a group at a time;
#: a row is a block, so a task with many of them would hold them all.
GROUP = 4 << 20
_GROUPED = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Parts that a worker remembers, and their characters; beyond them the memo starts anew.
MEMO, MEMO_CHARS = 600_000, 12_000_000
#: Characters of new parts that are encoded as one string.
RUN = 2048
#: A text of more characters is aligned section by section.
SECTION = 1 << 20
#: Groups with more tokens on a side are linked by distinct ids; links made at once.
WIDE, AT_ONCE = 8, 1 << 22
_PART = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_SPACE = "▁"
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, n array<long>, held binary, which binary, links binary"


def _byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of both tokenizers for many texts."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None, by_parts: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or public_tokenizers.path(A_NAME))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_NAME))
        sizes = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(sizes) > 1 << 16:
            raise ValueError("id pairs are 16 and 16 bits")
        of_char = _byte_level()
        a_bytes = [bytes(of_char.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(sizes[0])]
        pieces = [self.b.id_to_piece(i) for i in range(sizes[1])]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.length = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.by_parts = by_parts and self._parts_apart(pieces)
        self.forget()

    def _parts_apart(self, pieces: list[str]) -> bool:
        """Whether no token of either vocabulary crosses the places where texts are parted."""
        words = (p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        whole = all("\n" not in p and _SPACE not in p.lstrip(_SPACE) for p in words)
        kept = self.b.normalize("a  é \n b ") == f"{_SPACE}a{_SPACE * 2}é{_SPACE}\n{_SPACE}b{_SPACE}"
        shape = str(self.a.pre_tokenizer)
        return whole and kept and shape.startswith("ByteLevel(") and "use_regex=True" in shape and self.a.normalizer is None

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.ids = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.zeros(0, bool)

    def _learn(self, parts: list[str]) -> None:
        """Appends the ids of new parts; one whose token bytes are not its own gets none."""
        alone = [not self.by_parts or p[-1].isspace() or _SPACE in p for p in parts]  # the next part may not follow these
        runs, size = [], RUN
        for p, single in zip(parts, alone, strict=True):
            if single:
                runs.append([p])
                size = RUN
                continue
            if size >= RUN:
                runs.append([])
                size = 0
            runs[-1].append(p)
            size += len(p)
        new = [self.ids[0]], [self.ids[1]]
        first = [self.first[0]], [self.first[1]]
        whole = [self.whole]
        while runs:
            again = []
            for run, data, *tokens in zip(runs, *self._encode(["".join(run) for run in runs]), strict=True):
                ends = np.cumsum([len(p.encode()) for p in run])
                place = [np.cumsum(self.length[s][tokens[s]]) for s in (0, 1)]
                after = [np.searchsorted(at, ends) + 1 for at in place]
                good = all(b"".join(map(self.bytes[s].__getitem__, tokens[s].tolist())) == data and np.array_equal(place[s][after[s] - 1], ends) for s in (0, 1))
                if not good and len(run) > 1:
                    again += [[p] for p in run]
                    continue
                for s in (0, 1):
                    new[s].append(tokens[s][: len(tokens[s]) if good else 0].astype(np.uint16))
                    first[s].append(first[s][-1][-1] + (after[s] if good else np.zeros(1, np.int64)))
                whole.append(np.full(len(run), good))
                for p in run:
                    self.memo[p] = len(self.memo)
                    self.chars += len(p)
            runs = again
        self.ids, self.first, self.whole = [np.concatenate(x) for x in new], [np.concatenate(x) for x in first], np.concatenate(whole)

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
        """Bytes, A's ids and B's ids of parts."""
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B begins with a space of its own: it stands for the part's, or is a token by itself before a line feed; it puts
        # none before nothing, so a text's last space is looked up
        b = [np.array(ids[t[0] == "\n" :] if t != " " else [self.b.piece_to_id(_SPACE)], np.int64) for t, ids in zip(texts, self.b.encode([t[t[0] == " " :] for t in texts], num_threads=1), strict=True)]
        return [t.encode() for t in texts], a, b

    def sections(self, text: str):
        """A space and the text, in sections of about SECTION characters that neither tokenizer's tokens cross."""
        if not self.by_parts or len(text) < SECTION:
            yield " " + text
            return
        held, size = [], 0
        for match in _PART.finditer(" " + text):
            held.append(match[0])
            size += len(match[0])
            if size >= SECTION:
                yield "".join(held)
                held, size = [], 0
        if held:
            yield "".join(held)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and B: the ids of all texts or sections, and where those of each begin. One with other bytes has none."""
        parts = [(_PART.findall(t) if self.by_parts else [t]) if t else [] for t in texts]
        new = set().union(*parts).difference(self.memo)
        if new and (len(self.memo) + len(new) > MEMO or self.chars > MEMO_CHARS):
            self.forget()
            new = set().union(*parts)
        order = list(new)
        for i in range(0, len(order), 1 << 16):
            self._learn(order[i : i + (1 << 16)])
        number = np.array([*map(self.memo.__getitem__, chain.from_iterable(parts))], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        whole = np.ones(len(texts), bool)
        np.logical_and.at(whole, row, self.whole[number])
        number, row = number[whole[row]], row[whole[row]]
        ids, first = [], []
        for s in (0, 1):
            n = self.first[s][number + 1] - self.first[s][number]
            ids.append(self.ids[s][_ranges(self.first[s][number], n)].astype(np.int64))
            first.append(np.concatenate(([0], np.cumsum(np.bincount(row, n, len(texts)).astype(np.int64)))))
        return ids, first


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them) for each i."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Aligned:
    """Owners, cuts and overlaps of the tokens of some texts or sections, one after the other; each has its space."""

    def __init__(self, encoder: Encoder, texts: list[str]):
        (self.a, self.b), (self.first_a, self.first_b) = encoder.encode(texts)
        sizes = encoder.length[0][self.a], encoder.length[1][self.b]
        own = [np.repeat(np.arange(len(x)), x) for x in sizes]
        new = [np.diff(x, prepend=-1) != 0 for x in own]
        begins = np.flatnonzero(new[0] | new[1])
        #: Overlaps: places of the A and the B token, and the first byte of each.
        self.over_a, self.over_b, self.over_at = own[0][begins], own[1][begins], begins
        cut = new[0] & new[1]
        group = np.cumsum(cut) - 1
        #: The byte where each group begins, and the group of each token.
        self.cut = np.flatnonzero(cut)
        self.group_a, self.group_b = group[new[0]], group[new[1]]
        self.n_bytes = len(group)
        n = len(self.cut)
        self.count_a, self.count_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        #: The first group of each text, and one past the last.
        self.first = np.append(self.group_a, n)[self.first_a]

    def names(self) -> np.ndarray:
        """Places in `_names()` that give `a1,a2|b1;...` of all groups: A's tokens, then B's of each."""
        place = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.diff(self.group_a, append=-1) != 0, np.diff(self.group_b, append=-1) != 0
        before_a, before_b = np.cumsum(self.count_a), np.cumsum(self.count_b)
        at_a = np.arange(len(self.a)) + (before_b - self.count_b)[self.group_a]
        at_b = np.arange(len(self.b)) + before_a[self.group_b]
        place[at_a] = self.a + (last_a.astype(np.int64) << 16)
        place[at_b] = self.b + (last_b.astype(np.int64) << 17)
        return place

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (A's id times 65,536 plus B's) and number of links, sorted; a text has a pair once."""
        out = [(np.zeros(0, np.int64),) * 3]
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        wide = (self.count_a > WIDE) | (self.count_b > WIDE)
        start_b = np.cumsum(self.count_b) - self.count_b
        near = ~wide[self.group_a]
        g, n = self.group_a[near], self.count_b[self.group_a[near]]
        out.append(_counted(np.repeat(text[g], n), np.repeat(self.a[near] << 16, n) | self.b[_ranges(start_b[g], n)], np.ones(int(n.sum()), np.int64)))
        start_a = np.cumsum(self.count_a) - self.count_a
        for g in np.flatnonzero(wide).tolist():
            (x, m), (y, k) = (np.unique(ids[i : i + n], return_counts=True) for ids, i, n in ((self.a, start_a[g], self.count_a[g]), (self.b, start_b[g], self.count_b[g])))
            step = max(1, AT_ONCE // len(y))
            for i in range(0, len(x), step):
                made = (x[i : i + step, None] << 16 | y).ravel()
                out.append((np.full(len(made), text[g]), made, (m[i : i + step, None] * k).ravel()))
                if sum(len(o[0]) for o in out[2:]) > AT_ONCE:
                    out[1:] = [_counted(*map(np.concatenate, zip(*out, strict=True)))]
        return out[1] if len(out) == 2 else _counted(*map(np.concatenate, zip(*out, strict=True)))


def _counted(text: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links summed by text and pair."""
    key = text << 32 | pair
    if not len(key):
        return text, pair, links
    order = np.argsort(key, kind="stable")
    key, links = key[order], links[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat(links, at)


_encoders: dict[tuple, Encoder] = {}


def _encoder(*paths) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def _texts(batches):
    """(doc_ids, texts) of about a megabyte at a time, the texts behind a space each; null and empty ones stay empty."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for i, j, flat, at in blocks(batch.column("text")):
            data = flat.tobytes()
            yield ids.slice(i, j - i), [" " + data[a:b].decode() if b > a else "" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids, cuts (bytes where groups begin, the first is 0), and its overlaps as
    three arrays: overlap_a and overlap_b (places of the tokens among the document's) and overlap_at (its first byte).
    Bytes are those of a space and the text. Needs doc_id and text; no shuffle."""
    schema = "doc_id long, a_ids array<long>, b_ids array<long>, cuts array<long>, overlap_a array<long>, overlap_b array<long>, overlap_at array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoder = _encoder(a_path, b_path)
        for ids, texts in _texts(batches):
            x = Aligned(encoder, texts)
            byte = np.append(x.cut, x.n_bytes)[x.first]
            over = np.searchsorted(x.over_at, byte)
            of_cut, of_over = np.repeat(byte[:-1], np.diff(x.first)), np.diff(over)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, _lists(x.a, x.first_a), _lists(x.b, x.first_b), _lists(x.cut - of_cut, x.first),
                    _lists(x.over_a - np.repeat(x.first_a[:-1], of_over), over), _lists(x.over_b - np.repeat(x.first_b[:-1], of_over), over), _lists(x.over_at - np.repeat(byte[:-1], of_over), over),
                ],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Block:
    """Documents whose distinct pairs share a row."""

    def __init__(self, task: int):
        self.task, self.number = task, 0
        self._clear()

    def _clear(self) -> None:
        self.size, self.columns, self.held = 0, [[] for _ in range(6)], []

    def add(self, encoder: Encoder, ids: pa.Array, texts: list[str], names: list[bytes]) -> None:
        self.size += sum(map(len, texts))
        if len(texts) == 1 and len(texts[0]) > SECTION:
            return self._add_long(encoder, ids, texts[0][1:], names)
        x = Aligned(encoder, texts)
        text, pair, links = x.links()
        groups = np.concatenate(([0], np.cumsum(x.count_a * x.count_b)))
        place, ends = x.names(), x.first_a + x.first_b
        digests = [hashlib.sha256(_named(names, place[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        self._append(np.bincount(text, minlength=len(texts)), pair, links, ids.to_pylist(), np.diff(x.first_a).tolist(), np.diff(x.first_b).tolist(), np.diff(x.first).tolist(), np.diff(groups[x.first]).tolist(), digests)

    def _add_long(self, encoder: Encoder, ids: pa.Array, text: str, names: list[bytes]) -> None:
        """The same for one long text, section by section."""
        sums, held, sha, mark = np.zeros(4, np.int64), (np.zeros(0, np.int64),) * 3, hashlib.sha256(), b""
        for section in encoder.sections(text):
            x = Aligned(encoder, [section])
            if not len(x.a):
                return self._append(np.zeros(1, np.int64), held[1][:0], held[2][:0], ids.to_pylist(), [0], [0], [0], [0], [""])
            sums += len(x.a), len(x.b), len(x.cut), int((x.count_a * x.count_b).sum())
            held = _counted(*map(np.concatenate, zip(held, x.links(), strict=True)))
            sha.update(mark + _named(names, x.names())[:-1])
            mark = b";"
        self._append(np.array([len(held[1])]), held[1], held[2], ids.to_pylist(), *([n] for n in sums.tolist()), [sha.hexdigest()])

    def _append(self, n: np.ndarray, pair: np.ndarray, links: np.ndarray, *columns: list) -> None:
        self.held.append((n, pair, links))
        for column, values in zip(self.columns, columns, strict=True):
            column += values

    def row(self) -> pa.RecordBatch:
        held, pair, links = map(np.concatenate, zip(*self.held, strict=True))
        pairs, which = np.unique(pair, return_inverse=True)
        packed = (held.astype("<u4"), which.astype("<u4"), links.astype("<i8"))
        values = [[self.task << 32 | self.number], *([c] for c in self.columns), [pairs], [np.bincount(which, minlength=len(pairs))], *([p.tobytes()] for p in packed)]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 3]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        self.number += 1
        self._clear()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)


def _named(names: list[bytes], place: np.ndarray) -> bytes:
    return b"".join(map(names.__getitem__, place.tolist()))


def _names() -> list[bytes]:
    """Decimal ids with a comma, then those with a bar (an A id that ends its side), then those with a semicolon."""
    return [str(i).encode() + mark for mark in (b",", b"|", b";") for i in range(1 << 16)]


def _packed(docs: DataFrame, a_path: str | None, b_path: str | None, block: int) -> DataFrame:
    def run(batches):
        encoder, names, packed = _encoder(a_path, b_path), _names(), _Block(TaskContext.get().partitionId())
        for ids, texts in _texts(batches):
            packed.add(encoder, ids, texts, names)
            if packed.size >= block:
                yield packed.row()
        if packed.held:
            yield packed.row()

    return docs.select("doc_id", "text").mapInArrow(run, _BLOCK)


def _stored(docs: DataFrame, a_path: str | None, b_path: str | None, block: int) -> DataFrame:
    return stage(_packed(docs, a_path, b_path, block), "align-blocks", {**_GROUPED, "parquet.block.size": GROUP})


def _asked(packed: DataFrame) -> DataFrame:
    """The distinct pairs of each block: their place in its list, and how many of its documents hold them."""
    rows = packed.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("place", "p"))
    return rows.select(F.col("block").alias("of"), "place", F.col("p.pairs").alias("pair"), "p.n")


def _counts(asked: DataFrame) -> DataFrame:
    """pair, docs, and whether no other pair of its A id has more documents. An A id has one row in `top`: at most 65,536."""
    counts = stage(asked.groupBy("pair").agg(F.sum("n").alias("docs")), "align-counts")
    top = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 16)).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """How many documents link each A id with each B id: a_id, b_id, docs, best (none of the A id's pairs has more)."""
    packed = _stored(docs, a_path, b_path, block)
    return _counts(_asked(packed)).select(F.shiftright("pair", 16).alias("a_id"), F.col("pair").bitwiseAND(0xFFFF).alias("b_id"), "docs", "best")


def _answered(key, answers: pa.Table, packed: pa.Table) -> pa.Table:
    """The rows of a block's documents."""
    row = {c: packed.column(c)[0].as_py() for c in packed.column_names}
    held, which = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("held", "which"))
    links = np.frombuffer(row["links"], "<i8")
    docs, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, bool)
    place = answers.column("place").to_numpy()
    docs[place], best[place] = answers.column("docs").to_numpy(), answers.column("best").to_numpy()
    ends = np.concatenate(([0], np.cumsum(held)))
    sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends]) for x in (links * best[which], links * docs[which])]
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["groups_sha256"]]
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    return pa.table([pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: its tokens, groups and links, how many links are the best of their A id in the corpus, the
    sum of their counts, and a digest of the groups. Needs doc_id and text."""
    packed = _stored(docs, a_path, b_path, block)
    asked = _asked(packed).drop("n")
    answers = asked.join(_counts(_asked(packed)), "pair").select("of", "place", "docs", "best")
    return answers.groupBy("of").cogroup(packed.drop("pairs", "n").groupBy("block")).applyInArrow(_answered, DOCUMENT)


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
#: Tokenizers have no SQL form; a test holds the query against a plain alignment.
ORACLES: dict = {}
