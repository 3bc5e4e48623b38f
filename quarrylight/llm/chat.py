"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn two marks, the role, a mark, the text, a mark. The marks are special
tokens of the tokenizer, so a token never crosses one. The rendered text is encoded once, with the byte offsets of the
tokens; the spans of the texts to learn (those of LEARNT roles) are sorted, and a binary search finds the span that each
token may lie in. What is returned can be read back without loss: ids and mask give all roles and texts, and the text
under the mask.

Control strings inside roles and texts are escaped: a backslash goes behind the first character, and one more where
some stand there already, so each string has one escaped form. No control string holds another one's first character
but at its beginning; `Template` insists on that, and so the marks and texts around them cannot form a new one.

Rows are dealt by ranges of (conversation, turn), not by conversation, so a conversation with a third of all rows is
worked on by many tasks. Where a range ends within a conversation, or its text passes SEGMENT characters, it is cut
between two turns to segments; as no token crosses a mark, their ids are those of the whole. Only the digests of such
conversations pass one task each, which streams their segments in order and holds one at a time.

Defined results: rows are ordered by turn, role and text, nulls first; rows that repeat are turns each; a null role or
text is empty; rows without a conv_id are one conversation; a conversation without a text to learn has 0 characters under
the mask (and the digest of an empty text). An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.store import stage

#: Characters of a segment; characters whose rows are returned together.
SEGMENT, CALL = 4 << 20, 1 << 19
#: The id behind those of the rank file, which other operators use as the end of a document.
END = 50256
LEARNT = ("assistant",)
FORMATTED = "conv_id long, segment long, whole boolean, n_turns long, formatted string, ids array<int>, learnt array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = "conv_id long, segment long, whole boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """The marks before a turn, before and behind its role, and behind its text, and other strings to escape."""

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"
    others: tuple[str, ...] = ("<|endoftext|>",)

    def __post_init__(self):
        if any(len(c) < 2 or c[1] == "\\" or any(c[0] in d[1:] for d in self.controls) for c in self.controls):
            raise ValueError("a control string holds the first character of one, or has no second one")

    @property
    def marks(self) -> list[str]:
        return [self.begin, self.role, self.text, self.end]

    @property
    def controls(self) -> list[str]:
        return [*self.marks, *self.others]

    def pattern(self, least: int) -> str:
        """Control strings with `least` or more backslashes behind the first character, which is one group."""
        slashes = r"\\*" if not least else r"\\+"
        return "|".join(f"{re.escape(c[0])}{slashes}{re.escape(c[1:])}" for c in self.controls)

    def escape(self, text: str) -> str:
        if not any(c[0] in text for c in self.controls):
            return text
        return re.sub(self.pattern(0), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(1), lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text

    def render(self, turns: list[tuple[str, str]], learnt: tuple[str, ...]) -> tuple[str, list[int], list[int]]:
        """The rendered turns, and the bytes where the texts to learn begin and end."""
        out, at, begins, ends = [], 0, [], []
        for role, text in turns:
            head, body = f"{self.begin}{self.role}{self.escape(role)}{self.text}", self.escape(text)
            out += [head, body, self.end]
            at += len(head.encode())
            size = len(body.encode())
            if role in learnt and body:
                begins.append(at)
                ends.append(at + size)
            at += size + len(self.end.encode())
        return "".join(out), begins, ends


class Encoder:
    """A byte-level tokenizer with the template's marks as special tokens, the ids behind END."""

    def __init__(self, template: Template, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
        self.template = template
        self.marks = [END + 1 + i for i in range(len(template.marks))]
        special = dict(zip(template.marks, self.marks, strict=True))
        self.tokenizer = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        self.bytes = {i: token for token, i in ranks.items()} | {i: m.encode() for m, i in special.items()}
        self.length = np.zeros(max(self.bytes) + 1, np.int64)
        for i, token in self.bytes.items():
            self.length[i] = len(token)

    def encode(self, text: str, begins: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and which of them to learn: those whose offsets lie in one of the sorted spans of bytes."""
        ids = np.array(self.tokenizer.encode(text, allowed_special=self.allowed, disallowed_special=()), np.int64)
        end = np.cumsum(self.length[ids])
        span = np.searchsorted(begins, end - self.length[ids], side="right") - 1
        return ids, (span >= 0) & (end <= np.array([*ends, 0])[span])

    def read(self, ids: np.ndarray, learnt: np.ndarray) -> tuple[list[tuple[str, str]], list[str], int]:
        """From ids and mask: all (role, text), the texts under the mask, and the characters of the rendered text."""
        _, role, text, end = self.marks
        ids = ids.astype(np.int64)
        get, unescape = self.bytes.__getitem__, self.template.unescape
        chars = len(b"".join(map(get, ids.tolist())).decode())
        turns = []
        heads, bodies, ends = (np.flatnonzero(ids == m) for m in (role, text, end))
        for i, j, k in zip(heads.tolist(), bodies.tolist(), ends.tolist(), strict=True):
            turns.append(tuple(unescape(b"".join(map(get, ids[a + 1 : b].tolist())).decode()) for a, b in ((i, j), (j, k))))
        edge = np.diff(np.concatenate(([0], learnt.astype(np.int8), [0])))
        runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
        return turns, [unescape(b"".join(map(get, ids[a:b].tolist())).decode()) for a, b in runs], chars


_encoders: dict[tuple, Encoder] = {}


def _encoder(*of) -> Encoder:
    if of not in _encoders:
        _encoders[of] = Encoder(*of)
    return _encoders[of]


def _segments(batches, limit: int):
    """(conv_id, opens, closes, turns) of the sorted rows of a task: whether the conversation surely begins and ends here."""
    key, turns, size, first, opens = None, [], 0, True, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv != key:
                yield key, opens, True, turns
                first, opens, turns, size = False, True, [], 0
            elif turns and size > limit:
                yield key, opens, False, turns
                opens, turns, size = False, [], 0
            key = conv
            turns.append((role or "", text or ""))
            size += 1 + len(turns[-1][0]) + len(turns[-1][1])
    if turns:
        yield key, opens, False, turns


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def formatted(conversations: DataFrame, template: Template = Template(), learnt: tuple[str, ...] = LEARNT, path: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per segment of a conversation: conv_id, segment (ascending within it), whether it is surely the whole of
    it, n_turns, the rendered text, ids, and which of them to learn. Needs conv_id, turn, role and text."""

    def run(batches):
        encoder, task, number = _encoder(template, path), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            rendered = [template.render(turns, learnt) for *_, turns in held]
            tokens = [encoder.encode(*r) for r in rendered]
            columns = [
                pa.array([h[0] for h in held], pa.int64()), pa.array([task << 32 | h[1] for h in held], pa.int64()), pa.array([h[2] for h in held]), pa.array([len(h[3]) for h in held], pa.int64()),
                pa.array([r[0] for r in rendered]), _lists([t[0].astype(np.int32) for t in tokens]), _lists([t[1] for t in tokens]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FORMATTED.split(", ")])

        for conv, opens, closes, turns in _segments(batches, segment):
            held.append((conv, number, opens and closes, turns))
            number += 1
            size += sum(len(t) for _, t in turns)
            if size > CALL:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def _read(batches, encoder: Encoder):
    """(conv_id, turns as role, line feed, text, line feed each; texts under the mask; number of turns; characters under
    the mask and rendered) of formatted rows."""
    for batch in batches:
        ids, learnt = batch.column("ids"), batch.column("learnt")
        for i, conv in enumerate(batch.column("conv_id").to_pylist()):
            turns, texts, chars = encoder.read(ids[i].values.to_numpy(), learnt[i].values.to_numpy(zero_copy_only=False))
            loss = "".join(texts)
            yield conv, "".join(f"{r}\n{t}\n" for r, t in turns).encode(), loss.encode(), len(turns), len(loss), chars


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def digests(table: DataFrame, template: Template = Template(), path: str | None = None) -> DataFrame:
    """One row per conversation, read back from ids and masks of a table of `formatted`: number of turns and a digest of
    them, characters under the mask and a digest of them, characters of the rendered text."""

    def of_wholes(batches):
        rows = []
        for conv, turns, loss, n, n_loss, chars in _read(batches, _encoder(template, path)):
            rows.append((conv, n, hashlib.sha256(turns).hexdigest(), n_loss, hashlib.sha256(loss).hexdigest(), chars))
            if len(rows) == 1024:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def of_segments(batches):
        key, held = None, None
        for conv, turns, loss, *numbers in _read(batches, _encoder(template, path)):
            if held is None or conv != key:
                if held is not None:
                    yield row(key, *held)
                key, held = conv, (hashlib.sha256(), hashlib.sha256(), np.zeros(3, np.int64))
            held[0].update(turns)
            held[1].update(loss)
            held[2][:] += numbers
        if held is not None:
            yield row(key, *held)

    def row(conv, turns, loss, numbers) -> pa.RecordBatch:
        n, n_loss, chars = numbers.tolist()
        return _batch([(conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars)])

    columns = ["conv_id", "ids", "learnt"]
    cut = table.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return table.where("whole").select(*columns).mapInArrow(of_wholes, DIGEST).unionByName(cut.select(*columns).mapInArrow(of_segments, DIGEST))


#: A conversation whose texts hold control strings, beside those of the table.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(stage(formatted(given.unionByName(planted)), "chat"))


QUERIES = {"op12_chat_format": op12_chat_format}
_HELD = r"<\\*s>|\[\\*INST\]|\[\\*/INST\]|<\\*/s>|<\\*\|endoftext\|>"
ORACLES = {
    "op12_chat_format": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]' || role || '[/INST]' || text || '</s>') + len(regexp_extract_all(role, '{_HELD}')) + len(regexp_extract_all(text, '{_HELD}')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
}
