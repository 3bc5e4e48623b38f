"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text is cut into chunks that overlap, each chunk is encoded by itself with the tokenizer's character offsets, and
neighbouring chunks are spliced at a common boundary: a place inside the overlap where both encodings start a token,
far enough from the chunk ends, and from which both have the same run of tokens. If a pair of chunks has no such
place, the overlap is widened (doubled) and the pair is encoded again; an overlap wider than the left chunk goes on
into the chunk before, whose splice is undone, in the end as one piece from the start of the text. So the spliced
encoding has the tokens of the whole text, while one call never sees more than a chunk.

Short texts are encoded in batches. Both paths use that this vocabulary's tokens never cross ASCII white space: the
normaliser turns each run of it into one space, composes no character across it, and the pre-tokenizer drops it.
Chunk ends are therefore proven stable where they fall on white space, and counts of short texts are sums over their
space-separated pieces, of which a worker encodes each distinct one once (a bounded memo).

Defined results: a null or empty text has 0 bytes and 0 tokens; rows with equal doc_id are counted one by one.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.kernel import blocks
from quarrylight.llm.store import documents

LIMIT = 2048
#: Texts of more characters than this are huge: they are cut into chunks.
HUGE = 1 << 15
CHUNK, OVERLAP, STABLE = 1 << 14, 1 << 9, 8
#: Pieces that a worker remembers; beyond it the memo starts anew.
MEMO = 500_000
_TAIL = ".,;:!?"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"
_PIECE = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")


def load(name: str = "word_bpe_49k.json", path: str | None = None):
    """The tokenizer as the library has it, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _cut(text: str, at: int, floor: int) -> int:
    """The last white space in text[floor:at], else `at` itself."""
    for k in range(at, floor, -1):
        if _GAP.match(text[k - 1]):
            return k
    return at


def _encode(tokenizer, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and where in the whole text each token starts, of text[start:end]."""
    got = tokenizer.encode(text[start:end], add_special_tokens=False)
    return np.array(got.ids, np.int64), np.array([a for a, _ in got.offsets], np.int64).reshape(-1) + start


def _common(left, right, low: int, high: int) -> tuple[int, int] | None:
    """Token places (in left, in right) with a common stable boundary between the text places low and high."""
    (a, x), (b, y) = left, right
    places = np.intersect1d(x[(x >= low) & (x <= high)], y[(y >= low) & (y <= high)])
    for p in places[np.argsort(np.abs(places - (low + high) // 2), kind="stable")]:
        i, j = int(np.searchsorted(x, p)), int(np.searchsorted(y, p))
        n = min(len(a) - i, len(b) - j, STABLE)
        if n == STABLE and np.array_equal(a[i : i + n], b[j : j + n]) and np.array_equal(x[i : i + n], y[j : j + n]):
            return i, j
    return None


def resynchronised(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int]:
    """Ids of the whole text by overlapping chunks, and how many chunks were encoded."""
    out, n, start = [], 0, 0
    end = min(len(text), _cut(text, chunk, chunk // 2)) if len(text) > chunk else len(text)
    left = _encode(tokenizer, text, start, end)
    n += 1
    before = []  # (start, end, tokens) of the chunk to the left of each splice
    reach = 0
    while end < len(text):
        wide, reach = overlap, max(reach, end)
        while True:
            begin = max(start, _cut(text, max(start, end - wide), max(start, end - 2 * wide)))
            stop = min(len(text), begin + max(chunk, 2 * wide))
            if stop < len(text):
                stop = max(reach + 1, _cut(text, stop, begin + chunk // 2))
            right = _encode(tokenizer, text, begin, stop)
            n += 1
            if begin == start and not before:  # the overlap is all that comes before: nothing to splice
                left = right
                break
            # chunks with one beginning may part from the last splice on, where the tokens of `left` begin
            margin = (end - begin) // 8
            if (place := _common(left, right, begin + margin if begin > start else start, end - margin)) is not None:
                i, j = place
                before.append((start, end, left))
                out.append(left[0][:i])
                left = right[0][j:], right[1][j:]
                break
            if begin == start:
                start, end, left = before.pop()
                out.pop()
            wide *= 2
        start, end = begin, stop
    out.append(left[0])
    return np.concatenate(out), n


_memos: dict[tuple, dict[str, int]] = {}


class Counter:
    """Token counts of many texts."""

    def __init__(self, tokenizer, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, memo: dict[str, int] | None = None):
        self.tokenizer, self.huge, self.chunk, self.overlap, self.memo = tokenizer, huge, chunk, overlap, {} if memo is None else memo

    def _learn(self, pieces: set[str]) -> None:
        """Counts of pieces that are not in the memo."""
        memo, split = self.memo, {}
        todo = set()
        for p in pieces:
            low = p.lower() if p.isascii() else ""
            core = low.rstrip(_TAIL)
            if core.isalpha():  # letters, then marks: the pre-tokenizer parts them, and lower-cases
                split[p] = core, low[len(core) :]
                todo.update(x for x in split[p] if x and x not in memo)
            else:
                todo.add(p)
        order = list(todo)
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            starts = np.cumsum([0, *(len(p) + 1 for p in part)])
            where = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets, np.int64).reshape(-1, 2)[:, 0]
            memo.update(zip(part, np.diff(np.searchsorted(where, starts)).tolist(), strict=True))
        for p, (core, tail) in split.items():
            memo[p] = memo[core] + (memo[tail] if tail else 0)

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens, and chunks encoded (0 for a text that is not huge)."""
        tokens, chunks = [0] * len(texts), [0] * len(texts)
        memo, short, found = self.memo, [], set()
        for i, text in enumerate(texts):
            if len(text) > self.huge:
                ids, chunks[i] = resynchronised(self.tokenizer, text, self.chunk, self.overlap)
                tokens[i] = len(ids)
            else:
                pieces = _PIECE.findall(text)
                short.append((i, pieces))
                found.update(pieces)
        new = found.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = found
        self._learn(new)
        for i, pieces in short:
            tokens[i] = sum(map(memo.__getitem__, pieces))
        return tokens, chunks


def count_tokens(docs: DataFrame, limit: int = LIMIT, name: str = "word_bpe_49k.json", path: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, n_chunks. Needs doc_id and text; no shuffle."""

    def run(batches):
        counter = Counter(load(name, path), huge, chunk, overlap, _memos.setdefault((name, path), {}))
        for batch in batches:
            for i, j, flat, at in blocks(batch.column("text")):
                data = flat.tobytes()
                texts = [data[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
                tokens, chunks = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at)), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens]), pa.array(chunks, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict = {}
