"""SentencePiece encoding and decoding over a relational lattice.

A text is a dummy space and the text, spaces written as U+2581, cut into words: a run of spaces with the letters after
it. No piece crosses from a letter to a later space, or holds a line feed, so words are encoded independently; so are
the parts of a word between two neighbouring characters that no piece has side by side.

1. `chunked` cuts texts into chunks of some megabytes. A chunk is written as numbers: each text is a row of numbers of
   parts of words, frequent ones small, and the chunk has the list of its distinct parts. Numbers, not texts, are dealt.
2. `lattice` encodes every distinct part of the corpus relationally: all substrings up to the longest piece's length are
   exploded, equi-joined to the piece table (a bounded broadcast), and the edges found are grouped by word. The model
   file is of the BPE kind, for which the best-scored path through the lattice (Viterbi) is not the library's encoding;
   so the fold that runs over the grouped edges, Spark's higher-order `aggregate`, takes BPE's steps instead: each one
   joins the two neighbouring symbols whose joint edge scores best, the leftmost of equals. Characters without a piece
   become bytes. The table stays dealt by word from `distinct` to the fold.
3. What a chunk has of a bucket of words is one packed row. Packs meet the encodings of their bucket (as many buckets as
   shuffle partitions), go back packed to their chunk, and there the numbers of parts are replaced by ids.

A part of more than LONG characters without such a place to cut it, as in long runs of one letter, is encoded where it
is found by the same steps on an agenda: a fold over its lattice would take the square of its length.

Defined results: a null or empty text has no ids; a U+2581 in a text is encoded as the library does, as a space (and
only such texts do not come back from decode unchanged); rows that repeat a doc_id are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.store import documents

SPACE = "▁"
#: Characters of a part of a word that the lattice takes at most; bytes of text in a chunk.
LONG, CHUNK = 64, 8 << 20
#: Parts of words that are replaced by their ids at a time, and bytes of packed words that are looked up at a time.
PARTS, LOOKED_UP = 1 << 18, 4 << 20
#: Words up to this length are encoded by scanning, longer ones by an agenda.
SCANNED, _NONE = 64, -1e30
_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Pieces:
    """The piece table of a .model file."""

    def __init__(self, name: str = "piece_bpe_32k.model", path: str | None = None):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(name))
        ids = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id) or len(self.byte) != 256:
            raise ValueError("a piece crosses words, or the model has no bytes to fall back on")
        if len(ids) > 1 << 16:
            raise ValueError("ids are shuffled as two bytes each")
        self.text = {i: p for p, i in self.id.items()}
        self.pairs = np.array(sorted(ord(x) << 32 | ord(y) for x, y in self.joined), np.uint64)
        self.of_byte = {i: b for b, i in self.byte.items()}

    def encode_word(self, word: str) -> list[int]:
        """BPE of one word: the lattice's edges between neighbouring symbols, the best one joined each time."""
        if len(word) > SCANNED:
            return self._encode_long(word)
        get, parts = self.score.get, list(word)
        scores = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > _NONE:
            i = scores.index(best)  # the leftmost of equals
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        ids = self.id
        try:
            return [ids[p] for p in parts]
        except KeyError:
            return [k for p in parts for k in ([ids[p]] if p in ids else [self.byte[b] for b in p.encode()])]

    def parts(self, word: str) -> list[str]:
        """The word cut between neighbouring characters that no piece has side by side."""
        joined, at, out = self.joined, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def _encode_long(self, word: str) -> list[int]:
        """The same for long words, by an agenda."""
        n = len(word)
        end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        score, longest = self.score, self.longest
        agenda: list[tuple] = []

        def propose(i: int, j: int) -> None:
            if end[j] - i <= longest and (s := score.get(word[i : end[j]])) is not None:
                heapq.heappush(agenda, (-s, i, end[j], end[i]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, stop, middle = heapq.heappop(agenda)
            if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[i], after[i] = stop, after[middle]
            if stop < n:
                before[stop] = i
                propose(i, stop)
            if before[i] >= 0:
                propose(before[i], i)
        out, i = [], 0
        while i < n:
            piece = word[i : end[i]]
            if (k := self.id.get(piece)) is None:
                out += [self.byte[b] for b in piece.encode()]
            else:
                out.append(k)
            i = end[i]
        return out

    def decode(self, ids) -> str:
        """The text of ids; the dummy space goes."""
        raw = b"".join(self.text[i].encode() if i in self.text else bytes([self.of_byte[i]]) for i in ids)
        out = raw.decode(errors="replace").replace(SPACE, " ")
        return out[1:] if out.startswith(" ") else out


def words_of(text: str) -> list[str]:
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


_pieces: dict[tuple, Pieces] = {}


def pieces(name: str = "piece_bpe_32k.model", path: str | None = None) -> Pieces:
    if (name, path) not in _pieces:
        _pieces[name, path] = Pieces(name, path)
    return _pieces[name, path]


def piece_table(spark: SparkSession, table: Pieces) -> DataFrame:
    """(piece, id, rank); as many rows as the vocabulary has. A higher score has a higher rank, and equal ones have the same."""
    rank = {score: i for i, score in enumerate(sorted(set(table.score.values())))}
    rows = pa.table({"piece": list(table.id), "id": pa.array(table.id.values(), pa.int64()), "rank": pa.array([rank[table.score[p]] for p in table.id], pa.int64())})
    return spark.createDataFrame(rows)


def _key(start: Column, stop: Column) -> Column:
    return start * 1000 + stop


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bounds(word: Column, edges: Column) -> Column:
    """Where symbols begin and end after all joins; edges: map of _key(start, stop) to rank * 65536 + id.

    The fold carries the bounds, with one that no edge has at each end, and for each of them the rank of the edge that
    would take it away (-1: none). A join changes the ranks of its two neighbours alone, so only these are looked up.
    """

    def rank(start: Column, stop: Column) -> Column:
        return F.coalesce(F.shiftright(F.try_element_at(edges, _key(start, stop)), 16).cast("int"), F.lit(-1))

    def joined(bounds: Column, ranks: Column, p: Column) -> Column:
        return _let(
            F.concat(F.slice(bounds, F.lit(1), p), F.slice(bounds, p + 2, F.size(bounds))),
            lambda b: F.struct(
                b.alias("bounds"),
                F.concat(F.slice(ranks, F.lit(1), p - 2), F.array(rank(F.get(b, p - 2), F.get(b, p)), rank(F.get(b, p - 1), F.get(b, p + 1))), F.slice(ranks, p + 2, F.size(ranks))).alias("ranks"),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        bounds, ranks = state["bounds"], state["ranks"]
        best = F.array_max(ranks)
        # the leftmost of equals
        return F.when(best < 0, state).otherwise(_let(F.array_position(ranks, best).cast("int"), lambda p: joined(bounds, ranks, p)))

    n = F.char_length(word)
    ranks = F.transform(F.sequence(F.lit(0), n), lambda i: rank(i - 1, i + 1))
    start = F.struct(F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), n), F.array(F.lit(999))).alias("bounds"), ranks.alias("ranks"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda state: F.slice(state["bounds"], F.lit(2), F.size(state["bounds"]) - 2))


def _symbols(word: Column, edges: Column, bounds: Column) -> Column:
    """Of each symbol the id, or of a character without a piece its bytes."""

    def symbol(j: Column) -> Column:
        start, stop = F.get(bounds, j), F.get(bounds, j + 1)
        digits = F.hex(F.encode(F.substring(word, start + 1, stop - start), "UTF-8"))
        spelt = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda k: F.struct(F.lit(None).cast("int").alias("id"), F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int").alias("byte")))
        found = F.try_element_at(edges, _key(start, stop)).bitwiseAND(F.lit(65535)).cast("int")
        return F.when(found.isNotNull(), F.array(F.struct(found.alias("id"), F.lit(None).cast("int").alias("byte")))).otherwise(spelt)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), symbol))


def lattice(words: DataFrame, table: Pieces) -> DataFrame:
    """(word, symbols): of each distinct non-empty word, an array of (id of a piece, or else byte)."""
    spark = words.sparkSession
    each = words.select("word").where("word <> ''").distinct()
    starts = each.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("start"))
    most = F.least(F.lit(table.longest), F.char_length("word") - F.col("start"))
    found = starts.select("word", "start", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    found = found.select("word", "start", "size", F.expr("substring(word, start + 1, size)").alias("piece"))
    # single characters stay without a piece too, so that each word has a row
    edges = found.join(F.broadcast(piece_table(spark, table)), "piece", "left").where("id IS NOT NULL OR size = 1")
    # the map is built below the fold: within it, it would be built anew for each look-up
    entry = F.when(F.col("id").isNotNull(), F.struct(_key(F.col("start"), F.col("start") + F.col("size")), F.col("rank") * 65536 + F.col("id")))
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))
    folded = grouped.select("word", "edges", _bounds(F.col("word"), F.col("edges")).alias("bounds"))
    return folded.select("word", _symbols(F.col("word"), F.col("edges"), F.col("bounds")).alias("symbols"))


def _packed(table: Pieces) -> Column:
    """Symbols as ids of two bytes each."""
    byte = F.array(*(F.lit(table.byte[b]) for b in range(256)))
    ids = F.transform("symbols", lambda s: F.coalesce(s["id"], F.get(byte, s["byte"])))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i.cast("long")), 4, "0")), ""))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(packed: bytes) -> bytes:
    return pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 of all i, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _strings(sizes: np.ndarray, data) -> pa.Array:
    """Strings of so many bytes each from one buffer."""
    ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def _text(column: pa.Array) -> pa.Array:
    """Texts with their dummy space; a U+2581 is a space."""
    text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts of `_text`, as `words_of` finds them, all texts at once: (words of each text, number of each word's
    string, the distinct strings)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    line, space = data == 10, data == 32
    # a word begins with a text, at and after a line feed, and at the first of some spaces
    starts = line | space
    starts[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    starts[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(starts)
    coded = _strings(np.diff(np.append(starts, len(data))), data).dictionary_encode()
    return np.diff(np.searchsorted(starts, ends)), coded.indices.to_numpy(), pc.replace_substring(coded.dictionary, " ", SPACE)


def _cut(words: pa.Array, table: Pieces) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Parts of words, as `Pieces.parts` cuts them, all words at once: (parts of each word, number of each part's string,
    the distinct strings, their characters)."""
    text = b"".join(words.cast(pa.large_binary()).to_pylist())
    code = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    pair = code[:-1].astype(np.uint64) << np.uint64(32) | code[1:]
    at = np.minimum(np.searchsorted(table.pairs, pair), len(table.pairs) - 1)
    cut = np.append(True, table.pairs[at] != pair)
    first = np.append(0, np.cumsum(pc.utf8_length(words).to_numpy()))
    cut[first[:-1]] = True
    starts = np.flatnonzero(cut)
    byte = np.append(0, np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)))
    coded = _strings(np.diff(byte[np.append(starts, len(code))]), text).dictionary_encode()
    which = coded.indices.to_numpy()
    chars = np.empty(len(coded.dictionary), np.int64)
    chars[which] = np.diff(np.append(starts, len(code)))
    return np.diff(np.searchsorted(starts, first)), which, coded.dictionary, chars


#: A chunk: of each text doc_id, a hash and how many parts it has; numbers of parts in four planes of bytes, in the order
#: of the texts, and the place in the list of words of each number; and the ids of parts beyond LONG, which come after it.
_CHUNK = pa.schema([("doc_id", pa.list_(pa.int64())), ("seal", pa.list_(pa.binary(16))), ("n", pa.list_(pa.int64())), ("numbers", pa.large_binary()), ("places", pa.large_binary()), ("long_n", pa.list_(pa.int64())), ("long_ids", pa.list_(pa.uint16()))])


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _seal(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _pack(words: list[bytes]) -> bytes:
    """How many words, their sizes, and the words."""
    return len(words).to_bytes(4, "little") + np.array([*map(len, words)], "<u2").tobytes() + b"".join(words)


def _unpack(raw: bytes) -> tuple[np.ndarray, memoryview]:
    """Sizes of words, and the words."""
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u2", n, 4), memoryview(raw)[2 * n + 4 :]


def _chunks(docs: DataFrame, name: str, path: str | None, chunk: int) -> DataFrame:
    """(chunk, blob, pack, counts): some megabytes of documents as numbers of parts of words (_CHUNK); their distinct parts
    up to LONG, bucket by bucket, packed, and how many each bucket has."""
    buckets = _buckets(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        table, part, done = pieces(name, path), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, pa.Array]] = []

        def out():
            nonlocal done
            doc_ids, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            seals = [_seal(t) for t in texts.cast(pa.large_binary()).to_pylist()]
            n_words, seq, distinct = _split(_text(texts))
            n, coded, places = np.zeros(len(texts), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
            words, long, counts = [], [], np.zeros(buckets, np.int64)
            if len(seq):
                of_word, which, strings, chars = _cut(distinct, table)
                raw = strings.cast(pa.large_binary()).to_pylist()
                dealt = np.array([zlib.crc32(t) % buckets for t in raw], np.int64)
                dealt[chars > LONG] = buckets
                order = pc.sort_indices(pa.table({"bucket": dealt, "text": strings}), [("bucket", "ascending"), ("text", "ascending")]).to_numpy()
                counts = np.bincount(dealt, minlength=buckets + 1)[:buckets]
                short = int(counts.sum())
                words, long = [raw[i] for i in order[:short]], [table.encode_word(raw[i].decode()) for i in order[short:]]
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                # frequent parts get small numbers
                count = np.bincount(which, np.repeat(np.bincount(seq, minlength=len(of_word)), of_word), len(raw))
                places = np.argsort(-count[order], kind="stable").astype(np.int32)
                number = np.empty(len(order), np.int32)
                number[places] = np.arange(len(order), dtype=np.int32)
                sizes = of_word[seq]
                coded = number[place[which]][_spread((np.cumsum(of_word) - of_word)[seq], sizes)]
                n = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(n_words))])
            row = [doc_ids.to_pylist(), seals, n, _planes(coded), _planes(places), [len(x) for x in long], [i for x in long for i in x]]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_batch(pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip(row, _CHUNK, strict=True)], schema=_CHUNK))
            blob = sink.getvalue().to_pybytes()
            own = xxhash.xxh3_64_intdigest(blob, part << 24 | done) - (1 << 63)
            done += 1
            held.clear()
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([blob], pa.binary()), pa.array([_squeezed(_pack(words))], pa.binary()), pa.array([counts], pa.list_(pa.int32()))], names=["chunk", "blob", "pack", "counts"])

        size = 0
        for batch in batches:
            ids, text = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            at, ends = 0, np.cumsum(np.asarray(pc.binary_length(text).fill_null(0)), dtype=np.int64)
            while at < len(text):
                base = ends[at - 1] if at else 0
                stop = min(len(text), max(at + 1, int(np.searchsorted(ends, base + chunk - size, side="right"))))
                held.append((ids.slice(at, stop - at), text.slice(at, stop - at).cast(pa.large_string()).fill_null("")))
                size, at = size + int(ends[stop - 1] - base), stop
                if size >= chunk or at < len(text):
                    yield out()
                    size = 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


_PACKED = "chunk long, blob binary, pack binary, counts array<int>"


def chunked(docs: DataFrame, name: str = "piece_bpe_32k.model", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The chunks of documents, with the list of a chunk's words to read."""

    def run(batches):
        for batch in batches:
            words = []
            for x in batch.column("pack").to_pylist():
                sizes, data = _unpack(_opened(x))
                words.append(_strings(sizes, data).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names=[*batch.schema.names, "words"])

    return _chunks(docs, name, path, chunk).mapInArrow(run, f"{_PACKED}, words array<string>")


def _encodings(chunks: DataFrame, table: Pieces) -> DataFrame:
    """(chunk, at, n, ids): packed encodings of n words (sizes, then ids, two bytes each) of a chunk from the at-th on,
    all by the lattice."""
    buckets = _buckets(chunks.sparkSession)

    def dealt(batches):
        # all columns are read, so that the exchange of chunks is one for both its readers
        for batch in batches:
            for own, pack, counts in zip(batch.column("chunk").to_pylist(), batch.column("pack").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sizes, data = _unpack(_opened(pack))
                at, byte = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(sizes, dtype=np.int64))
                bucket = np.flatnonzero(counts)
                packs = [_squeezed((b - a).item().to_bytes(4, "little") + sizes[a:b].tobytes() + data[byte[a] : byte[b]]) for a, b in zip(at[bucket], at[bucket + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packs), own)), pa.array(bucket.astype(np.int32)), pa.array(at[bucket].astype(np.int32)), pa.array(packs, pa.binary())], names=["chunk", "bucket", "at", "pack"])

    def listed(packs) -> tuple[list[int], pa.Array]:
        """How many words each pack has, and the words."""
        counts, sizes, data = [], [], []
        for x in packs:
            own, words = _unpack(_opened(x))
            counts.append(len(own))
            sizes.append(own)
            data.append(words)
        return counts, _strings(np.concatenate(sizes), b"".join(data))

    def unpacked(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                words = pc.unique(listed(batch.column("pack").slice(i, 100).to_pylist())[1])
                for j in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays([words.slice(j, 50_000).cast(pa.string())], names=["word"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("word").cast(pa.large_string()).combine_chunks()
        sizes = pc.binary_length(right.column("ids")).to_numpy().astype(np.int64) // 2
        flat, starts = np.frombuffer(b"".join(right.column("ids").to_pylist()), ">u2").astype("<u2"), np.cumsum(sizes) - sizes
        packs, out, ns = left.column("pack").to_pylist(), [], []
        size = np.cumsum([int.from_bytes(x[:4], "little") for x in packs]) // LOOKED_UP
        bounds = [*np.flatnonzero(np.diff(size, prepend=-1)), len(packs)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            counts, words = listed(packs[a:b])
            found = pc.index_in(words, value_set=known)
            if found.null_count:
                raise ValueError("a word has no encoding")
            found, at = found.to_numpy(), 0
            ns += counts
            for n in counts:
                own, at = found[at : at + n], at + n
                out.append(_squeezed(sizes[own].astype("<u2").tobytes() + flat[_spread(starts[own], sizes[own])].tobytes()))
        return pa.table({"chunk": left.column("chunk"), "at": left.column("at"), "n": pa.array(ns, pa.int32()), "ids": pa.array(out, pa.binary())})

    packs = chunks.mapInArrow(dealt, "chunk long, bucket int, at int, pack binary").repartition("bucket")
    bucket = F.pmod(F.crc32(F.col("word")), F.lit(buckets)).cast("int").alias("bucket")
    # a number of partitions that stays: the words are few bytes, but each of them is much work
    words = packs.mapInArrow(unpacked, "word string").repartition(buckets, "word")
    encoded = lattice(words, table).select(bucket, "word", _packed(table).alias("ids"))
    return packs.groupBy("bucket").cogroup(encoded.groupBy("bucket")).applyInArrow(met, "chunk long, at int, n int, ids binary")


def _sizes_and_ids(n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(_opened(packed), "<u2")
    return both[:n].astype(np.int64), both[n:]


def dictionary(chunks: DataFrame, table: Pieces) -> DataFrame:
    """(chunk, at, ids): the encoding of each entry of each chunk's words, ids as two bytes each."""

    def run(batches):
        for batch in batches:
            for own, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("chunk", "at", "n", "ids")), strict=True):
                sizes, ids_ = _sizes_and_ids(n, ids)
                parts = [x.astype(">u2").tobytes() for x in np.split(ids_, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(parts, pa.binary())], names=["chunk", "at", "ids"])

    return _encodings(chunks, table).mapInArrow(run, "chunk long, at int, ids binary")


def _encoded(docs: DataFrame, name: str, path: str | None, chunk: int, form, schema: str) -> DataFrame:
    """form(table)(doc_ids, hashes of texts, ids of all texts as int32, where each text's end) of some texts of a chunk."""
    chunks = _chunks(docs, name, path, chunk).repartition("chunk")
    known = _encodings(chunks, pieces(name, path)).groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "ids")).alias("known"))

    def run(batches):
        give = form(pieces(name, path))
        for batch in batches:
            for blob, known_ in zip(batch.column("blob"), batch.column("known"), strict=True):
                held = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0]
                doc_ids, seals, n, long_n, long_ids = (held.column(c).flatten() for c in ("doc_id", "seal", "n", "long_n", "long_ids"))
                packs = sorted(known_.as_py() or [], key=lambda x: x["at"])
                both = [*(_sizes_and_ids(x["n"], x["ids"]) for x in packs), (long_n.to_numpy(), long_ids.to_numpy())]
                sizes, flat = (np.concatenate(x) for x in zip(*both, strict=True))
                starts, n = np.cumsum(sizes) - sizes, n.to_numpy()
                parts = _unplaned(held.column("places")[0].as_py())[_unplaned(held.column("numbers")[0].as_py())]
                ends = np.cumsum(n)
                groups = np.flatnonzero(np.diff((ends - n) // PARTS, prepend=-1)).tolist()
                for a, b in zip(groups, [*groups[1:], len(n)], strict=True):
                    own = parts[ends[a] - n[a] : ends[b - 1]]
                    ids = flat[_spread(starts[own], sizes[own])].astype("<i4")
                    until = np.append(0, np.cumsum(sizes[own]))[ends[a:b] - (ends[a] - n[a])]
                    yield give(doc_ids.slice(a, b - a), seals.slice(a, b - a).to_pylist(), ids, until)
                pa.default_memory_pool().release_unused()

    # all columns again: without one of them the exchange would be another, and the texts be cut twice
    return chunks.join(known, "chunk", "left").select("blob", "pack", "counts", "known").mapInArrow(run, schema)


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids (array<int>) of each document."""

    def form(table):
        def give(doc_ids, seals, ids, ends):
            return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

        return give

    return _encoded(docs, name, path, chunk, form, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "piece_bpe_32k.model", path: str | None = None) -> DataFrame:
    """doc_id and text of each row with ids."""

    def run(batches):
        table = pieces(name, path)
        for batch in batches:
            text = [table.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, name: str = "piece_bpe_32k.model", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip (decoding gives the text)."""

    def form(table):
        raw = np.array([table.text[i].encode() if i in table.text else bytes([table.of_byte[i]]) if i in table.of_byte else b"" for i in range(max(table.text) + 1)], object)
        mark = SPACE.encode()

        def give(doc_ids, seals, ids, ends):
            each = np.split(ids, ends[:-1])
            back = [_seal(b"".join(raw[x].tolist()).replace(mark, b" ")[1:]) == seal for x, seal in zip(each, seals, strict=True)]
            return pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "round_trip"],
            )

        return give

    return _encoded(docs, name, path, chunk, form, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict = {}
