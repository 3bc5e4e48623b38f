"""Token counts, token shards and pieces against the tokenizers' own libraries."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from messy import MESSY, awkward, frame
from pyspark.sql import functions as F

from quarrylight.llm import pieces, tokencount, tokenout

TEXTS = [t or "" for _, t in MESSY] + ["a<|endoftext|>b  <|startoftext|> É é x y ̈q 'S it's DON'T ΑΣ ΑΣ.", "word's" * 4000, "的" * 3000 + " 好" * 2000, " ".join(["Été 12'll"] * 3000), "'s" * 3000 + "́" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    return tokencount.load()


@pytest.mark.parametrize("options", [{}, {"huge": 100, "chunk": 200, "overlap": 8}])
def test_counts(tokenizer, options):
    tokens, chunks = tokencount.Counter(tokenizer, **options).count(TEXTS)
    assert tokens == [len(x.ids) for x in tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert max(chunks) > 1


def test_resynchronised_ids(tokenizer):
    for text in TEXTS:
        if text:
            ids, _ = tokencount.resynchronised(tokenizer, text, 300, 16)
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("gap", ["\n" * 20_000, " " * 40_000, "-" * 40_000, "的" * 9_000, "a" * 40_000 + " " * 40_000])
@pytest.mark.parametrize("options", [{}, {"huge": 3000, "chunk": 1000, "overlap": 32}])
def test_counts_around_long_runs(tokenizer, gap, options):
    text = " ".join(f"plain words number {i % 89}, and more" for i in range(700))
    texts = [text[:20_000] + gap + text, text[:16_400] + gap + text + gap, gap + text[:9_000] + gap + "end"]
    tokens, chunks = tokencount.Counter(tokenizer, **options).count(texts)
    assert tokens == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts] and any(chunks)


def test_messy_counts(spark):
    rows = tokencount.count_tokens(awkward(spark)).collect()
    assert len(rows) == len(MESSY) and all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 5)} == {(0, 0)}
    assert tokencount.count_tokens(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 1000])
def test_feistel_is_a_bijection(n):
    slots = tokenout.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n)) and (tokenout.unfeistel(slots, n) == np.arange(n, dtype=np.uint64)).all()
    if n > 60:
        assert (tokenout.feistel(np.arange(n), n, 1) != slots).any()


def stream(rows):
    """The token stream of the rows, in order."""
    encoding = tokenout.load()
    rows = sorted((-1 if i is None else i, xxhash.xxh3_64_intdigest((t or "").encode()), t or "") for i, t in rows)
    return [k for _, _, t in rows for k in [*encoding.encode_ordinary(t), tokenout.END]]


def sequences(folder, manifest, length, slots):
    """Sequences in the order of the stream, read back from the files by slot."""
    n = sum(r.n_slots for r in manifest)
    slot = tokenout.feistel(np.arange(n), n)
    return [tokenout.read_slots(str(folder), int(s), 1, length, slots)[0].tolist() for s in slot]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_shards_do_not_depend_on_the_split(spark, tmp_path, parts):
    docs = awkward(spark)
    manifest = tokenout.write(docs.repartition(parts), str(tmp_path / "a"), length=64, slots=100).orderBy("shard").collect()
    want = stream(MESSY)
    got = [k for x in sequences(tmp_path / "a", manifest, 64, 100) for k in x]
    assert got == want + [tokenout.END] * (-len(want) % 64)
    for r in manifest:
        data = next((tmp_path / "a/shards").glob(f"shard-{r.shard:08d}.*.bin")).read_bytes()
        assert len(data) == r.n_bytes == 128 * r.n_slots and hashlib.sha256(data).hexdigest() == r.sha256 and r.first_slot == 100 * r.shard
    sorted_ = tokenout.write(docs.orderBy("doc_id").coalesce(1), str(tmp_path / "b"), length=64, slots=100)
    assert sorted_.orderBy("shard").collect() == manifest
    assert tokenout.write(frame(spark, []), str(tmp_path / "none")).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    docs = awkward(spark)
    first = tokenout.write(docs, str(tmp_path), length=64, slots=100).orderBy("shard").collect()
    files = sorted((tmp_path / "shards").glob("*.bin"))
    kept, lost = files[0], files[1]
    when = kept.stat().st_mtime_ns
    lost.unlink()
    (tmp_path / "shards/.0.part").write_bytes(b"what a lost executor left")
    assert tokenout.write(docs, str(tmp_path), length=64, slots=100).orderBy("shard").collect() == first
    assert lost.exists() and kept.stat().st_mtime_ns == when
    for other, length in ((docs, 32), (docs.limit(0), 64), (docs.union(docs.limit(1)), 64), (docs.replace("a|b", "a|c").withColumn("text", F.concat("text", F.lit("."))), 64)):
        with pytest.raises(ValueError):
            tokenout.write(other, str(tmp_path), length=length, slots=100)
    assert tokenout.write(docs, str(tmp_path), length=64, slots=100).orderBy("shard").collect() == first


def test_runs_of_a_shuffled_table_stay_off_the_driver(spark, tmp_path, monkeypatch):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'text ' || id AS text")
    ordered = tokenout.write(docs.coalesce(1), str(tmp_path / "a"), length=16, slots=100).orderBy("shard").collect()
    seen, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (lambda rows: (seen.append(len(rows)), rows)[1])(collect(self)))
    shuffled = tokenout.write(docs.repartition(8), str(tmp_path / "b"), length=16, slots=100)
    assert max(seen) <= 8
    assert collect(shuffled.orderBy("shard")) == ordered


def test_op9_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = np.array(stream(rows), "<u2")
    n = -(-len(want) // tokenout.LENGTH)
    data = np.full((n, tokenout.LENGTH), tokenout.END, "<u2")
    data[tokenout.feistel(np.arange(n), n)] = np.append(want, np.full(-len(want) % tokenout.LENGTH, tokenout.END, "<u2")).reshape(n, -1)
    got = tokenout.op9_token_shards(spark, folder).collect()
    assert [tuple(r) for r in got] == [(0, 0, n, data.nbytes, hashlib.sha256(data.tobytes()).hexdigest())]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, library):
    table = pieces.pieces()
    texts = TEXTS + ["  a\n b  ", "x\t\ty\r\n\n", " ", "\n", "a▁b", "<s> </s> <unk> <0x41>"]
    for t in texts:
        ids = [i for w in pieces.words_of(t) for i in table.encode_word(w)]
        assert ids == library.encode(t)
        assert table.decode(ids) == t.replace("▁", " ")
        assert [i for w in pieces.words_of(t) for p in table.parts(w) for i in table.encode_word(p)] == ids
    words = sorted({w for t in texts for w in pieces.words_of(t) if len(w) <= 20})[:400]
    got = {r.word: [table.byte[s.byte] if s.id is None else s.id for s in r.symbols] for r in pieces.lattice(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    assert got == {w: table.encode_word(w) for w in words}


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_messy_pieces(spark, library, chunk):
    rows = pieces.digest(awkward(spark), chunk=chunk).collect()
    assert len(rows) == len(MESSY) and all(r.round_trip for r in rows)
    want = sorted(hashlib.sha256(np.array(library.encode(t or ""), np.int32).tobytes()).hexdigest() for _, t in MESSY)
    assert sorted(r.ids_sha256 for r in rows) == want
    back = pieces.decode(pieces.encode(awkward(spark), chunk=chunk)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in MESSY)
    assert pieces.digest(frame(spark, [])).count() == 0


def test_every_word_goes_through_the_lattice(spark, library):
    table = pieces.pieces()
    chunks = pieces.chunked(frame(spark, MESSY).repartition(3), chunk=5000)
    listed = {r.chunk: r.words for r in chunks.collect()}
    got = {(r.chunk, r.at): np.frombuffer(r.ids, ">u2").tolist() for r in pieces.dictionary(chunks, table).collect()}
    assert set(got) == {(c, i) for c, words in listed.items() for i in range(len(words))}
    assert all(got[c, i] == table.encode_word(w) for c, words in listed.items() for i, w in enumerate(words))
    parts = {p for _, t in MESSY for w in pieces.words_of(t or "") for p in table.parts(w)}
    assert {w for words in listed.values() for w in words} == {p for p in parts if len(p) <= pieces.LONG} and any(len(p) > pieces.LONG for p in parts)


def test_words_and_parts_of_all_texts_at_once():
    table, texts = pieces.pieces(), [*TEXTS, "", " ", "\n", " \n\n  a", "a\n b  ", "a▁ b", "▁", "x  \n y\u00a0z", "𝔘𝔫 ñ的,字"]
    column = pieces._text(pa.array([None, *texts]))
    n, which, words = pieces._split(column.slice(2))
    words = words.to_pylist()
    assert [words[i] for i in which] == [w for t in texts[1:] for w in pieces.words_of(t)] and n.tolist() == [len(pieces.words_of(t)) for t in texts[1:]]
    n, which, parts, chars = pieces._cut(pa.array(words, pa.large_string()), table)
    parts = parts.to_pylist()
    assert [parts[i] for i in which] == [p for w in words for p in table.parts(w)] and n.tolist() == [len(table.parts(w)) for w in words]
    assert chars.tolist() == [len(p) for p in parts]


def test_texts_go_as_numbers_and_words_as_packs(spark):
    """Less is dealt than the compressed texts with their words, and a row for a chunk's words of a bucket."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1)
    chunks = pieces.chunked(docs, chunk=1 << 20).collect()
    texts = b"".join(r.text.encode() for r in docs.collect() if r.text)
    assert sum(len(r.blob) + len(r.pack) for r in chunks) < len(pa.compress(texts, "zstd", asbytes=True)) + sum(len(w.encode()) for r in chunks for w in r.words) / 2
    dealt = pieces._encodings(spark.createDataFrame(chunks, pieces.chunked(docs).schema), pieces.pieces()).collect()
    assert len(dealt) <= len(chunks) * 4 and sum(r.n for r in dealt) == sum(len(r.words) for r in chunks)


def test_texts_are_cut_once(spark):
    got = pieces.digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


def test_op10_query(spark, library):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: hashlib.sha256(np.array(library.encode(r.text or ""), np.int32).tobytes()).hexdigest() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.ids_sha256 for r in pieces.op10_sentencepiece(spark, folder).collect()} == want


def test_what_a_task_has_for_a_shard_is_one_packed_row(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('the same text again ', id % 50) AS text").coalesce(1)
    table = tokenout._table(tokenout.encoded(docs), str(tmp_path / "encoded"))
    before, total = tokenout.offsets(table)
    rows = tokenout.fragments(table.coalesce(1), before, total, {1}, length=16, slots=400).collect()
    assert sorted(r.shard for r in rows) == [s for s in range(-(-total // 6400)) if s != 1]
    last = 2 * 16 * (-(-total // 16) % 400 or 400)
    assert all(sum(r.n) in (12800, last, last - 2 * (-total % 16), 12800 - 2 * (-total % 16)) and len(r.ids) < sum(r.n) / 2 for r in rows)
    some = spark.createDataFrame([r for r in rows if r.shard == 0] * 2, "shard long, at array<long>, n array<long>, ids binary")
    with pytest.raises(Exception, match="misses tokens, or has some twice"):
        tokenout.shards(some, total, str(tmp_path / "shards"), length=16, slots=400).collect()
