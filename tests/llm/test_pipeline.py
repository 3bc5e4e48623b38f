"""The pipeline's stages on a small table, each against the operator's brute force on its own input."""

import pytest
from messy import awkward
from test_neardup import brute
from test_scoring_ops import leaks_brute
from test_windows_ops import passages_brute

from quarrylight.llm import quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, FOLDER)
    columns, dtypes = docs.columns, docs.dtypes
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = corpus_pipeline.stage(step(spark, docs, FOLDER), f"test-{name}")
        seen[name] = docs
        if name != "pieces":
            assert docs.columns == columns and docs.dtypes == dtypes
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            assert set(after) == {i for i, x in brute(before).items() if x[2]}
        if name == "repeated_passages":
            lost = {i: n for i, _, n, _ in passages_brute(before, 50)}
            words = {i: len((t or "").split()) for i, t in before}
            assert all(len((r.text or "").split()) == words[i] - lost[i] and r.n_chars == len(r.text) for i, r in after.items())
        if name == "decontamination":
            assert set(after) == {i for i, _ in before} - {d for d, _ in leaks_brute(before, items)}
        if name == "pieces":
            assert all(r.n_tokens == len(r.ids) for r in after.values()) and set(after) == {i for i, _ in before}


def test_run(spark):
    spark.conf.unset(corpus_pipeline.BATCH_CONF)
    before = spark.conf.get(corpus_pipeline.BATCH_CONF, None)
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
    assert spark.conf.get(corpus_pipeline.BATCH_CONF, None) == before


def test_pieces_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    step = dict(corpus_pipeline.STAGES)["pieces"]
    for docs in (awkward(spark), corpus_pipeline.documents(spark, FOLDER).limit(60)):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = sorted((-1 if i is None else i, model.encode(t) if t else []) for i, t in rows)
        got = [(-1 if r.doc_id is None else r.doc_id, r.ids, r.n_tokens) for r in step(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()]
        assert sorted((i, ids) for i, ids, _ in got) == want and all(n == len(ids) for _, ids, n in got)


def test_quality_keeps_what_its_operator_keeps(spark):
    """The documents of the stage are those that the scoring query keeps, their texts without the failing lines."""
    docs = corpus_pipeline.documents(spark, FOLDER)
    kept = {r.doc_id for r in quality.QUERIES["op7_quality_rules"](spark, FOLDER).where("kept").collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, FOLDER).collect()}
    assert set(after) == kept
    for i, text in after.items():
        lines = whole[i].split("\n")
        at = iter(lines)
        assert all(any(x == y for y in at) for x in text.split("\n")) and len(text) <= len(whole[i])  # lines that were there, in order


def test_awkward_table(spark):
    docs = awkward(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stage(step(spark, docs, FOLDER), f"awkward-{name}")
        assert out.columns == docs.columns
        docs = out
    assert docs.count() >= 2
