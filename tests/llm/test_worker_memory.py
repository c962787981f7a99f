"""What Python workers hold beside each other: one pass for ids and texts, no tables of an operator before."""

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from tallyloom.llm import ngram_join, sentencepiece_codec as spc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_the_last_stage_has_one_python_pass(spark, tmp_path):
    texts = [None, "", " ", "a  b\n", "naïve 日本 ▁x \x00 end", "words of a text " * 2000]
    docs = spark.createDataFrame([(i, t, f"kept {i}", "gone") for i, t in enumerate(texts)], "doc_id long, text string, more string, ids string")
    out = cp.tokenise(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert out.columns == ["doc_id", "text", "more", "ids", "decoded", "n_tokens"]
    rows = {r.doc_id: r for r in out.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (rows[i].text, rows[i].more, rows[i].ids, rows[i].decoded, rows[i].n_tokens) == (t, f"kept {i}", ids, sp.decode(ids), len(ids))
    assert spc.round_trip(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("task", [ngram_join._digests(5, 75), ngram_join._entries(5, 75, 2), ngram_join._search(32, 1000)])
def test_a_task_begins_without_the_tables_of_another_operator(task):
    spc.codec(MODEL).encode(pa.array(["some words"]))
    list(task(iter([])))
    assert spc.codec.cache_info().currsize == 0
