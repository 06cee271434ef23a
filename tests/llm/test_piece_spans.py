"""op13: the byte spans of a text, all at once, are those found character by character, and the query gives them."""

import hashlib

import numpy as np

from siltstone.llm import sentence_pieces as sp

TEXTS = ["", " ", "plain words here", "  two  spaces \n\ttabs", "日本語 and ünïcödé ▁ \U0001f600\U0001f9ea\U0001f9eb x", "\x00\x01á  ", "word" * 100]


def test_spans_at_once():
    e = sp.Encoder(sp.load_model(sp.public_model()))
    assert e.plain
    for text, ids in zip(TEXTS, e.encode(TEXTS), strict=True):
        assert [tuple(x) for x in e.plain_spans(text, ids).tolist()] == e.spans(text, ids), text


def test_spans_of_the_query(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    e = sp.Encoder(sp.load_model(sp.public_model()))
    want = {k: hashlib.sha256(np.array(e.spans(t, e.encode([t])[0]), "<u8").tobytes()).hexdigest() for k, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["spans_sha256"] for r in sp.op13_sentencepiece(spark, str(tmp_path)).collect()} == want
