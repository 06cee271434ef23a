"""BPE against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from siltstone.llm import bpe

TEXTS = [
    None, "", " ", "\n\n  \t", "Hello world's we'll I'd", "aaaaaaaaaaaaaaaaaaaa", "a" * 3000, "naïve café 東京タワー １２３ ①②", "x<|endoftext|>y <|endoftext|>",
    "\x1c\x1d\x1f a\x85b᠎c​　d", "tabs\tand   spaces   ", "😀😃 é �\x00", "<|endoftext|", "1234567890" * 60, "'S 'RE 'll",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.public_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_against_library(spark, reference):
    rng = random.Random(5)
    letters = "etaoin shrdlu\n\t.,;:!?'\"0123456789éüñßÀ東京абв😀  " + " " * 10
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(150)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=900))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r["doc_id"]: tuple(r)[1:4] for r in bpe.encode_texts(docs, bpe.load_vocabulary(bpe.public_vocabulary())).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(reference, t), repr(t)


def test_cache_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.public_vocabulary()))
    for k in range(6):
        text = " ".join(f"word{k}{j}" for j in range(15))
        ids, offsets = encoder.encode([text, ""])
        assert ids.tolist() == reference.encode(text).ids and offsets.tolist() == [0, len(ids), len(ids)]


def test_carry_ids_and_empty(spark):
    v = bpe.load_vocabulary(bpe.public_vocabulary())
    docs = spark.createDataFrame([(1, "ab ab", "en", 7)], "doc_id long, text string, lang string, n_tokens int")
    row = bpe.encode_texts(docs, v, carry=("lang",), with_ids=True).collect()[0]
    assert row["lang"] == "en" and len(row["ids"]) == row["n_tokens"] == 2 and bpe.decode(v, __import__("numpy").array(row["ids"])) == b"ab ab"
    assert bpe.encode_texts(docs.limit(0), v).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "ab ab"), (None, None), (4, "x"), (4, "x"), (4, "y")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.encode_texts(docs, bpe.load_vocabulary(bpe.public_vocabulary())).collect()), key=str)
    assert got == sorted([(None, 2), (None, 0), (4, 1), (4, 1), (4, 1)], key=str)
