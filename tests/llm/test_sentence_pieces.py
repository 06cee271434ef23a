"""SentencePiece encoding against the library: ids, decoding, byte spans, and the walk through compiled character maps."""

import hashlib
import random

import pytest
import sentencepiece

from siltstone.llm import sentence_pieces as sp

TEXTS = [
    None, "", " ", "   ", "\n\n  \t", "Hello world", " Hello  world ", "aaaaaaaaaaaaaaaaaaaa", "a" * 3000, "ab" * 700, "naïve café 東京タワー １２３ ①",
    "▁", "a▁b", "a▁ b", " ▁ ▁", "</s><s><unk> <0x0A>", "\x00\x01 \x7f", "\U0001f600\U0001f603 é �", "x" * 129 + " " * 200 + "y", "1234567890" * 60, "tabs\tand　wide spaces",
]


def many(n=200):
    rng = random.Random(5)
    letters = "etaoin shrdlu\n\t.,;:!?'\"0123456789éüñßÀ東京абв\U0001f600▁" + " " * 12
    return ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.public_model())


@pytest.fixture(scope="module")
def model():
    return sp.load_model(sp.public_model())


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_against_library(spark, library, model):
    texts = TEXTS + many()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:4] for r in sp.encode_texts(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == expected(library, t), repr(t)


def test_decode_any_ids(library, model):
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 3, *range(3, 259), *range(259, 32000)]) if rng.random() < 0.5 else rng.randint(3, 258) for _ in range(rng.randint(0, 12))]
        ids = [i for i in ids if i > 2]
        assert sp.decode(model, ids).decode() == library.decode(ids), ids


def test_spans_are_the_library_s(library, model):
    encoder = sp.Encoder(model)
    for text in [t or "" for t in TEXTS] + many(80):
        ids = encoder.encode([text])[0]
        spans = encoder.spans(text, ids)
        proto = library.encode(text, return_type="proto")
        assert [p.id for p in proto.pieces] == ids[:-1]
        assert [(p.begin, p.end) for p in proto.pieces] == spans[:-1], repr(text)
        whole = text.encode()
        assert b"".join(whole[a:b] for a, b in spans) == whole


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("remove", [True, False])
def test_compiled_character_map(model, rule, remove):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=remove)
    spec = sp.fields(sp.fields(library.serialized_model_proto())[sp.NORMALIZER][0])
    mapped = sp.Model(**{**vars(model), "charmap": sp.CharMap.of(spec[sp.CHARSMAP][0]), "remove_spaces": remove})
    wide = [
        "Ｈｅｌｌｏ  Ｗ", "éà", "ﬁne ① ㎏", "  　 a\t b  ", "¨", "각", "İIß", "a­​b", "ガ゛ ｶﾞ"
    ]
    for text in wide + [t or "" for t in TEXTS if not t or "\x00" not in t] + many(40):
        norm, origin = sp.normalised(mapped, text)
        assert norm == library.normalize(text), repr(text)
        assert len(origin) == len(norm) + 1 and origin == sorted(origin) and (not norm or origin[-1] <= len(text.encode()))


def test_piece_that_crosses_words_and_user_pieces(model):
    """A map of one's own: user pieces stay whole, characters known inside pieces only become bytes."""
    crossing = sp.Model(**{**vars(model), "whole_texts": True})
    encoder, plain = sp.Encoder(crossing), sp.Encoder(model)
    for text in many(20):
        assert encoder.encode([text]) == plain.encode([text])
    user = sp.Model(**{**vars(model), "user": ["<mark>"], "symbols": model.symbols | {"<mark>": 7}})
    ids = sp.Encoder(user).encode(["a <mark>b"])[0]
    assert 7 in ids


def test_cache_is_bounded(monkeypatch, library, model):
    monkeypatch.setattr(sp, "CACHE_CHUNKS", 20)
    encoder = sp.Encoder(model)
    for k in range(6):
        text = " ".join(f"word{k}{j}" for j in range(15))
        assert encoder.encode([text, ""]) == [library.encode(text, add_eos=True), [2]]
        assert len(encoder.place) <= 20


def test_edges(spark, model):
    docs = spark.createDataFrame([(None, "ab ab", 3), (None, None, 1), (4, "x", 1), (4, "x", 2), (4, "y", 9)], "doc_id long, text string, ids int")
    got = sp.encode_texts(docs, model, detail=True)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.where("doc_id = 4").collect()) == [(4, 2)] * 3
    assert sorted(r["n_tokens"] for r in got.where("doc_id IS NULL").collect())[0] == 1
    assert sp.encode_texts(docs.limit(0), model).count() == 0
    row = sp.encode_texts(docs.where("ids = 3").withColumnRenamed("ids", "lang"), model, carry=("lang",), detail=True).collect()[0]
    assert row["lang"] == 3 and row["starts"][0] == 0 and row["ends"][-2] == 5 and sp.decode(model, row["ids"]) == b"ab ab"
