"""Repeat removal against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from siltstone.llm.repeats import FOUND, Search, context_settler, remove_repeats
from siltstone.llm.substring_dedup import remove_repeated_words
from siltstone.llm.suffix_array_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, span string, key int"


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["ab", "the", "of", "zürich", "x", "längere", "wörter", "and", "in", "cd", "ef"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(6)]
    texts = [None, "", " ", "a" * 350, "ab" * 150, "a" * 99, "the " * 40, "x\n" * 300]
    for _ in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    texts += rng.sample(texts[8:], 8)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


def brute_bytes(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(b[s : s + length])
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def brute_words(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        mine = [tuple(w[s : s + length]) for s in range(len(w) - length + 1)]
        for s, x in enumerate(mine):
            if x in seen:
                gone[s : s + length] = [True] * length
        seen.update(mine)
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeated_bytes(frame).collect()}
    expect = brute_bytes(docs, 100)
    assert {k: (v, expect[k]) for k, v in got.items() if v != expect[k]} == {} and len(got) == len(expect)


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeated_words(frame).collect()}
    expect = brute_words(docs, 13)
    assert {k: (v, expect[k]) for k, v in got.items() if v != expect[k]} == {} and len(got) == len(expect)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_wide_prefixes(spark, unit):
    docs = corpus(5)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA).repartition(6)
    byte = unit == "byte"
    search = Search(unit, 100 if byte else 13, 24 if byte else 5, other_doc=not byte, group_rows=1)
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(frame, search).collect()}
    expect = brute_bytes(docs, 100) if byte else brute_words(docs, 13)
    assert got == {k: (v[0], v[1], v[-1]) for k, v in expect.items()}


def test_words_are_compared_whole(spark):
    """Words whose codes share their upper halves are still different words."""
    start = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    rows = [(1, start + "id0124046"), (2, start + "id0246255"), (3, start.replace(" ", "\n\t ") + "id0246255"), (4, "x" * 3_000_000 + " " + start + "id0246255")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeated_words(frame).collect()} == {1: (13, 0), 2: (13, 0), 3: (13, 13), 4: (14, 13)}


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_repeated_ids(spark, group_rows):
    """Rows of one id with different texts are documents of their own; the largest id and null stay apart."""
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    shared, top = words(30), (1 << 63) - 1
    rows = [(5, f"{words(9)} {shared}"), (5, f"{words(20)} {shared} {words(4)}"), (5, words(20)), (7, f"{shared} {words(3)}"), (7, f"{words(2)} {shared} {shared}"), (None, f"{shared} x {shared}"), (top, f"y {shared}"), (5, "repeat"), (5, "repeat")]
    rows += [(100 + i, f"{words(2)} {shared} {words(2)}") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_units"]): r["n_removed"] for r in remove_repeats(frame, Search("word", 13, 5, True, group_rows)).collect()}
    want = {(5, 39): 0, (5, 54): 0, (5, 20): 0, (5, 1): 0, (7, 33): 30, (7, 62): 60, (None, 61): 60, (top, 31): 30, (100, 34): 30} | {(100 + i, 34): 30 for i in range(12)}
    assert got == want
    out = remove_repeats(frame, Search("byte", 100, 24, False, group_rows), with_text=True).collect()
    assert len(out) == len(rows)
    kept = {(r["doc_id"], r["n_units"]): r["kept_text"] for r in out}
    for i, t in rows:
        left = kept[i, len(t)]
        assert (shared in left) == (i == 5 and len(t) > 200) and (i == 5 or len(left) < len(t))


def test_hot_seeds_are_dealt(spark):
    """A phrase in every document, with other words around it: what its seeds' own task reads does not grow with the documents."""
    from siltstone.llm.repeats import SEVERAL, anchor_finder

    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} it is what it is j{i} k{i} l{i} m{i} n{i} o{i} p{i}" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([0] * 500), pa.array(texts)], names=["doc", "twin", "text"])
    found = pa.Table.from_batches(anchor_finder(Search("word", 13, 5, True))(iter([batch]))).to_pylist()
    plain = {}
    for r in found:
        if r["size"] >= 0 and not r["size"] & SEVERAL:
            plain.setdefault(r["key"], set()).add(r["context"])
    assert max(map(len, plain.values())) <= 2 and len(found) > 500


@pytest.mark.parametrize("keys", [6, 60])
@pytest.mark.parametrize("other_doc", [True, False])
def test_contexts_stream_over_batches(other_doc, keys):
    rng = random.Random(8)
    rows = sorted({(rng.randint(0, keys), rng.randint(0, 3), 0, rng.randint(0, 5), 0, rng.randint(0, 30)) for _ in range(120)})
    search = Search("byte", 100, 24, other_doc)

    def settle(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        out = context_settler(search)(pa.RecordBatch.from_arrays([pa.array([r[k] for r in p], t) for k, t in enumerate((*[pa.int64()] * 5, pa.int32()))] + [pa.array([100] * len(p), pa.int32())], schema=FOUND) for p in parts)
        found = [r for b in out for r in b.to_pylist()]
        return sorted((r["doc"], r["key"], r["at"]) for r in found if r["size"] >= 0)

    heads = {}
    for k, c, _, d, _, a in rows:
        heads.setdefault((k, c), (d, a))
    contexts = {}
    for k, c in heads:
        contexts.setdefault(k, set()).add(c)
    free = lambda k, c, d, a: d == heads[k, c][0] if other_doc else (d, a) == heads[k, c]
    want = sorted((d, k, a) for k, c, _, d, _, a in rows if len(contexts[k]) > 1 and free(k, c, d, a))
    assert settle(1000) == want and settle(7) == want and settle(3) == want and settle(1) == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_words(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(None, text, "", 0), (7, text, "", 0), (7, text, "", 0)], SCHEMA)
    got = sorted(remove_repeated_words(frame, with_text=True).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["n_removed"], r["kept_text"]) for r in got] == [(None, 60, ""), (7, 0, text), (7, 0, text)]
