"""SimHash links and components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash
from siltstone.llm.components import components

SCHEMA = "doc_id long, text string, print string, label int"


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parents(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_link_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ÀB", "The"]
    texts = [None, "", "  ", "One", "one", "a b c", "A b C d", "x " * 700]
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(30, 900))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in simhash.link(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    assert {i: got[i]["fingerprint"] for i in ids} == {i: f"{p:016x}" for i, p in zip(ids, prints, strict=True)}
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = parents(len(ids), links)
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(i, least.get(r, i))
    assert {i: got[i]["component_id"] for i in ids} == {i: least[r] for i, r in zip(ids, root, strict=True)}


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_similar_texts_match_brute_force(spark):
    """Five-word shingles, Jaccard similarity of 0.8 or more; one of each component stays."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", "one two", "One  two", "one two three", "z " * 60_000]
    for k in range(14):
        base = rng.choices(vocab, k=rng.randint(60, 500))
        texts.append(" ".join(base))
        for c in range(rng.randint(0, 5) if k else 40):
            copy = list(base)
            for _ in range(max(1, len(base) // (100 if c % 2 else 25))):  # similarity about 0.9, or 0.7 and less
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([*[(i, t, "clash", 0) for i, t in zip(ids, texts, strict=True)], (None, "one two", "", 1), (ids[9], texts[9], "again", 2)], SCHEMA).repartition(3)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8 or not ((texts[a] or "").split() or (texts[b] or "").split())]
    assert len(links) > 100
    least, root = {}, parents(len(ids), links)
    for i, r in zip(ids, root, strict=True):
        least[r] = min(i, least.get(r, i))
    got = {r["doc_id"]: r["component_id"] for r in simhash.link_similar(docs).collect()}
    assert got == {i: least[r] for i, r in zip(ids, root, strict=True)}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(least.values()) | {None}
    assert simhash.link_similar(docs.limit(0)).count() == 0


def test_large_cells_match_small_ones():
    """The search by rows of a large cell and the one by all distances of a small cell find the same components."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    x = np.repeat(base, 30, axis=0)
    for _ in range(9):
        x[np.arange(len(x)), rng.integers(0, 4, len(x))] ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(x)), pa.array(range(len(x))), *(pa.array(x[:, k].view(np.int64)) for k in range(4))], names=["cell", "node", *simhash.WORDS])
    found = []
    for at_once in (0, 5000):
        simhash.AT_ONCE, before = at_once, simhash.AT_ONCE
        edges = [(r["a"], r["b"]) for t in simhash.wide_forest(12)(iter([batch])) for r in t.to_pylist()]
        simhash.AT_ONCE = before
        found.append(parents(len(x), edges))
    want = parents(len(x), [(a, b) for a in range(len(x)) for b in range(a) if np.bitwise_count(x[a] ^ x[b]).sum() <= 12])
    assert len(set(zip(*found, want, strict=True))) == len(set(want))


def test_cells_by_size():
    assert [simhash.groups_for(n, 4) for n in (0, 10**5, 10**8, 10**10)] == [6, 6, 7, 11]
    assert simhash.cell_rounds(1000) == (8, 3) and simhash.cell_rounds(10**9)[0] == 16
    assert all(sum(m.bit_count() for m in masks) == 16 for masks in simhash.cell_masks(8, 3))


def test_edges_join_all_links(spark):
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    for groups in (5, 7, 8):
        edges = [(r["a"], r["b"]) for r in simhash.near_edges(frame, 4, groups).collect()]
        at = {simhash.signed(p): k for k, p in enumerate(prints)}
        assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 4 for a, b in edges)
        links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
        one, two = parents(len(prints), links), parents(len(prints), [(at[a], at[b]) for a, b in edges])
        assert len(set(zip(one, two, strict=True))) == len(set(one)) == len(set(two))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.uint64(rng.integers(0, 1 << 63))
    fields = lambda v: np.array([[(int(a) >> 2 * s & 3).bit_count() for s in range(32)] for a in np.atleast_1d(v)])
    c = lambda v: v - ((v >> np.uint64(1)) & np.uint64(simhash.PAIRS_OF_BITS))
    expect = np.abs(fields(x) - fields(y)).sum(axis=1)
    assert (simhash.manhattan(c(x), c(y)) == expect).all() and (expect <= np.bitwise_count(x ^ y)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (5000, 5000), (2**62, -5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {k: 1000 for k in range(1000, 1100)} | {5000: 5000, 5001: 5000, 2**62: -5, -5: -5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.link(spark.createDataFrame([(None, "a b c d e", "", 0)] * 2, SCHEMA)).select(F.col("component_id")).collect() == [(None,)] * 2
