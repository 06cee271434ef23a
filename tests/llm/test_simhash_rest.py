"""Links between the branches of a tree of near pairs."""

import random

import numpy as np
import pyarrow as pa

from siltstone.llm import simhash


def by_all_pairs(texts, shingle=5, similarity=0.8, distance=46):
    """Component of each text over all similar pairs that share a cell."""
    hashes = [np.array(simhash.shingle_hashes(t.encode(), shingle), np.uint64) for t in texts]
    words = simhash.wide_words(np.concatenate(hashes), np.array([len(h) for h in hashes]))
    x, sets, label, cells = np.stack(words, axis=1), [set(h.tolist()) for h in hashes], list(range(len(texts))), {}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *(pa.array(w.view(np.int64)) for w in words)], names=["node", *simhash.WORDS])
    for out in simhash.cell_dealer(simhash.cell_masks(*simhash.cell_rounds(len(texts))))(iter([batch])):
        for c, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            cells.setdefault(c, []).append(n)
    for i, j in {(i, j) for of in cells.values() for i in of for j in of if i < j}:
        both = len(sets[i] & sets[j])
        if label[i] != label[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both) and simhash.wide_distance(x[i][None], x[j])[0] <= distance:
            low, high = sorted((label[i], label[j]))
            label = [low if k == high else k for k in label]
    return label


def repeated_texts():
    """Texts of one phrase that fills most of their fingerprints, and a part of their own that decides their similarity."""
    rng, texts = random.Random(5), []
    for group in range(6):
        own = [f"g{group}w{k}" for k in range(80)]
        for copy in range(4):
            texts.append(" ".join([f"p{k}" for k in range(21)] * 60 + own[:79] + [f"c{copy}"]))
    rng.shuffle(texts)
    return texts


def test_links_cut_from_the_forest_are_found(spark):
    texts = repeated_texts()
    want = by_all_pairs(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.link_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 6


def test_pairs_of_two_labels(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(0, 2**63, (3, 4), np.uint64), 5, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (15, 4)).astype(np.uint64))
    label = rng.integers(0, 3, 15)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(15, np.int64)), pa.array(np.arange(15)), *(pa.array(x[:, k].view(np.int64)) for k in range(4)), pa.array(label)], names=["cell", "node", *simhash.WORDS, "label"])
    got = sorted((r["a"], r["b"]) for t in simhash.wide_rest(8)(iter([batch])) for r in t.to_pylist())
    want = sorted((i, j) for i in range(15) for j in range(i + 1, 15) if label[i] != label[j] and simhash.wide_distance(x[i][None], x[j])[0] <= 8)
    assert got == want and want


def test_plans_do_not_hold_the_steps_before_them(spark):
    linked = simhash.link_similar(spark.createDataFrame(list(enumerate(repeated_texts())), "doc_id long, text string"))
    plan = linked._jdf.queryExecution().executedPlan().toString()
    print("plan", len(plan), plan.count("InMemoryTableScan"))
    assert plan.count("InMemoryTableScan") < 8


def in_blocks(x, label, sets, sides, masks, distance=8, similarity=0.8):
    """What block_forest makes of one tree, each two sides being one key."""
    rows = [(a * 9 + b, sides[k], k) for a in set(sides) for b in set(sides) if a <= b for k in range(len(x)) if sides[k] in (a, b)]
    rows.sort()
    at = [k for _, _, k in rows]
    arrays = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(at), *(pa.array(x[at, k].view(np.int64)) for k in range(4))]
    batch = pa.RecordBatch.from_arrays([*arrays, pa.array(label[at]), pa.array([sets[k] for k in at], pa.list_(pa.int64()))], names=["key", "side", "node", *simhash.WORDS, "label", "shingles"])
    return [(r["a"], r["b"]) for t in simhash.block_forest(distance, similarity, masks)(iter([batch.slice(0, 7), batch.slice(7)])) for r in t.to_pylist()]


def joined(n, label, pairs):
    out = label.tolist()
    for i, j in pairs:
        out = [min(out[i], out[j]) if v in (out[i], out[j]) else v for v in out]
    return out


def test_labels_of_similar_pairs_are_joined_by_a_forest():
    rng = np.random.default_rng(3)
    n, masks = 60, simhash.cell_masks(8, 2)
    x = np.repeat(rng.integers(0, 2**63, (3, 4), np.uint64), n // 3, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (n, 4)).astype(np.uint64))
    label = np.arange(n) // 20 * 20 + rng.integers(0, 18, n)
    sets = [sorted({int(v) for v in 100 * (k // 20) + rng.integers(0, 14, 10)}) for k in range(n)]
    sets[7] = []
    counts = x - ((x >> np.uint64(1)) & np.uint64(simhash.PAIRS_OF_BITS))
    pairs = []
    for i in range(n):
        for j in range(i + 1, n):
            both = len(set(sets[i]) & set(sets[j]))
            shares = any(all((int(c) ^ int(d)) & m == 0 for c, d, m in zip(counts[i], counts[j], mask)) for mask in masks)
            if shares and simhash.wide_distance(x[i][None], x[j])[0] <= 8 and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                pairs.append((i, j))
    want = joined(n, label, pairs)
    assert len(set(label.tolist())) > len(set(want)) > 3
    for sides in ([0] * n, rng.integers(0, 3, n).tolist()):
        edges = in_blocks(x, label, sets, sides, masks)
        assert joined(n, label, edges) == want and set((min(e), max(e)) for e in edges) <= set(pairs)
    assert len(in_blocks(x, label, sets, [0] * n, masks)) == len(set(label.tolist())) - len(set(want))


def test_large_trees_of_near_pairs_make_no_product(spark):
    """Texts of one phrase and 200 parts of their own: all near, few similar; tasks make fewer rows than there are texts."""
    rng = random.Random(8)
    phrase = " ".join([f"p{k}" for k in range(21)] * 60)
    texts = [" ".join([phrase, *[f"g{rng.randrange(30)}w{k}" for k in range(60)]]) for _ in range(200)]
    texts += [t + " end" for t in texts[:5]]
    made = []
    old = simhash.rest_edges
    try:
        simhash.rest_edges = lambda *a: made.append(old(*a)) or made[-1]
        got = {r["doc_id"]: r["component_id"] for r in simhash.link_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        simhash.rest_edges = old
    assert [got[i] for i in range(len(texts))] == by_all_pairs(texts)
    assert made and made[0].count() < len(texts)


def test_blocks_of_a_large_tree_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 1 << 10)
    test_links_cut_from_the_forest_are_found(spark)
