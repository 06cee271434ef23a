"""Operator 9, SimHash near-dedup: segment-popcount embedding and a grid join.

A fingerprint's 64 bits form 32 segments of two; the embedding counts the set
bits of each.  The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints.  The segments are dealt into GROUPS
groups; two fingerprints at distance ``bits`` or less differ in at most ``bits``
groups, so their embeddings agree exactly in at least GROUPS - bits of them:
they share a grid cell for one choice of that many groups.  Inside a cell the
Manhattan bound comes first, then the exact distance.

Only distinct fingerprints are compared.  A cell emits the edges of a spanning
forest, never all pairs: a search from each unvisited fingerprint takes all its
neighbours out of the cell at once.  Components then run over those edges.  GROUPS
follows from the number of fingerprints, so that the fullest cell of independent
ones stays within CELL_ROWS (:func:`groups_for`); the links are the same for any.

:func:`link_similar` is the same at a wider reach, for a similarity of shingle
sets: fingerprints of 256 bits, cells of the popcounts of a few segments each, the
distance within a cell, then the exact similarity of the pairs found: first of the
edges of a forest, then of all near pairs between the parts into which that leaves
a tree.  The latter meet in pairs of blocks of such a tree, with their shingles,
and leave a task as a forest of the parts, never as pairs.  Copies with
``distance`` bits between them share a cell with a probability that
:func:`cell_rounds` sets; pairs within 128 / segments - 1 bits always do.

Edge cases: null and empty texts have fingerprint zero, linked like any other;
a null id is never a component's name unless all its ids are null (in
:func:`link_similar` rows without an id have no links and stay); repeated rows get
one result each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import keep, materialise, only, rows_named, spread_join, text_or_empty
from .components import components
from .repeats import _by_key, text_buffers

SEED = 42
#: For each byte value, its bits as eight byte-wide counters.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
#: Rows that a byte-wide counter can add.
COUNTER_ROWS = 255
SEGMENTS = 32
PAIRS_OF_BITS = 0x5555555555555555
#: Rows that the fullest cell may hold if fingerprints are independent.
CELL_ROWS = 1 << 14
#: 64-bit words of a wide fingerprint.
WORDS = ["w0", "w1", "w2", "w3"]
#: Pairs of different labels that a task holds before it hands them on.
REST_PAIRS = 1 << 16
#: Shingles that a task of :func:`block_forest` holds, those of two blocks.
BLOCK_SHINGLES = 1 << 22
#: Largest number of rows of a cell whose distances are taken all at once.
AT_ONCE = 512


def shingle_hashes(text: bytes, size: int, lower: bool = True) -> list[int]:
    """Unsigned XXH64 of each ``size``-word shingle, repeats included; one of the whole sequence if it is shorter."""
    words = (text.lower() if lower else text).split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents with counts[d] hashes each: a bit is set if it is set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    blocks = -(-n // COUNTER_ROWS)  # each document in blocks that byte-wide counters can add
    owner = np.repeat(np.arange(len(full)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    block_start = first[owner] + nth * COUNTER_ROWS
    by_doc = np.cumsum(blocks) - blocks
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], block_start)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), by_doc, axis=0)
        out[full] |= np.packbits(2 * bits > n[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprinter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            whole, hashes, counts = memoryview(data), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                h = shingle_hashes(bytes(whole[a:b]), size)
                hashes.append(np.array(h, np.uint64))
                counts.append(len(h))
            prints = majority(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint as a signed long; one narrow pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(fingerprinter(shingle), "doc_id long, print long")


def group_masks(groups: int) -> list[int]:
    """The segments dealt into ``groups`` runs of bits, as even as they go."""
    cuts = [2 * (SEGMENTS * g // groups) for g in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(distance: int):
    """Cells of fingerprints -> edges that connect those within ``distance`` bits of each other."""

    def of_cell(x: np.ndarray) -> list[tuple[int, int]]:
        counts = x - ((x >> np.uint64(1)) & np.uint64(PAIRS_OF_BITS))  # two-bit popcounts
        left, edges = np.arange(len(x)), []
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = manhattan(counts[left], counts[i]) <= distance  # a lower bound of the distance
                near[near] = np.bitwise_count(x[left[near]] ^ x[i]) <= distance
                found = left[near]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = left[~near]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["cell", "print"]):
            cell, x = t.column(0).to_numpy(), t.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            a, b = [], []
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                mine = np.unique(x[cuts[k] : cuts[k + 1]])
                for i, j in of_cell(mine.view(np.uint64)):
                    a.append(int(mine[i]))
                    b.append(int(mine[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def manhattan(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings packed in two-bit fields (each 0, 1 or 2)."""
    ones, twos = np.uint64(PAIRS_OF_BITS), np.uint64(PAIRS_OF_BITS << 1)
    # |a - b| of fields 0..2: 0 if equal, 2 for {0, 2}, else 1.
    differ = many ^ one
    any_bit = (differ | (differ >> np.uint64(1))) & ones
    two = (differ & twos) >> np.uint64(1) & ~((many | one) & ones) & ones
    return np.bitwise_count(any_bit) + np.bitwise_count(two)


def near_edges(prints: DataFrame, distance: int, groups: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links."""
    x = F.col("print")
    low, high = x.bitwiseAND(F.lit(PAIRS_OF_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(PAIRS_OF_BITS))
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # two-bit sums without overflow
    masks = group_masks(groups)
    chosen = [sum(masks[g] for g in c) for c in combinations(range(groups), groups - distance)]
    cells = F.array(*[F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(chosen)])
    dealt = prints.select(F.explode(cells).alias("cell"), "print")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(forest(distance), "a long, b long")


def groups_for(prints: int, distance: int) -> int:
    """Least number of groups for which the fullest cell (one set bit in each segment, half of all) keeps to CELL_ROWS."""
    groups = distance + 2
    while prints * 2.0 ** -(SEGMENTS * (groups - distance) / groups) > CELL_ROWS and groups < SEGMENTS:
        groups += 1
    return groups


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, groups: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id (least doc_id reachable), group_size of every row; ``groups`` by the number of fingerprints if not given."""
    rows = keep(fingerprints(docs, id_col, text_col, shingle))
    classes = keep(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    groups = groups or groups_for(classes.count(), distance)
    labels = components(near_edges(classes.select("print"), distance, groups))
    named = classes.join(labels, classes["print"] == labels["node"], "left").select("print", "least", "n", F.coalesce("label", "print").alias("label"))
    named = keep(named)
    names = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    of_print = spread_join(named.select("print", "label"), names, ["label"], "inner").select("print", "component_id", "group_size")
    return spread_join(rows, of_print, ["print"], "inner").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "group_size"
    )


def wide_words(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of 256 bits: the majority of the hashes, and of three scrambles of them."""
    return [majority(mix(hashes + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) if k else hashes, counts) for k in range(len(WORDS))]


def _hash_sets(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    data, offsets = text_buffers(batch.column(1))
    whole = memoryview(data)
    hashes = [np.array(shingle_hashes(bytes(whole[a:b]), size), np.uint64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return hashes, np.array([len(h) for h in hashes], np.int64)


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.unique(hashes).tobytes(), SEED) - (1 << 63)


def wide_fingerprinter(size: int):
    """(doc_id, text) -> doc_id, digest of the set of shingles, wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = _hash_sets(batch, size)
            words = wide_words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)
            digests = pa.array([set_digest(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, *(pa.array(w.view(np.int64)) for w in words)], names=["doc_id", "digest", *WORDS])

    return run


def shingle_sets(size: int):
    """(doc_id, text) -> doc_id, digest, the set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, _ = _hash_sets(batch, size)
            sets = pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(h) for h in hashes], pa.int64()), sets], names=["doc_id", "digest", "shingles"])

    return run


def cell_rounds(prints: int, bit: float = 0.15, miss: float = 0.05) -> tuple[int, int]:
    """(segments of a cell, rounds of cells) for so many fingerprints: cells of independent ones keep to CELL_ROWS, and a pair
    whose bits differ with probability ``bit`` shares none with probability ``miss`` at most."""
    segments = 8
    while prints * 2.0**-segments > CELL_ROWS and segments < 32:
        segments += 2
    agree = ((1 - bit) ** 2 + bit**2 / 2) ** segments  # both bits equal, or exchanged
    cells = int(np.ceil(np.log(miss) / np.log1p(-agree)))
    return segments, -(-cells // (len(WORDS) * SEGMENTS // segments))


def cell_masks(segments: int, rounds: int) -> list[list[int]]:
    """For each cell its segments as masks of the words; a round deals all segments once, in another order each time."""
    total, out = len(WORDS) * SEGMENTS, []
    for r in range(rounds):
        order = [(i * (2 * (37 * r + 5) + 1) + 11 * r) % total for i in range(total)]
        for k in range(0, total - segments + 1, segments):
            masks = [0] * len(WORDS)
            for s in order[k : k + segments]:
                masks[s // SEGMENTS] |= 3 << (2 * (s % SEGMENTS))
            out.append(masks)
    return out


def wide_distance(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1, dtype=np.int64)


def wide_forest(distance: int):
    """Cells of wide fingerprints -> edges that connect those within ``distance`` bits of each other, as a star where one is in reach of all."""

    def embed(x: np.ndarray) -> np.ndarray:
        return x - ((x >> np.uint64(1)) & np.uint64(PAIRS_OF_BITS))

    def of_cell(x: np.ndarray) -> list[tuple[int, int]]:
        if len(x) <= AT_ONCE:
            near = wide_distance(x[:, None], x[None]) <= distance
            np.fill_diagonal(near, False)
            left = np.flatnonzero(near.any(axis=1))
        else:
            near, left = None, np.arange(len(x))
        counts, edges = embed(x) if near is None else None, []
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                if near is not None:
                    hit = near[i, left]
                else:
                    hit = manhattan(counts[left], counts[i]).sum(axis=1, dtype=np.int64) <= distance  # a lower bound of the distance
                    hit[hit] = wide_distance(x[left[hit]], x[i]) <= distance
                found = left[hit]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = left[~hit]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["cell", "node", *WORDS]):
            cell, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            x = np.stack([t.column(2 + k).to_numpy().view(np.uint64) for k in range(len(WORDS))], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            a, b = [], []
            for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
                mine = node[cuts[k] : cuts[k + 1]]
                for i, j in of_cell(x[cuts[k] : cuts[k + 1]]):
                    a.append(int(mine[i]))
                    b.append(int(mine[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def cell_dealer(masks: list[list[int]]):
    """(node, w0..w3) -> a row for each cell of each node: cell, node, w0..w3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(1 + k).to_numpy().view(np.uint64) for k in range(len(WORDS))]
            counts = [w - ((w >> np.uint64(1)) & np.uint64(PAIRS_OF_BITS)) for w in words]
            for k, mask in enumerate(masks):
                cell = np.full(batch.num_rows, k, np.uint64)
                for c, m in zip(counts, mask, strict=True):
                    cell = mix((cell ^ (c & np.uint64(m))) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), *(batch.column(c) for c in range(1 + len(WORDS)))], names=["cell", "node", *WORDS])

    return run


def wide_rest(distance: int):
    """Cells of wide fingerprints with labels -> all pairs within ``distance`` bits whose labels differ, in parts.

    The plain form that tests hold :func:`block_forest` against: its pairs are the product of large parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["cell", "node", *WORDS, "label"]):
            cell, node, label = (t.column(k).to_numpy() for k in (0, 1, 2 + len(WORDS)))
            x = np.stack([t.column(2 + k).to_numpy().view(np.uint64) for k in range(len(WORDS))], axis=1)
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            a, b, held = [], [], 0
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                names, size = np.unique(label[lo:hi], return_counts=True)
                if len(names) == 1:
                    continue
                most = names[size.argmax()]  # its members are met by those of the other labels
                for i in (lo + np.flatnonzero(label[lo:hi] != most)).tolist():
                    other = (label[lo:hi] == most) | ((label[lo:hi] != label[i]) & (node[lo:hi] > node[i]))
                    found = lo + np.flatnonzero(other)
                    found = found[wide_distance(x[found], x[i]) <= distance]
                    if len(found):
                        a.append(np.minimum(node[found], node[i]))
                        b.append(np.maximum(node[found], node[i]))
                        held += len(found)
                    if held > REST_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                        a, b, held = [], [], 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def block_forest(distance: int, similarity: float, masks: list[list[int]]):
    """Pairs of blocks of nodes with labels and shingles -> edges that join the labels.

    A pair of nodes of two labels is an edge if it lies within ``distance`` bits, shares a
    cell and reaches ``similarity``; once it joins two labels, their other pairs are left out.
    """
    masks = np.array(masks, np.uint64)

    def of_blocks(x: np.ndarray, side: np.ndarray, label: np.ndarray, sizes: np.ndarray, shingles: np.ndarray) -> list[tuple[int, int]]:
        names, first = np.unique(label, return_inverse=True)
        if len(names) == 1:
            return []
        counts, starts = x - ((x >> np.uint64(1)) & np.uint64(PAIRS_OF_BITS)), np.cumsum(sizes) - sizes
        words, word = np.unique(shingles, return_inverse=True)
        mark, root, edges = np.zeros(len(words), bool), first.copy(), []
        most, two, rank = np.bincount(first).argmax(), side.min() != side.max(), np.arange(len(x))
        for i in np.flatnonzero(first != most).tolist():  # members of the most frequent label are met by those of the others
            other = (root != root[i]) & ((first == most) | (rank > i))
            if two:
                other &= side != side[i]
            found = np.flatnonzero(other)
            found = found[np.minimum(sizes[found], sizes[i]) >= similarity * np.maximum(sizes[found], sizes[i])]
            found = found[wide_distance(x[found], x[i]) <= distance]
            if not len(found):
                continue
            n = sizes[found]
            ends = np.cumsum(n)
            mine = word[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            sums = np.concatenate(([0], np.cumsum(mark[word[np.repeat(starts[found] - (ends - n), n) + np.arange(n.sum())]])))
            mark[mine] = False
            both = sums[ends] - sums[ends - n]
            found = found[both >= similarity * (n + sizes[i] - both)]
            found = found[(((counts[found] ^ counts[i])[:, None] & masks) == 0).all(axis=2).any(axis=1)]
            joined, at = np.unique(root[found], return_index=True)
            edges += [(i, int(j)) for j in found[at]]
            if len(joined):
                root[np.isin(root, joined)] = root[i]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, ["key", "side", "node", *WORDS, "label", "shingles"]):
            key, side, node, label = (t.column(k).to_numpy() for k in (0, 1, 2, 3 + len(WORDS)))
            x = np.stack([t.column(3 + k).to_numpy().view(np.uint64) for k in range(len(WORDS))], axis=1)
            sets = t.column(4 + len(WORDS)).combine_chunks()
            sizes, shingles = pc.list_value_length(sets).to_numpy().astype(np.int64), sets.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(sizes)))
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            a, b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for i, j in of_blocks(x[lo:hi], side[lo:hi], label[lo:hi], sizes[lo:hi], shingles[starts[lo] : starts[hi]]):
                    a.append(int(node[lo + i]))
                    b.append(int(node[lo + j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def rest_edges(nodes: DataFrame, distance: int, similarity: float, segments: int, rounds: int) -> DataFrame:
    """Edges (a, b) that join the labels of nodes (node, w0..w3, label, tree, shingles), for the linked pairs of two labels in a tree.

    A tree's nodes are dealt into blocks of half of BLOCK_SHINGLES; each two blocks meet in a task, so a large tree is many tasks.
    """
    blocks = nodes.groupBy("tree").agg(F.ceil(2 * F.sum(F.size("shingles")) / BLOCK_SHINGLES).alias("n"))
    dealt = spread_join(nodes, blocks, ["tree"], "inner").withColumn("side", F.pmod(F.xxhash64("node"), F.greatest("n", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)))
    dealt = dealt.select(F.xxhash64("tree", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "side", "node", *WORDS, "label", "shingles")
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(block_forest(distance, similarity, cell_masks(segments, rounds)), "a long, b long")


def similar_edges(nodes: DataFrame, distance: int, segments: int, rounds: int) -> DataFrame:
    """Edges (a, b) between nodes (node, w0..w3) that share a cell and lie within ``distance`` bits."""
    schema = "cell long, node long, " + ", ".join(f"{w} long" for w in WORDS)
    dealt = nodes.select("node", *WORDS).mapInArrow(cell_dealer(cell_masks(segments, rounds)), schema)
    return dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(wide_forest(distance), "a long, b long").distinct()


def link_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 46) -> DataFrame:
    """doc_id, component_id (least doc_id reachable) of every row with an id.

    A link: wide fingerprints within ``distance`` bits, found through a cell, and
    Jaccard similarity of the sets of ``shingle``-word shingles of ``similarity`` or
    more.  Rows with equal sets are one node.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id is not null")
    rows = keep(texts.mapInArrow(wide_fingerprinter(shingle), "doc_id long, digest long, " + ", ".join(f"{w} long" for w in WORDS)))
    nodes = keep(rows.groupBy("digest", *WORDS).agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("digest", *WORDS)))
    cells = cell_rounds(nodes.count())
    # Tables that the later steps name often are written, so that no plan holds the plans of all steps before it.
    found = materialise(similar_edges(nodes, distance, *cells), "near")
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = keep(ends.join(nodes.select("node", "least", "digest"), "node").select("node", F.col("least").alias("doc_id"), "digest"))
    sets = rows_named(texts, wanted.select("doc_id").distinct(), "doc_id").mapInArrow(shingle_sets(shingle), "doc_id long, digest long, shingles array<long>")
    sets = materialise(sets.join(wanted, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        sides = spread_join(pairs, sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), ["a"], "inner")
        sides = spread_join(sides, sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), ["b"], "inner")
        both = F.size(F.array_intersect("sa", "sb"))
        return sides.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    named = materialise(nodes.join(components(similar(found)), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"), *WORDS), "named")
    # A tree of near pairs that the similarity cuts may miss pairs of two of its branches: there all pairs are judged.
    label = named.select("node", "label")
    cut = found.join(label.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "lb"}), "b").where("la <> lb")
    cut = materialise(cut.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "cut")
    if not cut.isEmpty():
        trees = components(cut).select(F.col("node").alias("label"), F.col("label").alias("tree"))
        loose = materialise(spread_join(named, trees, ["label"], "inner").join(sets, "node").select("node", *WORDS, "label", "tree", "shingles"), "loose")
        rest = materialise(rest_edges(loose, distance, similarity, *cells), "rest")
        if not rest.isEmpty():
            merged = rest.join(label.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
            merged = components(merged.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("_to"))
            named = materialise(named.join(merged, "label", "left").select("node", "least", F.coalesce("_to", "label").alias("label")), "merged")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = spread_join(named.select("node", "label"), names, ["label"], "inner").select("node", "component_id")
    return spread_join(rows.select("doc_id", F.xxhash64("digest", *WORDS).alias("node")), of_node, ["node"], "inner").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of each component of :func:`link_similar` stays (the least id), with all its columns; rows without an id stay."""
    linked = link_similar(docs, id_col, text_col, **parameters)
    stay = linked.where("doc_id = component_id").select("doc_id").distinct()
    ids = stay.unionByName(docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id")).limit(1))
    return only(docs, ids, id_col)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
