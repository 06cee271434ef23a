"""Suffix arrays and suffix-tree nodes of the texts that meet in one task.

A shard is a few thousand contexts laid one behind another with separators.
Byte shards are sorted by induced sorting: suffixes are classified as smaller or
larger than their right neighbour, the substrings between leftmost-smaller
positions are sorted by a first induction and named, the string of names (a
third as long) is ranked by doubling, and a second induction turns the order of
the leftmost-smaller suffixes into that of all.  Both inductions go bucket by
bucket with whole arrays, in linear time.  Word shards have too many symbols for
buckets and are ranked by doubling alone.

Orders are right for the first ``depth`` symbols, which is all that windows of
that length need.
"""

from __future__ import annotations

import numpy as np

from .anchors import prefix_hash, range_hash

SENTINEL, SEPARATOR, FIRST = 0, 1, 2


def smaller_than_right(s: np.ndarray) -> np.ndarray:
    """Type of each suffix of s (whose last symbol is the sentinel): True if it is smaller than the suffix to its right."""
    step = np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16))
    known = np.flatnonzero(step)
    out = np.ones(len(s), bool)
    out[:-1] = step[known[np.searchsorted(known, np.arange(len(s) - 1))]] > 0
    return out


def _deal(parts: list[list[np.ndarray]], where: np.ndarray, symbol: np.ndarray) -> None:
    """Appends positions to the bucket of their symbol, in order."""
    if not len(where):
        return
    order = np.argsort(symbol, kind="stable")
    where, symbol = where[order], symbol[order]
    cuts = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [len(symbol)])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        parts[symbol[a]].append(where[a:b])


def _drain(parts: list[list[np.ndarray]], bucket: int, s: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Takes what has been dealt to a bucket and deals out its left neighbours of the wanted type; neighbours in the bucket itself follow at once."""
    done = []
    front = np.concatenate(parts[bucket]) if parts[bucket] else np.zeros(0, np.int32)
    while len(front):
        done.append(front)
        left = front[front > 0] - 1
        left = left[wanted[left]]
        symbol = s[left]
        here = symbol == bucket
        _deal(parts, left[~here], symbol[~here])
        front = left[here]
    return np.concatenate(done) if done else np.zeros(0, np.int32)


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """Order of all suffixes from an order of the leftmost-smaller ones: larger suffixes left to right, then smaller ones right to left."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _deal(seeds, leftmost, s[leftmost])
    large = ~small
    parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    larger = []
    for c in range(symbols):
        larger.append(_drain(parts, c, s, large))
        for part in seeds[c]:
            left = part[part > 0] - 1
            left = left[large[left]]
            _deal(parts, left, s[left])
    parts = [[] for _ in range(symbols)]
    smaller: list[np.ndarray] = [np.zeros(0, np.int32)] * symbols
    for c in range(symbols - 1, -1, -1):
        smaller[c] = _drain(parts, c, s, small)[::-1]
        left = larger[c][::-1]
        left = left[left > 0] - 1
        left = left[small[left]]
        _deal(parts, left, s[left])
    smaller[SENTINEL] = np.array([len(s) - 1], np.int32)
    return np.concatenate([x for c in range(symbols) for x in (larger[c], smaller[c])])


def doubled_ranks(rank: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a string of ranks, by their first ``depth`` symbols or more."""
    n, span = len(rank), 1
    rank = rank.astype(np.int64)
    while span < depth and n and int(rank.max()) < n - 1:
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key)
        k = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        rank, span = fresh, 2 * span
    return rank


def induced_suffix_array(s: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Suffix array of s (last symbol the sentinel 0, which occurs nowhere else)."""
    small = smaller_than_right(s)
    leftmost = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(leftmost) < 2:
        return induce(s, small, leftmost, symbols)
    first = induce(s, small, leftmost, symbols)  # sorts the substrings between leftmost-smaller positions
    is_leftmost = np.zeros(len(s), bool)
    is_leftmost[leftmost] = True
    order = first[is_leftmost[first]]
    place = np.searchsorted(leftmost, order)
    end = np.append(leftmost[1:] + 1, len(s))[place]  # a substring takes in the next leftmost-smaller symbol
    content = range_hash(prefix_hash(s.astype(np.uint64) + np.uint64(1)), order, end)
    differs = (content[1:] != content[:-1]) | ((end - order)[1:] != (end - order)[:-1])
    name = np.empty(len(leftmost), np.int64)
    name[place] = np.cumsum(np.concatenate(([0], differs)))
    rank = doubled_ranks(name, depth // 2 + 1)  # such a substring moves on by two symbols at least
    return induce(s, small, leftmost[np.argsort(rank)], symbols)


def _laid_out(codes: np.ndarray, offsets: np.ndarray, shift: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind another, a separator behind each and the sentinel at the end; and where each starts."""
    sizes = np.diff(offsets)
    starts = offsets[:-1] - offsets[0] + np.arange(len(sizes))
    out = np.full(int(offsets[-1] - offsets[0]) + len(sizes) + 1, SEPARATOR, kind)
    at = np.arange(int(offsets[-1] - offsets[0])) + np.repeat(np.arange(len(sizes)), sizes)
    out[at] = codes[offsets[0] : offsets[-1]].astype(kind) + kind(shift)
    out[-1] = SENTINEL
    return out, starts


def _eights(s: np.ndarray) -> np.ndarray:
    """At each place the next eight byte symbols as one number."""
    b = np.concatenate((s.astype(np.uint64), np.zeros(8, np.uint64)))
    out = np.zeros(len(s), np.uint64)
    for k in range(8):
        out |= (b[k : k + len(s)] - np.uint64(FIRST) & np.uint64(255)) << np.uint64(8 * k)
    return out


def _classes(order: np.ndarray, equal: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the runs of equal neighbours in order."""
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ~equal)))
    return out


def _window_starts(offsets: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(starts, n)


def byte_window_classes(codes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of each text, equal for equal windows: runs of the suffix array whose common prefixes reach ``window``.

    ``offsets`` are those of the texts in ``codes``; windows are listed text by text.
    """
    s, starts = _laid_out(codes, offsets, FIRST, np.int16)
    where = _window_starts(offsets, starts, window)
    if len(where) < 2:
        return np.zeros(len(where), np.int64)
    array = induced_suffix_array(s, 256 + FIRST, window)
    number = np.full(len(s), -1, np.int64)
    number[where] = np.arange(len(where))
    array = array[number[array] >= 0]  # windows inside their text; equal ones stay neighbours
    # Permuted common prefixes, as far as "window or more": eight bytes at a time, dropping pairs that differ.
    phi, at = array[:-1].astype(np.int64), array[1:].astype(np.int64)
    eights, equal = _eights(s), np.ones(len(at), bool)
    live = np.arange(len(at))
    for k in [*range(0, window - 7, 8), window - 8]:
        same = eights[phi[live] + k] == eights[at[live] + k]
        equal[live[~same]] = False
        live = live[same]
    return _classes(number[array], equal, len(where))


def word_window_classes(codes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """The same for words: the nodes of depth ``window`` of the suffix tree, as runs of the sorted suffixes."""
    _, ranks = np.unique(codes[offsets[0] : offsets[-1]], return_inverse=True)
    s, starts = _laid_out(ranks, np.asarray(offsets) - offsets[0], FIRST, np.int64)
    where = _window_starts(offsets, starts, window)
    if len(where) < 2:
        return np.zeros(len(where), np.int64)
    rank = doubled_ranks(s, window)[where]
    order = np.argsort(rank)
    at = where[order]
    equal, live = np.ones(len(at) - 1, bool), np.arange(len(at) - 1)
    for k in range(window):
        same = s[at[live] + k] == s[at[live + 1] + k]
        equal[live[~same]] = False
        live = live[same]
    return _classes(order, equal, len(where))
