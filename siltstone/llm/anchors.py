"""Content-chosen suffixes ("anchors") of symbol sequences, in numpy.

Two equal windows of ``window`` symbols contain the same seeds (``seed``
symbols), so they agree on the least seed by any fixed order: its start is an
anchor in both.  A corpus is searched for repeated windows through the suffixes
that start at anchors, 2 / (window - seed + 2) of all suffixes, and no repeat is
missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
#: Bases of the two polynomial hashes (5 modulo 8: differences of powers lose few bits).
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

#: For each base its powers and those of its inverse modulo 2^64.
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def _power_tables(n: int, second: bool = False) -> list[np.ndarray]:
    tables = _powers[second]
    if len(tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASES[second], pow(_BASES[second], -1, 1 << 64))):
            table, step, done = np.ones(size, np.uint64), base, 1
            while done < size:  # each round doubles the table
                table[done : 2 * done] = table[:done] * np.uint64(step)
                step, done = step * step & _MASK, 2 * done
            tables[k] = table
    return tables


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(symbols: np.ndarray, second: bool = False) -> np.ndarray:
    """h with h[i] = hash of the first i symbols; any range follows by :func:`range_hash`.  ``second``: by the other base."""
    h = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _power_tables(len(symbols) + 1, second)[0][: len(symbols)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    return mix((h[end] - h[start]) * _power_tables(len(h), second)[1][start])


def seed_hashes(h: np.ndarray, seed: int) -> np.ndarray:
    n = len(h) - seed
    return mix((h[seed:] - h[:n]) * _power_tables(len(h))[1][:n])


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for each full window, by doubling."""
    span, out = 1, x
    while 2 * span <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    return out if span == width else best(out[: len(x) - width + 1], out[width - span : width - span + len(x) - width + 1])


@dataclass
class Anchors:
    """start: of the seed; seed: its hash; left, right: symbols of context on each side; context, check: two hashes of the context."""

    start: np.ndarray
    seed: np.ndarray
    left: np.ndarray
    right: np.ndarray
    context: np.ndarray
    check: np.ndarray
    doc: np.ndarray


def find_anchors(symbols: np.ndarray, offsets: np.ndarray, window: int, seed: int, others: np.ndarray | None = None) -> Anchors:
    """Anchors of the documents symbols[offsets[d]:offsets[d + 1]]; ``others``: the same symbols under other codes, for the second hash."""
    n, width = len(symbols), window - seed + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return Anchors(none, none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    h = prefix_hash(symbols)
    seeds = seed_hashes(h, seed)
    rank = seeds | np.uint64(1)  # never 0, which marks windows that don't count
    least = _sliding(rank, width, np.minimum)  # least[p]: of window p
    lengths = np.diff(offsets)
    for cut in offsets[1:-1]:  # windows that cross the end of a document
        least[max(0, cut - window + 1) : cut] = 0
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    start = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(rank)] == rank)
    doc = np.searchsorted(offsets, start, "right") - 1
    left = np.minimum(start - offsets[doc], width - 1)
    right = np.minimum(offsets[doc] + lengths[doc] - start, window)
    context = range_hash(h, start - left, start + right)
    context = mix(context + left.astype(np.uint64) * np.uint64(1 << 32) + right.astype(np.uint64))
    check = context
    if others is not None:
        check = range_hash(prefix_hash(others, True), start - left, start + right, True)
    return Anchors(start, seeds[start], left, right, context, check, doc)
