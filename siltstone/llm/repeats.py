"""Repeated windows of a corpus: the engine of operators 2 and 3.

A window is removed where an equal one starts earlier.  Suffixes are grouped by prefix (the seed, a few
symbols long); three exchanges, none of which carries a suffix in full:

1. Every task finds the anchors of its texts (:mod:`.anchors`) and settles copies
   it can see itself: of equal (seed, context) only the first leaves the task, the
   others are covered by it.  So a group of copies reaches the exchange once per
   batch, not once per copy.
2. Anchors meet by seed.  Equal contexts: all but the first are covered.  A seed
   with several contexts leaves the first of each context *pending*.  The sorted
   anchors stream by, so a large group costs no memory.  A seed that has more than
   two contexts in one batch is sure to have several, so only two of them go to the
   seed's own task; the others are dealt by context.  So a seed that a third of all
   texts hold is no hot key.
3. Pending anchors (about a tenth) fetch their context from the text and meet by
   seed again.  The contexts that meet are a shard: its suffix array or suffix
   tree (:mod:`.suffix`) gives the windows that are equal, symbol by symbol, and one
   that starts earlier covers the others.  A seed with over ``group_rows`` pending
   contexts is too wide a prefix for one task: its windows are halved by where the
   seed lies in them, and each half has a longer prefix in common, by which it
   meets.  Prefixes are lengthened until their groups fit; the longest is a whole
   window, and such groups are plain aggregates.

Contexts count as equal by two independent 64-bit hashes (and their seed's); pending
contexts by their bytes.  Spans go back to their documents by id.  The text is shuffled
once: both joins read the same exchange (twice if there are wide prefixes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import find_anchors, mix, prefix_hash, range_hash
from .common import marked_join, materialise, spread_join, text_or_empty
from .suffix import byte_window_classes, word_window_classes

#: Symbols handled at once; numpy arrays of this length stay in the CPU's caches.
BATCH = 1 << 20
#: Bytes of context that one Arrow batch carries, about.
BODY_BYTES = 1 << 25
#: Anchors that a batch settles at once, and contexts of a shard, about.
SETTLED_AT_ONCE, SHARD_ROWS = 1 << 18, 1 << 13
#: Pieces that one file of a level holds, about.
PIECES_PER_FILE = 1 << 16
#: Where a null id stands: after all others.
LAST_ID = (1 << 63) - 1
#: In the size of an anchor: its seed has several contexts for sure, it is dealt by context.
SEVERAL = 1 << 16

BYTE_CODES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Search:
    """unit: "byte" or "word".  other_doc: an equal window counts only in a document with a smaller id.  group_rows: contexts that one task may gather by prefix."""

    unit: str
    window: int
    seed: int
    other_doc: bool
    group_rows: int = 4_096


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word of data[offsets[0]:offsets[-1]], and the words' offsets by document."""
    part = data[offsets[0] : offsets[-1]]
    solid = ~IS_SPACE[part]
    first = np.zeros(len(part) + 1, bool)
    cuts = offsets - offsets[0]
    first[cuts] = True
    before = np.concatenate(([False], solid))
    starts = np.flatnonzero(solid & (~before[:-1] | first[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid[1:], [False])) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, cuts)


def symbols_of(search: Search, data: np.ndarray, offsets: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit symbols of the documents, and their offsets; ``second``: other symbols, independent of the first."""
    codes = BYTE_CODES[second][data[offsets[0] : offsets[-1]]]
    if search.unit == "byte":
        return codes, offsets - offsets[0]
    starts, ends, cuts = word_bounds(data, offsets)
    return range_hash(prefix_hash(codes, second), starts, ends, second), cuts


def spelled_out(search: Search, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start of each unit in them with one more at the end, units' offsets by document); words are joined by one space."""
    part = data[offsets[0] : offsets[-1]]
    if search.unit == "byte":
        return part, np.arange(len(part) + 1), offsets - offsets[0]
    starts, ends, cuts = word_bounds(data, offsets)
    sizes = ends - starts
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    out[place] = part[~IS_SPACE[part]]
    return out, np.concatenate(([0], np.cumsum(sizes + 1))), cuts


def in_parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about BATCH bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH, "right")) - 1)
        yield i, j
        i = j


def pack(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << 8 | right).astype(np.int32)


FOUND = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
FOUND_SQL = "key long, context long, check long, doc long, twin long, at int, size int"


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=schema)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _heads(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last row marked new."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _covered(search: Search, new: np.ndarray, doc, twin, at) -> np.ndarray:
    """Rows sorted by (group, doc, twin, at), ``new`` where a group starts: which have an earlier one in their group.

    Earlier: in a smaller document, or (unless other_doc) further left in the same one.
    """
    covered = doc > doc[_heads(new)]
    if not search.other_doc:
        covered |= at > at[_heads(new | _changes(doc, twin))]
    return covered


def _settle(search: Search, key, context, check, doc, twin, at):
    """(order, covered, place of the context among its key's) over rows sorted by (key, context, check, doc, twin, at)."""
    order = np.lexsort((at, twin, doc, check, context, key)) if twin.any() else np.lexsort((at, doc, check, context, key))
    k, c, x, d, t, a = (v[order] for v in (key, context, check, doc, twin, at))
    new_key = _changes(k)
    new = new_key | _changes(c, x)
    nth = np.cumsum(new)
    return order, _covered(search, new, d, t, a), nth - nth[_heads(new_key)]


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans of a document become one; returns (doc, start << 32 | end)."""
    if not len(doc):
        return doc, start
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))  # lifts each document above the one before
    reach = np.maximum.accumulate(end + (number << 33))
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + (number[1:] << 33) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first] << 32 | (reach[last] - (number[last] << 33))


def _document_runs(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for documents named by (doc, twin); returns (doc, twin, span)."""
    if not twin.any():
        d, span = _runs(doc, start, end)
        return d, np.zeros(len(d), np.int64), span
    names, number = np.unique(np.stack([doc, twin]), axis=1, return_inverse=True)
    n, span = _runs(number.ravel(), start, end)
    return names[0][n], names[1][n], span


def anchor_finder(search: Search):
    """(doc, twin, text) -> anchors; spans that the batch settles itself travel along as rows with size -1 (context holds the span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            parts, n = [], 0
            for i, j in in_parts(offsets):
                symbols, cuts = symbols_of(search, data, offsets[i : j + 1])
                a = find_anchors(symbols, cuts, search.window, search.seed, symbols_of(search, data, offsets[i : j + 1], True)[0])
                parts.append((a.seed.view(np.int64), a.context.view(np.int64), a.check.view(np.int64), ids[a.doc + i], twins[a.doc + i], a.start - cuts[a.doc], a.left, a.right))
                n += len(a.start)
                if n >= SETTLED_AT_ONCE:
                    yield from settled(parts)
                    parts, n = [], 0
            if parts:
                yield from settled(parts)

    def settled(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, context, check, doc, twin, at, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, covered, nth = _settle(search, key, context, check, doc, twin, at)
        gone = order[covered]
        d, t, span = _document_runs(doc[gone], twin[gone], at[gone] - left[gone], at[gone] + right[gone])
        stay = order[~covered]
        size = pack(left[stay], right[stay]) | np.where(nth[~covered] > 1, SEVERAL, 0).astype(np.int32)
        yield _batch(FOUND, key[stay], context[stay], check[stay], doc[stay], twin[stay], at[stay].astype(np.int32), size)
        if len(d):
            yield _batch(FOUND, mix(d.view(np.uint64)).view(np.int64), span, np.zeros(len(d), np.int64), d, t, np.zeros(len(d), np.int32), np.full(len(d), -1, np.int32))

    return run


def _in_shards(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """Tables of whole keys in slices of about SHARD_ROWS rows, cut between keys."""
    for t in tables:
        key = t.column(0).to_numpy()
        at = 0
        while at < len(key):
            end = min(at + SHARD_ROWS, len(key))
            end = int(np.searchsorted(key, key[end - 1], "right"))
            yield t.slice(at, end - at).combine_chunks()
            at = end


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole keys; the rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if held and (cut or held[-1].column(0)[-1].as_py() != key[-1]):
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


SETTLED = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("span", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])
SETTLED_SQL = "doc long, twin long, span long, key long, at int, size int"


def context_settler(search: Search):
    """Anchors sorted by (key, context, check, doc, twin, at) -> spans (size -1) and pending anchors (size >= 0).

    What is held between batches is the head of the last context and of its last
    document, how many contexts the last key has had, and the uncovered rows of a
    key's first context until a second one is met (one row, or those of one
    document).
    """

    def waiting(doc, twin, key, at, size):
        return _batch(SETTLED, doc, twin, np.zeros(len(doc), np.int64), key, at.astype(np.int32), (size & (SEVERAL - 1)).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, context, check, doc, twin of the last row
        first_doc = first_at = contexts = 0  # of the last context, of the last document in it; contexts of the last key so far
        held: list[tuple] = []
        for batch in batches:
            key, context, check, doc, twin, at, size = (batch.column(k).to_numpy() for k in range(7))
            span = size < 0
            spans = [(doc[span], twin[span], context[span])]
            key, context, check, doc, twin, at, size = (x[~span] for x in (key, context, check, doc, twin, at.astype(np.int64), size.astype(np.int64)))
            if len(key):
                now = (key, context, check, doc, twin)
                new_key, new_context, new_doc = _changes(*now[:1]), _changes(*now[:3]), _changes(*now)
                if last is not None:  # does the batch go on where the one before ended?
                    same = [a[0] == b for a, b in zip(now, last, strict=True)]
                    new_key[0], new_context[0], new_doc[0] = not same[0], not all(same[:3]), not all(same)
                if held and new_context.any():
                    if not new_key[: np.argmax(new_context) + 1].any():  # the held key has a second context
                        yield waiting(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                # Places of each row's heads; -1: the head is in the batch before.
                head, doc_head = (np.maximum.accumulate(np.where(x, np.arange(len(key)), -1)) for x in (new_context, new_doc))
                covered = doc > np.where(head < 0, first_doc, doc[head])
                if not search.other_doc:
                    covered |= at > np.where(doc_head < 0, first_at, at[doc_head])
                group = np.cumsum(new_key)  # 0: the key of the batch before
                count = np.bincount(group, new_context, minlength=group[-1] + 1)
                if not new_key[0]:
                    count[0] += contexts
                sure = (size & SEVERAL) > 0
                several = (count[group] > 1) | sure
                stay = ~covered
                lone = stay & ~several & (group == group[-1])  # the last key may still get a second context
                if (stay & several).any():
                    k = stay & several
                    yield waiting(doc[k], twin[k], key[k], at[k], size[k])
                if lone.any():
                    held.append((doc[lone], twin[lone], key[lone], at[lone], size[lone]))
                spans.append(_document_runs(doc[covered], twin[covered], at[covered] - (size[covered] >> 8 & 255), at[covered] + (size[covered] & 255)))
                if head[-1] >= 0:
                    first_doc = doc[head[-1]]
                if doc_head[-1] >= 0:
                    first_at = at[doc_head[-1]]
                last, contexts = tuple(x[-1] for x in now), int(count[-1])
            d, t, s = (np.concatenate(x) for x in zip(*spans, strict=True))
            if len(d):
                yield _batch(SETTLED, d, t, s, d, np.zeros(len(d), np.int32), np.full(len(d), -1, np.int32))

    return run


#: Pieces of documents whose windows meet by ``key``: body starts at unit ``at``, its first window has the seed ``offset`` units in;
#: low and high: the offsets that the key's group is about.  n: windows of the piece, or -1 for a span (in ``key``) that is settled.
PIECE = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("body", pa.binary())])
PIECE_SQL = "key long, doc long, twin long, at int, n int, offset int, low int, high int, body binary"


def _sliced(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
    """Slices buffer[start:start + size] as binary arrays of about BODY_BYTES, with the rows that each holds."""
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BODY_BYTES, "right")))
        n, e = size[i:j], ends[i:j] - (ends[i - 1] if i else 0)
        take = np.arange(int(e[-1])) - np.repeat(e - n, n) + np.repeat(start[i:j], n)
        cuts = np.concatenate(([0], e)).astype(np.int32)
        yield slice(i, j), pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(buffer[take]))])
        i = j


def _pieces(search: Search, buffer, bounds, key, doc, twin, at, n, offset, low, high, first) -> Iterator[pa.RecordBatch]:
    """Piece batches; ``first``: the unit of the buffer that a piece starts with, ``bounds``: where units start in the buffer."""
    units = n + search.window - 1
    start, end = bounds[first], bounds[first + units] - (search.unit == "word")
    for rows, body in _sliced(buffer, start, end - start):
        columns = [pa.array(np.ascontiguousarray(x[rows]).astype(np.int64)) for x in (key, doc, twin)]
        columns += [pa.array(np.ascontiguousarray(x[rows]).astype(np.int32)) for x in (at, n, offset, low, high)]
        yield pa.RecordBatch.from_arrays([*columns, body], schema=PIECE)


def context_fetcher(search: Search):
    """(doc, twin, text, [(key, at, size)]) -> pieces: pending anchors with the text of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            pending = batch.column(3)
            row = np.repeat(np.arange(len(ids)), np.diff(pending.offsets.to_numpy()))
            key, at, size = (pending.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            left, right = size >> 8, size & 255
            for i, j in in_parts(offsets):
                r = np.arange(*np.searchsorted(row, [i, j]))
                if len(r):
                    buffer, bounds, cuts = spelled_out(search, data, offsets[i : j + 1])
                    start, low = at[r] - left[r], np.zeros(len(r), np.int64)
                    windows = left[r] + right[r] - search.window + 1
                    yield from _pieces(search, buffer, bounds, key[r], ids[row[r]], twins[row[r]], start, windows, left[r], low, low + search.window - search.seed, cuts[row[r] - i] + start)

    return run


def piece_splitter(search: Search):
    """Pieces of wide prefixes -> halves with longer ones; copies that a batch holds itself are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, doc, twin, at, n, offset, low, high = (batch.column(k).to_numpy().astype(np.int64) for k in range(8))
            data, cuts = text_buffers(batch.column(8))
            buffer, bounds, units = spelled_out(search, data, cuts)
            symbols, _ = symbols_of(search, data, cuts)
            others, _ = symbols_of(search, data, cuts, True)
            h, h2 = prefix_hash(symbols), prefix_hash(others, True)
            middle, parts = (low + high) // 2, []
            for a, b in ((low, middle), (middle + 1, high)):
                x, y = np.maximum(a, offset - n + 1), np.minimum(b, offset)  # offsets of the windows of this half
                r = np.flatnonzero(x <= y)
                skip, seed = (offset - y)[r], (units[:-1] + offset)[r]
                prefix = range_hash(h, seed - a[r], seed + search.window - b[r])
                key = mix(prefix ^ mix(old[r].view(np.uint64) + a[r].astype(np.uint64))).view(np.int64)
                parts.append((key, doc[r], twin[r], at[r] + skip, (y - x + 1)[r], y[r], a[r], b[r], units[:-1][r] + skip))
            key, doc, twin, at, n, offset, low, high, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            end = first + n + search.window - 1
            order, covered, _ = _settle(search, key, range_hash(h, first, end).view(np.int64), range_hash(h2, first, end, True).view(np.int64), doc, twin, at)
            gone, stay = order[covered], order[~covered]
            yield from _pieces(search, buffer, bounds, *(x[stay] for x in (key, doc, twin, at, n, offset, low, high, first)))
            d, t, span = _document_runs(doc[gone], twin[gone], at[gone], at[gone] + n[gone] + search.window - 1)
            if len(d):
                none = np.zeros(len(d), np.int32)
                columns = [pa.array(np.ascontiguousarray(x)) for x in (span, d, t, none, none - 1, none, none, none)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([b""] * len(d), pa.binary())], schema=PIECE)

    return run


SPANS = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("span", pa.int64())])
SPAN_SQL = "doc long, twin long, span long"


def window_settler(search: Search):
    """Pieces sorted by key -> spans of their windows that start earlier elsewhere; windows are equal if their symbols are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_shards(_by_key(batches, PIECE.names)):
            doc, twin, at, n = (t.column(k).to_numpy().astype(np.int64) for k in range(1, 5))
            body = t.column(8).combine_chunks()
            body = body.chunks[0] if isinstance(body, pa.ChunkedArray) else body
            data, offsets = text_buffers(body)
            row = np.repeat(np.arange(len(doc)), n)
            start = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if search.unit == "byte":
                number = byte_window_classes(data, offsets, search.window)
            else:
                number = word_window_classes(*exact_words(data, offsets), search.window)
            order = np.lexsort((start, twin[row], doc[row], number))
            d, w, s = doc[row][order], twin[row][order], start[order]
            gone = _covered(search, _changes(number[order]), d, w, s)
            out = _document_runs(d[gone], w[gone], s[gone], s[gone] + search.window)
            if len(out[0]):
                yield _batch(SPANS, *out)

    return run


def exact_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words (compared byte by byte), and the words' offsets by text."""
    part = data[offsets[0] : offsets[-1]]
    starts, ends, cuts = word_bounds(data, offsets)
    letters = np.ascontiguousarray(part[~IS_SPACE[part]])
    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64), cuts


def settle_windows(search: Search, pieces: DataFrame) -> DataFrame:
    """Pieces of one window each -> spans of those that start earlier elsewhere, by plain aggregates over their bytes."""
    first = pieces.groupBy("body").agg(F.min("doc").alias("first"))
    judged = spread_join(pieces, first, ["body"], "inner")
    late = F.col("doc") > F.col("first")
    if not search.other_doc:
        left = pieces.groupBy("body", "doc", "twin").agg(F.min("at").alias("left"))
        judged = spread_join(judged, left, ["body", "doc", "twin"], "inner")
        late = late | (F.col("at") > F.col("left"))
    return judged.where(late).select("doc", "twin", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("at") + search.window).alias("span"))


def wide_prefixes(rows: DataFrame, search: Search) -> tuple[DataFrame, int, int]:
    """(key, wide) of the keys with more rows than one task may gather; how many keys, how many rows."""
    counts = rows.groupBy("key").count().where(F.col("count") > search.group_rows)
    keys, n = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    return counts.select("key", F.lit(True).alias("wide")), keys, n


def settle_pieces(search: Search, pieces: DataFrame) -> DataFrame:
    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(window_settler(search), SPAN_SQL)


def settle_wide(search: Search, pieces: DataFrame, rows: int) -> DataFrame:
    """Spans of ``rows`` pieces whose prefixes are too wide: prefixes are lengthened, level by level, until their groups fit."""
    out, level, offsets = [], pieces, search.window - search.seed + 1
    while True:
        level = level.mapInArrow(piece_splitter(search), PIECE_SQL)
        if out:  # levels after the first read pieces alone, not texts
            level = level.coalesce(max(level.sparkSession.sparkContext.defaultParallelism, rows // PIECES_PER_FILE))
        level = materialise(level, "pieces")
        out.append(level.where("n < 0").select("doc", "twin", F.col("key").alias("span")))
        live, offsets = level.where("n > 0"), -(-offsets // 2)
        if offsets == 1:
            return union([*out, settle_windows(search, live)])
        wide, keys, rows = wide_prefixes(live, search)
        if not keys:
            return union([*out, settle_pieces(search, live)])
        live = marked_join(live, wide, keys, ["key"])
        out.append(settle_pieces(search, live.where("wide is null").drop("wide")))
        level = live.where("wide").drop("wide")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint spans of packed ones; touching spans become one."""
    _, packed = _runs(np.zeros(len(spans), np.int64), spans >> 32, spans & 0xFFFFFFFF)
    return list(zip((packed >> 32).tolist(), (packed & 0xFFFFFFFF).tolist(), strict=True))


def kept_parts(units, spans: list[tuple[int, int]]) -> list:
    """The slices of units outside the spans."""
    out, at = [], 0
    for s, e in spans:
        out.append(units[at:s])
        at = e
    out.append(units[at:])
    return out


RESULT_SQL = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def cut_text(search: Search, text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(units, units removed, what is left)."""
    if search.unit == "byte":
        units, parts = len(text), kept_parts(text, spans)
        left = b"".join(parts)
        return units, units - len(left), left
    words = text.split()  # bytes split at the six ASCII white-space characters
    parts = [w for part in kept_parts(words, spans) for w in part]
    return len(words), len(words) - len(parts), b" ".join(parts)


def cutter(search: Search, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_buffers(batch.column(1))
            whole = memoryview(data)
            lists = batch.column(2)
            at = lists.offsets.to_numpy()
            packed = lists.flatten().to_numpy()
            flat = at - at[0]
            out: list[list] = [[], [], [], [], []]
            for k in range(len(ids)):
                text = bytes(whole[offsets[k] : offsets[k + 1]])
                spans = merged(packed[flat[k] : flat[k + 1]]) if flat[k + 1] > flat[k] else []
                n, gone, left = cut_text(search, text, spans)
                for column, value in zip(out, (n, gone, len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None), strict=True):
                    column.append(value)
            columns = [ids, *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            if with_text:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out[4], pa.string())], schema=RESULT.append(pa.field("kept_text", pa.string())))
            else:
                yield pa.RecordBatch.from_arrays(columns, schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, search: Search, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per document: units, units removed, removed runs, digest of the rest (and the rest itself).

    A null text is empty.  Null ids come after all others.  Rows that repeat an
    id with another text are documents of their own, none of which is earlier;
    with the same text they are one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), text_or_empty(text_col).alias("text"))
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("again"))
    if not (n := repeated.count()):
        rows = rows.select("id", "doc", F.lit(0).cast("long").alias("twin"), "text")
    else:  # told apart by their texts
        again = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0))
        rows = marked_join(rows, repeated, n, ["doc"]).select("id", "doc", again.cast("long").alias("twin"), "text")
    found = rows.select("doc", "twin", "text").mapInArrow(anchor_finder(search), FOUND_SQL)
    dealt = F.when((F.col("size") > 0) & (F.col("size").bitwiseAND(F.lit(SEVERAL)) > 0), F.xxhash64("key", "context")).otherwise(F.col("key"))
    settled = found.repartition(dealt).sortWithinPartitions("key", "context", "check", "doc", "twin", "at").mapInArrow(context_settler(search), SETTLED_SQL)
    settled = materialise(settled, "settled")
    waiting = settled.where("size >= 0").select("doc", "twin", "key", "at", "size")

    def pieces(anchors: DataFrame) -> DataFrame:
        by_doc = anchors.groupBy("doc", "twin").agg(F.collect_list(F.struct("key", "at", "size")).alias("pending"))
        return rows.join(by_doc, ["doc", "twin"]).select("doc", "twin", "text", "pending").mapInArrow(context_fetcher(search), PIECE_SQL)

    spans = [settled.where("size < 0").select("doc", "twin", "span")]
    wide, keys, n = wide_prefixes(waiting, search)
    if not keys:
        spans.append(settle_pieces(search, pieces(waiting)))
    else:
        marked = marked_join(waiting, wide, keys, ["key"])
        spans += [settle_pieces(search, pieces(marked.where("wide is null"))), settle_wide(search, pieces(marked.where("wide")), n)]
    spans = union(spans).groupBy("doc", "twin").agg(F.collect_list("span").alias("spans"))
    joined = rows.join(spans, ["doc", "twin"], "left").select("id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
    return joined.mapInArrow(cutter(search, with_text), RESULT_SQL + (", kept_text string" if with_text else ""))
