"""Operator 13, SentencePiece encoding and decoding with original byte spans.

A text is normalised first: at each place the longest key of the model's compiled
character map (a double-array trie of bytes) is replaced, everything else stays,
spaces become U+2581 and one is put in front.  For every normalised character the
place it came from is recorded, so each piece projects to a span of bytes of the
text as it was.  The normalised text is then cut before runs of U+2581 that no
piece contains after another character; such chunks are merged pair by pair,
best score first, leftmost among equals, many distinct chunks at once in one flat
array (long ones by a heap).  Characters without a piece become byte pieces.
Distinct chunks are encoded once per worker and remembered, up to a fixed number.

Text is one task's work; the table is never shuffled, so a lost executor costs
its own batches only.

Edge cases: a null text counts as empty and has the end id alone; U+2581 inside a
text decodes to a space, as in the library; rows that repeat an id, or have none,
are encoded each by itself; an empty table gives an empty result; columns are
carried only by name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import gather, in_batches
from .common import read_table, text_or_empty

SPACE, NO_RANK = "▁", np.int64(1 << 40)
LONG_CHUNK = 128
#: Chunks that a worker remembers.
CACHE_CHUNKS = 500_000
#: Kinds of pieces, and the numbers of fields in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_SPACE, BYTE_FALLBACK, UNK_ID, EOS_ID, UNK_SURFACE = 3, 24, 35, 40, 42, 44
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol-buffer message by number: integers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = raw[at : at + n]
            at += n
        out.setdefault(tag >> 3, []).append(value)
    return out


@dataclass
class CharMap:
    """A compiled character map: units of a double-array trie, and replacements ended by zero bytes."""

    units: np.ndarray
    replacements: bytes

    @classmethod
    def of(cls, blob: bytes) -> CharMap | None:
        if not blob:
            return None
        size = struct.unpack_from("<I", blob)[0]
        return cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])

    @staticmethod
    def step(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[str, int] | None:
        """Replacement and length in bytes of the longest key that begins at ``at``."""
        node, found = self.step(int(self.units[0])), None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = int(self.units[node])
            if unit & 0x800000FF != text[i]:
                break
            node ^= self.step(unit)
            if unit >> 8 & 1:
                found = int(self.units[node]) & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, n = found
        return self.replacements[start : self.replacements.index(b"\0", start)].decode(), n


@dataclass
class Model:
    """Tables of a SentencePiece BPE model, small enough to travel with the task."""

    spelled: list[str]
    kinds: list[int]
    symbols: dict[str, int]  # pieces by id; characters that occur inside pieces only come after them
    pair_keys: np.ndarray  # left << 32 | right, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    bytes_of: list[bytes]  # what a piece decodes to
    byte_ids: list[int]
    charmap: CharMap | None
    dummy_prefix: bool
    remove_spaces: bool
    unk_id: int
    eos_id: int
    byte_fallback: bool
    user: list[str] = field(default_factory=list)
    whole_texts: bool = False  # a piece has U+2581 after another character, so texts can't be cut

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        top = fields(raw)
        trainer, normalizer = (fields(top.get(k, [b""])[0]) for k in (TRAINER, NORMALIZER))
        get = lambda x, k, default: x.get(k, [default])[0]
        if get(trainer, MODEL_TYPE, 1) != 2 or get(trainer, SUFFIX_SPACE, 0) or not get(normalizer, ESCAPE_SPACES, 1):
            raise ValueError("only BPE models with spaces in front of words are read")
        spelled, scores, kinds = [], [], []
        for piece in map(fields, top[PIECES]):
            spelled.append(get(piece, 1, b"").decode())
            scores.append(struct.unpack("<f", get(piece, 2, bytes(4)))[0])
            kinds.append(get(piece, 3, NORMAL))
        if UNUSED in kinds:
            raise ValueError("models with unused pieces are not read")
        usual = {p: i for i, (p, k) in enumerate(zip(spelled, kinds, strict=True)) if k in (NORMAL, USER)}
        symbols = dict(usual)
        for p in usual:
            for c in p:
                symbols.setdefault(c, len(spelled) + len(symbols))
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in usual.values()}, reverse=True))}
        pairs = [(symbols[p[:k]] << 32 | symbols[p[k:]], order[scores[i]], i) for p, i in usual.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        surface = get(trainer, UNK_SURFACE, " ⁇ ".encode())
        byte_ids = [0] * 256
        bytes_of = []
        for i, (p, k) in enumerate(zip(spelled, kinds, strict=True)):
            if k == BYTE:
                byte_ids[int(p[3:5], 16)] = i
            bytes_of.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else surface if k == UNKNOWN else p.replace(SPACE, " ").encode())
        keys, ranks, ids = (np.array([x[j] for x in pairs], np.int64) for j in range(3))
        return cls(
            spelled, kinds, symbols, keys, ranks, ids, bytes_of, byte_ids, CharMap.of(get(normalizer, CHARSMAP, b"")), bool(get(normalizer, DUMMY_PREFIX, 1)),
            bool(get(normalizer, REMOVE_SPACES, 1)), get(trainer, UNK_ID, 0), get(trainer, EOS_ID, 2), bool(get(trainer, BYTE_FALLBACK, 0)),
            sorted((p for p, k in zip(spelled, kinds, strict=True) if k == USER), key=len, reverse=True), any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usual),
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols by the score of what they make (NO_RANK: nothing), and its place among the keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK), at


def normalised(m: Model, text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters and its end, the byte of ``text`` that it came from."""
    if not text:
        return "", [0]
    raw, out, origin, at = text.encode(), [], [], 0

    def longest(at: int) -> tuple[str, int]:
        for p in m.user:
            if raw.startswith(p.encode(), at):
                return p, len(p.encode())
        if m.charmap and (hit := m.charmap.longest(raw, at)):
            return hit
        n = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
        return raw[at : at + n].decode(), n

    if m.remove_spaces:
        while at < len(raw):
            new, n = longest(at)
            if new != " ":
                break
            at += n
        if at == len(raw):
            return "", [at]
    if m.dummy_prefix:
        out.append(SPACE)
        origin.append(at)
    after_space = m.remove_spaces
    while at < len(raw):
        new, n = longest(at)
        kept = new.lstrip(" ") if after_space else new
        if kept:
            out.extend(kept)
            origin.extend([at] * len(kept))
            after_space = m.remove_spaces and kept.endswith(" ")
        at += n
    if m.remove_spaces:
        while out and out[-1] in (" ", SPACE):
            out.pop()
            at = origin.pop()
    return "".join(out).replace(" ", SPACE), [*origin, at]


def plainly_normalised(m: Model, text: str) -> str:
    """The normalised text of a model without a character map, all at once."""
    return (SPACE * m.dummy_prefix + text.replace(" ", SPACE)) if text else ""


def first_symbols(m: Model, chunks: list[str]) -> np.ndarray:
    """The symbols of all characters of the chunks, one chunk after another; -1 - code point for a character that is no symbol."""
    points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
    if not len(points):
        return points
    seen, back = np.unique(points, return_inverse=True)
    return np.array([m.symbols.get(chr(p), -1 - p) for p in seen.tolist()], np.int64)[back]


def merged(m: Model, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that the chunks (each with characters) are merged to, one chunk after another, and how many each has."""
    long = [k for k, c in enumerate(chunks) if len(c) > LONG_CHUNK]
    short = [k for k, c in enumerate(chunks) if len(c) <= LONG_CHUNK]
    done_ids = [np.array(merged_long(m, chunks[k]), np.int64) for k in long]
    done_of = [np.full(len(x), k, np.int64) for k, x in zip(long, done_ids, strict=True)]
    ids = first_symbols(m, [chunks[k] for k in short])
    chunk = np.repeat(np.array(short, np.int64), [len(chunks[k]) for k in short])
    rank, at = m.ranks(ids[:-1], ids[1:])
    while len(ids):
        inner = chunk[1:] == chunk[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~inner)))
        size = np.diff(np.append(first, len(ids)))
        rank, at = np.append(np.where(inner, rank, NO_RANK), NO_RANK), np.append(at, 0)
        least = np.repeat(np.minimum.reduceat(rank, first), size)
        stay = least < NO_RANK
        if not stay.all():
            done_ids.append(ids[~stay])
            done_of.append(chunk[~stay])
            ids, chunk, rank, at, least = ids[stay], chunk[stay], rank[stay], at[stay], least[stay]
            if not len(ids):
                break
        hit = np.flatnonzero(rank == least)
        hit = hit[np.concatenate(([True], chunk[hit[1:]] != chunk[hit[:-1]]))]  # the leftmost of each chunk
        ids[hit] = m.pair_ids[at[hit]]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        made = (np.cumsum(keep) - 1)[hit]
        ids, chunk, rank, at = ids[keep], chunk[keep], rank[keep][:-1], at[keep][:-1]
        for pair in (made[made < len(ids) - 1], made[made > 0] - 1):  # only the pairs beside a merge change
            rank[pair], at[pair] = m.ranks(ids[pair], ids[pair + 1])
    flat, of = np.concatenate([np.zeros(0, np.int64), *done_ids]), np.concatenate([np.zeros(0, np.int64), *done_of])
    return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(chunks))


def piece_ids(m: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no pieces become byte pieces, or the unknown piece."""
    odd = np.flatnonzero((symbols < 0) | (symbols >= len(m.spelled)))
    if not len(odd):
        return symbols, sizes
    letters = {i: c for c, i in m.symbols.items() if i >= len(m.spelled)}
    new = [[m.byte_ids[b] for b in (chr(-1 - x) if x < 0 else letters[x]).encode()] if m.byte_fallback else [m.unk_id] for x in symbols[odd].tolist()]
    count = np.ones(len(symbols), np.int64)
    count[odd] = [len(x) for x in new]
    out = np.repeat(symbols, count)
    out[np.repeat(np.isin(np.arange(len(symbols)), odd), count)] = list(chain.from_iterable(new))
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(count)))
    return out, total[ends] - total[ends - sizes]


def merged_long(m: Model, chunk: str) -> list[int]:
    """Pair by pair with a heap over a linked list."""
    ids = [m.symbols.get(x, -1 - ord(x)) for x in chunk]
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    known: dict[tuple[int, int], tuple[int, int]] = {}
    rank, at = m.ranks(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(r, i, ids[i], ids[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), at.tolist(), strict=True)) if r < NO_RANK]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j >= n:
            return
        pair = ids[i], ids[j]
        if pair not in known:
            r, p = m.ranks(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = int(r[0]), int(p[0])
        r, p = known[pair]
        if r < NO_RANK:
            heapq.heappush(heap, (r, i, *pair, p))

    while heap:
        _, i, a, b, p = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = int(m.pair_ids[p]), False, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [x for x, live in zip(ids, alive, strict=True) if live]


class Encoder:
    """Encodes texts and remembers the chunks it has met."""

    def __init__(self, model: Model) -> None:
        self.m = model
        user = "|".join(map(re.escape, model.user))
        body = rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if not model.whole_texts else r"[\s\S]+"
        self.find = re.compile(body, re.S).findall
        self.user = re.compile(f"({user})") if user else None
        self.plain = model.charmap is None and not model.remove_spaces and self.user is None
        self.forget()
        kinds = np.array(model.kinds)
        self.is_byte = kinds == BYTE
        self.goes_on = np.array([k == BYTE and 0x80 <= model.bytes_of[n][0] < 0xC0 for n, k in enumerate(model.kinds)])
        self.widths = np.array([0 if k == CONTROL else 1 if k == UNKNOWN else len(model.spelled[n]) for n, k in enumerate(model.kinds)], np.int64)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def chunks(self, norm: str) -> list[str]:
        if self.user is None:
            return self.find(norm)
        return [c for k, part in enumerate(self.user.split(norm)) for c in ([part] if k % 2 else self.find(part))]

    def learn(self, chunks: list[str]) -> None:
        m = self.m
        own = {c for c in m.user} & set(chunks)
        fresh = [c for c in chunks if c not in own]
        ids, sizes = piece_ids(m, *merged(m, fresh))
        self.place.update(zip([*fresh, *own], range(len(self.offsets) - 1, len(self.offsets) - 1 + len(chunks)), strict=True))
        self.flat = np.concatenate([self.flat, ids, np.array([m.symbols[c] for c in own], np.int64)])
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum([*sizes, *[1] * len(own)], dtype=np.int64)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, the end id last."""
        split = [self.chunks(plainly_normalised(self.m, t) if self.plain else normalised(self.m, t)[0]) for t in texts]
        every = set(chain.from_iterable(split))
        fresh = sorted(every - self.place.keys())
        if len(self.place) + len(fresh) > CACHE_CHUNKS:
            self.forget()
            fresh = sorted(every)
        if fresh:
            self.learn(fresh)
        ends = np.cumsum([len(c) for c in split], dtype=np.int64)
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(ends[-1]) if len(ends) else 0)
        size = self.offsets[place + 1] - self.offsets[place]
        ids = gather(self.flat, self.offsets[place], size).tolist()
        cut = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], ends))].tolist()
        return [[*ids[a:b], self.m.eos_id] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def plain_spans(self, text: str, ids: list[int]) -> np.ndarray:
        """:meth:`spans` as rows (start, end), all at once, of a model that changes nothing but spaces."""
        raw, i = np.frombuffer(text.encode(), np.uint8), np.array(ids, np.int64)
        front = [0] if self.m.dummy_prefix and text else []
        origin = np.concatenate((np.array(front, np.int64), np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]))
        last = self.is_byte[i]
        last[:-1] &= ~self.goes_on[i[1:]]
        at = np.concatenate(([0], np.cumsum(np.where(self.is_byte[i], last, self.widths[i]))))
        return np.stack((origin[at[:-1]], origin[at[1:]]), axis=1)

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each id, the bytes of ``text`` that it stands for; of byte pieces the last of a character has them, the end id none."""
        norm, origin = normalised(self.m, text)
        out, at, left = [], 0, 0
        for i in ids:
            kind = self.m.kinds[i]
            if kind == CONTROL:
                n = 0
            elif kind == BYTE:
                left = left or len(norm[at].encode())
                left -= 1
                n = int(left == 0)
            else:
                n = 1 if kind == UNKNOWN else len(self.m.spelled[i])
            out.append((origin[at], origin[at + n]))
            at += n
        return out


def decode(m: Model, ids: list[int]) -> bytes:
    """The text that the ids stand for: one space in front goes, invalid runs of byte pieces become U+FFFD, byte by byte."""
    ids = [i for i in ids if m.kinds[i] != CONTROL]
    raw = b"".join(map(m.bytes_of.__getitem__, ids))
    if (m.dummy_prefix or m.remove_spaces) and ids and m.kinds[ids[0]] in (NORMAL, USER):
        raw = raw.lstrip(b" ") if m.remove_spaces else raw.removeprefix(b" ")
    try:
        raw.decode()
    except UnicodeDecodeError as wrong:
        good, rest = raw[: wrong.start].decode(), raw[wrong.start :]
        parts = [good]
        while rest:
            try:
                parts.append(rest.decode())
                break
            except UnicodeDecodeError as e:
                parts += [rest[: e.start].decode(), "�"]
                rest = rest[e.start + 1 :]
        raw = "".join(parts).encode()
    return raw


RESULT_SQL = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encoder_of(model: Model, detail: bool, carried: int):
    """Batches of (carried columns, text) -> carried columns, counts, digests (and ids, span starts, span ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, numbers = Encoder(model), [str(i) for i in range(len(model.spelled))]
        for batch in batches:
            texts = batch.column(carried).to_pylist()
            for i, j in in_batches(texts):
                ids = encoder.encode(texts[i:j])
                columns = {batch.schema.names[k]: batch.column(k).slice(i, j - i) for k in range(carried)}
                columns["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
                columns["ids_sha256"] = pa.array([hashlib.sha256(" ".join(map(numbers.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(decode(model, x)).hexdigest() for x in ids], pa.string())
                spans_of = encoder.plain_spans if encoder.plain else encoder.spans
                spans = [spans_of(t, x) for t, x in zip(texts[i:j], ids, strict=True)]
                columns["spans_sha256"] = pa.array([hashlib.sha256(np.asarray(x, "<u8").tobytes()).hexdigest() for x in spans], pa.string())
                if detail:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                    columns["starts"] = pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int64()))
                    columns["ends"] = pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def load_model(path: str) -> Model:
    """Reads the file on the driver; tasks get the tables, so executors need no file."""
    with open(path, "rb") as f:
        return Model.parse(f.read())


def encode_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), detail: bool = False) -> DataFrame:
    """id, carried columns, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (byte spans as pairs of little-endian unsigned 64-bit integers), without a shuffle; ``detail`` adds ids and their byte spans (starts, ends)."""
    names = list(dict.fromkeys([id_col, *carry]))
    rows = docs.select(*[F.col(c) for c in names], text_or_empty(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encoder_of(model, detail, len(names)), f"{schema}, {RESULT_SQL}" + (", ids array<int>, starts array<long>, ends array<long>" if detail else ""))


def public_model() -> str:
    """Where the public model lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), load_model(public_model()))
