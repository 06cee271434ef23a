"""Operator 4, BPE encoding and decoding: batched numpy merge rounds.

The symbols of many words stand in one flat array.  A round finds the rank of
every adjacent pair by binary search over the sorted pair keys, takes each
word's least rank, and merges all its occurrences at once; words without a
mergeable pair leave the batch.  A trained merge list ranks every pair above the
merges that made its parts, so a round equals the pair-by-pair order.  Words
longer than LONG_WORD bytes go through a heap instead (a round merges one rank
per word, too few for them).  Distinct words are encoded once per worker and
remembered, up to a fixed number.

Edge cases: null and empty texts have no tokens; special tokens inside a text
become their ids, as the tokenizers library does; an empty table gives an empty
result; extra columns are ignored by :func:`encode_texts`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Fixed value: the pre-tokenizer pattern of the vocabulary; \s stands for the White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Words that a worker remembers, and characters it handles at once.
CACHE_WORDS, BATCH_CHARS = 300_000, 1 << 20
NO_RANK = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE, small enough to travel with the task (about 2 MB)."""

    byte_ids: np.ndarray  # id of each byte
    pair_keys: np.ndarray  # left << 32 | right, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    token_bytes: np.ndarray  # of all tokens, one after another
    token_offsets: np.ndarray
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        spec = json.loads(text)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        spelled |= {i: token.encode() for token, i in special.items()}
        tokens = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        by_byte = {b: vocab[c] for c, b in letters.items()}
        return cls(
            np.array([by_byte[b] for b in range(256)], np.int64), keys[order], order.astype(np.int64), made[order],
            np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens]))), special,
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NO_RANK: none) and its place among the sorted keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK), at


def encode_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
    for k, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[k] = encode_long(v, w)
    if not short:
        return out
    ids = v.byte_ids[np.frombuffer(b"".join(words[k] for k in short), np.uint8)]
    word = np.repeat(np.array(short), [len(words[k]) for k in short])
    while len(ids):
        inner = word[1:] == word[:-1]
        rank, at = v.ranks(ids[:-1], ids[1:])
        rank[~inner] = NO_RANK
        rank, at = np.append(rank, NO_RANK), np.append(at, 0)
        first = np.flatnonzero(np.concatenate(([True], ~inner)))
        size = np.diff(np.append(first, len(ids)))
        least = np.minimum.reduceat(rank, first)
        done = least == NO_RANK
        if done.any():
            for f, n in zip(first[done].tolist(), size[done].tolist(), strict=True):
                out[word[f]] = ids[f : f + n]
            stay = np.repeat(~done, size)
            ids, word, rank, at = ids[stay], word[stay], rank[stay], at[stay]
            least, size = least[~done], size[~done]
            if not len(ids):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        # In a run of overlapping pairs (aaa) every second one is merged, from the left.
        fresh = np.ones(len(hit), bool)
        fresh[1:] = hit[1:] != hit[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, hit, 0))
        hit = hit[(hit - run) % 2 == 0]
        ids[hit] = v.pair_ids[at[hit]]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, word = ids[keep], word[keep]
    return out


def encode_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """Pair by pair with a heap over a linked list: n log n for a word of n bytes."""
    ids = v.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    rank, at = v.ranks(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(r, i, ids[i], ids[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), at.tolist(), strict=True)) if r < NO_RANK]
    heapq.heapify(heap)
    lookup: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = after[i]
        if i < 0 or j >= n:
            return
        pair = (ids[i], ids[j])
        if pair not in lookup:
            r, p = v.ranks(np.array([pair[0]]), np.array([pair[1]]))
            lookup[pair] = int(r[0]), int(p[0])
        r, p = lookup[pair]
        if r < NO_RANK:
            heapq.heappush(heap, (r, i, *pair, p))

    while heap:
        _, i, a, b, p = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = int(v.pair_ids[p]), False, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return np.array([x for x, live in zip(ids, alive, strict=True) if live], np.int64)


class Encoder:
    """Encodes batches of texts and remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.find = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.v.special, key=len, reverse=True)) + ")") if self.v.special else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self._learn(list(self.v.special), [np.array([i], np.int64) for i in self.v.special.values()])

    def _learn(self, words: list[str], ids: list[np.ndarray]) -> None:
        self.place.update(zip(words, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)))

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(t in text for t in self.v.special):
            return self.find(text)
        return [w for k, part in enumerate(self.special.split(text)) for w in ([part] if k % 2 else self.find(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        split = [self.words(t) for t in texts]
        fresh = sorted({w for ws in split for w in ws if w not in self.place})
        if len(self.place) + len(fresh) > CACHE_WORDS:
            self.forget()
            fresh = sorted({w for ws in split for w in ws} - self.place.keys())
        if fresh:
            self._learn(fresh, encode_words(self.v, [w.encode() for w in fresh]))
        count = np.array([len(ws) for ws in split], np.int64)
        place = np.fromiter((p for ws in split for p in map(self.place.__getitem__, ws)), np.int64, int(count.sum()))
        size = self.offsets[place + 1] - self.offsets[place]
        ends = np.cumsum(size)
        ids = gather(self.flat, self.offsets[place], size)
        by_text = np.concatenate(([0], np.cumsum(count)))
        return ids, np.concatenate(([0], ends))[by_text]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[k] : start[k] + size[k]] of all k, one after another."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The bytes that the tokens stand for; invalid UTF-8 becomes U+FFFD, as in the tokenizers library."""
    start = v.token_offsets[ids]
    raw = gather(v.token_bytes, start, v.token_offsets[ids + 1] - start).tobytes()
    return raw.decode("utf-8", "replace").encode()


def in_batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= BATCH_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


RESULT_SQL = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoder_of(vocabulary: Vocabulary, with_ids: bool, carried: int):
    """Batches of (carried columns, text) -> carried columns, counts, digests (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(carried).to_pylist()
            for i, j in in_batches(texts):
                ids, offsets = encoder.encode(texts[i:j])
                small = ids.astype("<u4")
                cut = offsets.tolist()
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                columns = {batch.schema.names[k]: batch.column(k).slice(i, j - i) for k in range(carried)}
                columns["n_tokens"] = pa.array(np.diff(offsets), pa.int64())
                columns["ids_sha256"] = pa.array([hashlib.sha256(small[a:b]).hexdigest() for a, b in spans], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(decode(vocabulary, ids[a:b])).hexdigest() for a, b in spans], pa.string())
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def load_vocabulary(path: str) -> Vocabulary:
    """Reads the file on the driver; tasks get the tables, so executors need no file."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary.from_json(f.read())


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """id, carried columns, n_tokens, ids_sha256, decoded_sha256 (and ids), without a shuffle."""
    names = list(dict.fromkeys([id_col, *carry]))
    rows = docs.select(*[F.col(c) for c in names], text_or_empty(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(encoder_of(vocabulary, with_ids, len(names)), f"{schema}, {RESULT_SQL}" + (", ids array<int>" if with_ids else ""))


def public_vocabulary() -> str:
    """Where the public byte-level vocabulary lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_vocabulary(public_vocabulary()))
