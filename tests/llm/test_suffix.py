"""Suffix sorting against plain sorting."""

import random

import numpy as np
import pytest

from siltstone.llm import suffix


def texts(seed):
    rng = random.Random(seed)
    out = [b"", b"a", b"a" * 70, b"ab" * 40, b"ba" * 35 + b"a", bytes(range(256)), bytes(reversed(range(256))), b"\x00\xff" * 20]
    base = bytes(rng.choices(b"abcd", k=400))
    for _ in range(25):
        i, j = sorted(rng.choices(range(400), k=2))
        out.append(base[i:j] + bytes(rng.choices(b"ab", k=rng.randint(0, 60))))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    s = np.concatenate([np.frombuffer(t, np.uint8).astype(np.int16) + 2 for t in texts(seed)] + [np.array([1, 1, 0], np.int16)])
    plain = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert suffix.induced_suffix_array(s, 258, len(s)).tolist() == plain
    tiny = np.array([2, 2, 0], np.int16)
    assert suffix.induced_suffix_array(tiny, 258, 3).tolist() == [2, 1, 0]


@pytest.mark.parametrize("window", [8, 13, 40])
def test_window_classes(window):
    every = texts(9)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in every])))
    codes = np.frombuffer(b"".join(every), np.uint8)
    windows = [t[i : i + window] for t in every for i in range(len(t) - window + 1)]
    for f, c in ((suffix.byte_window_classes, codes), (suffix.word_window_classes, codes.astype(np.uint32) * 77)):
        got = f(c, offsets, window).tolist()
        assert len(got) == len(windows) and len(set(zip(got, windows, strict=True))) == len(set(got)) == len(set(windows))
    assert suffix.byte_window_classes(codes, np.array([0, 3]), 8).tolist() == []
