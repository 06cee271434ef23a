"""Clustered layout and importance resampling against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import clustered_layout as layout
from siltstone.llm import importance_resampling as resampling
from siltstone.llm import ordering

DOCS = "doc_id long, text string, lang string, source string, z int, position string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, "clash") for i, t, lang, s in rows], DOCS)


def hot_rows(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else rng.choice([None, "", "é", "a", "Z", "zz", *[f"s{k}" for k in range(14)]])
        rows.append((i, rng.choice([None, "", "x" * rng.randint(0, 9), "é" * rng.randint(1, 300)]), rng.choice(["en", "fr", None]), source))
    rows += [(5, "again", "en", "hot")] * 3 + [(None, "no id", "fr", "a")] * 2
    return rows


def plain_layout(rows, bits, reach, file_rows):
    values = [
        (None if s is None else s.encode(), None if lang is None else lang.encode(), -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365)
        for i, t, lang, s in rows
    ]
    key = lambda v: (v is not None, 0 if v is None else v)
    coords = []
    for d in range(4):
        column = sorted(key(v[d]) for v in values)
        least = {}
        for place, k in enumerate(column):
            least.setdefault(k, place)
        coords.append([(1 << bits) * least[key(v[d])] // len(rows) for v in values])
    coords = list(zip(*coords, strict=True))

    def cell(c):
        z = 0
        for b in range(bits - 1, -1, -1):
            for x in c:
                z = z * 2 + (x >> b & 1)
        return z

    order = sorted(range(len(rows)), key=lambda k: (cell(coords[k]), rows[k][0] is not None, rows[k][0] or 0))
    file_of = {k: place // file_rows for place, k in enumerate(order)}
    held = {}
    for k, f in file_of.items():
        held.setdefault(f, set()).add(coords[k])
    bounds = {f: [(min(c[d] for c in cs), max(c[d] for c in cs)) for d in range(4)] for f, cs in held.items()}
    out = []
    for place, k in enumerate(order):
        q = [(x - r, x + r) for x, r in zip(coords[k], reach, strict=True)]
        touched = sum(all(a <= hi and b >= lo for (a, b), (lo, hi) in zip(box, q, strict=True)) for box in bounds.values())
        matching = sum(any(all(lo <= x <= hi for x, (lo, hi) in zip(c, q, strict=True)) for c in cs) for cs in held.values())
        f = place // file_rows
        out.append((rows[k][0], cell(coords[k]), place, f, touched, matching, ",".join(f"{a},{b}" for a, b in bounds[f])))
    return out


@pytest.mark.parametrize(("bits", "file_rows", "reach"), [(4, 7, [0, 0, 2, 2]), (4, 1000, [0, 0, 2, 2]), (3, 20, [0, 1, 3, 0])])
def test_layout_equals_plain_one(spark, bits, file_rows, reach):
    rows = hot_rows()
    values = layout.document_values(documents(spark, rows))
    got = layout.clustered(values, ["source", "lang", "length", "date"], reach, bits=bits, file_rows=file_rows, salt=F.col("_text"))
    got = [tuple(r)[:7] for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_layout(rows, bits, reach, file_rows)))


def test_layout_equals_sql(spark, tmp_path):
    rows = [r for r in hot_rows(2600, 8) if r[0] is not None][:2600]
    documents(spark, rows).select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    got = layout.op11_clustered_layout(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(layout.OP11_SQL).fetchdf()
    assert sorted(map(str, map(list, got.select(*want.columns).toPandas().to_numpy()))) == sorted(map(str, map(list, want.to_numpy())))


def test_jumps_and_intervals_against_all_cells():
    rng = np.random.default_rng(4)
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        every = np.arange(1 << dims * bits)
        coords = np.stack([layout.gathered_bits(every, d, dims, bits) for d in range(dims)], 1)
        a, b = rng.integers(0, 1 << bits, (2, 60, dims))
        low_c, high_c = np.minimum(a, b), np.maximum(a, b)
        low, high = (sum(layout.spread_bits(x[:, d], d, dims, bits) for d in range(dims)) for x in (low_c, high_c))
        inside = [set(every[((coords >= lo) & (coords <= hi)).all(1)].tolist()) for lo, hi in zip(low_c, high_c, strict=True)]
        covered = [[] for _ in inside]
        for box, first, last in layout.box_intervals(low, high, dims, bits):
            for k, x, y in zip(box.tolist(), first.tolist(), last.tolist(), strict=True):
                assert not covered[k] or covered[k][-1] < x - 1  # ascending, and not adjacent
                covered[k] += range(x, y + 1)
        assert [set(c) for c in covered] == inside
        for k, cells in enumerate(inside):
            for z in rng.integers(0, len(every), 12):
                want = min((c for c in cells if c > z), default=-1)
                assert layout.next_in_box(np.array([z]), low[k : k + 1], high[k : k + 1], dims, bits)[0] == want


def test_layout_edges(spark):
    empty = layout.clustered(layout.document_values(documents(spark, [(1, "a", "en", "s")]).limit(0)), ["source", "lang", "length", "date"], [0, 0, 2, 2])
    assert empty.count() == 0 and "file_bounds" in empty.columns
    nothing = documents(spark, [(None, None, None, None)] * 4)
    got = layout.clustered(layout.document_values(nothing), ["source", "lang", "length", "date"], [0, 0, 2, 2], file_rows=3).collect()
    assert sorted((r["position"], r["file"], r["files_touched"], r["files_matching"]) for r in got) == [(0, 0, 2, 2), (1, 0, 2, 2), (2, 0, 2, 2), (3, 1, 2, 2)]
    with pytest.raises(ValueError, match="reach 0"):
        layout.clustered(layout.document_values(nothing), ["length", "date"], [1, 1])


def test_positions_and_sums(spark):
    rows = spark.range(0, 500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), (F.col("id") % 3).alias("n"))
    got = sorted((r["k"], r["v"], r["position"]) for r in ordering.positions(rows, [F.col("k").desc(), F.col("v")]).collect())
    want = sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert got == sorted((k, v, p) for p, (k, v) in enumerate(want))
    total = {r["v"]: r["before"] for r in ordering.running_before(rows, [F.col("v")], "n", "before").collect()}
    assert all(total[i] == sum(j % 3 for j in range(i)) for i in range(500))


def plain_resampling(docs, target, max_order, buckets, seed, share, least):
    def words(t):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def runs(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_order + 1) for i in range(len(w) - k + 1)]

    here, there = Counter(), Counter()
    for _, t in docs:
        here.update(runs(t))
    for t in target:
        there.update(runs(t))
    big_s, big_t = sum(here.values()), sum(there.values())
    gain = {b: math.floor(1000 * math.log((there[b] + 1) * (big_s + buckets) / ((n + 1) * (big_t + buckets)))) for b, n in here.items()}
    rows = []
    for i, t in docs:
        r = runs(t)
        weight = sum(gain[b] for b in r) // len(r) if r else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * share // 100]):
        r[4] = k + 1
    return rows


@pytest.mark.parametrize(("max_order", "buckets"), [(1, 10_000), (2, 500), (3, 50)])
def test_resampling_equals_plain_one(spark, max_order, buckets):
    rng = random.Random(2)
    vocabulary = ["the", "Der", "ÉTÉ", "été", "x1", "東京", "a" * 400, "I", "don't", "_", "re-do"]
    text = lambda: rng.choice([" ", "\n", "--"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))
    docs = [(i, rng.choice([text(), text(), text(), "", None, " - "])) for i in range(150)] + [(7, "the the"), (None, text()), (None, None), (3, "x " * 30)]
    docs += [(200, "same words here " * 9)] * 3
    target = [text() for _ in range(12)] + [None]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, score int, bucket string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, aim, max_order=max_order, buckets=buckets, share=30).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, plain_resampling(docs, target, max_order, buckets, 2024, 30, 20)))


def test_resampling_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(resampling.OP12_SQL).fetchall()
    columns = [c[0] for c in con.description]
    got = resampling.op12_importance_resampling(spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, none).count() == 0
    row = resampling.resample(docs, none, share=100).collect()[0]
    assert row["rank"] == 1 and row["n_features"] == 25 and row["weight"] == math.floor(1000 * math.log((25 + 10_000) / (26 * 10_000)))
