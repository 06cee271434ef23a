"""Points: every pair of a block, every candidate and every point of a document, against the plain version without its bounds."""

import inspect
import random

import test_points as plain
from pyspark.sql import functions as F

from siltstone.operators import points


def unbounded():
    source = inspect.getsource(plain.plain_points)
    for cap in ("[:60]", "[:12]", "[:200]"):
        assert cap in source
        source = source.replace(cap, "")
    scope = dict(vars(plain))
    exec(source, scope)
    return scope["plain_points"]


def long_text(rng):
    table = "\n".join(f"| r{k} | {rng.randint(200, 480)} K | {rng.randint(1, 59)}.{rng.randint(0, 9)} |" for k in range(rng.randint(70, 90)))
    said = "; ".join(f"at {rng.randint(200, 480)} K it was {rng.randint(1, 99)} mmol/g" for _ in range(rng.randint(20, 40)))
    return f"## Table of results that were measured in this work\n| Ref | T (K) | Uptake (mmol/g) |\n|---|---|---|\n{table}\n\n## What sentences say about the measured material\n{said}"


def test_nothing_is_cut(spark):
    rng, whole = random.Random(5), unbounded()
    texts = [long_text(rng) for _ in range(6)] + [plain.varied(rng) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {}
    for r in points.literature_points(docs, "id", "text", "CO2 uptake capacity").orderBy("doc", "x", "y").collect():
        got.setdefault(r["doc"], []).append((r["block"], r["x_kind"], r["x"], r["y"], r["provenance"], r["y_unit"]))
    want = {i: p for i, p in ((i, whole(t)) for i, t in enumerate(texts)) if p}
    assert got == want and min(len(want[i]) for i in range(6)) > 1000  # before, 60 pairs of a block at most


def test_long_sequences_pair_in_order(spark):
    text = "at " + ", ".join(f"{300 + k} K" for k in range(9)) + " it was " + ", ".join(f"{9 - k} mmol/g" for k in range(9))
    blocks = spark.createDataFrame([(1, text)], "id long, text string").withColumn("y_unit", F.lit("mmol/g"))
    got = points.sentence_pairs(blocks, ["id"], F.col("y_unit")).orderBy("place").collect()
    assert [(r["x"], r["y"]) for r in got] == [(300 + k, 9 - k) for k in range(9)]
