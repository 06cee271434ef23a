"""Sorted runs against plain versions: a hot group over many runs, ties, values at the edges, nulls, clashing names."""

import math
import random

import numpy as np
import pytest

from siltstone.operators import runs


def prior(v, known):
    known = np.array(known)
    if not len(known):
        return 0.0, None
    mid = float(np.median(known))
    kept = known[(known >= mid * 0.02) & (known <= mid * 50)]
    kept = kept if len(kept) else known
    relative = abs(v - kept) / np.maximum(kept, 1e-6)
    return min(0.6 / (1 + relative.min()) + 0.4 * (relative <= 0.25).mean(), 1.0), (abs(v - known) / np.maximum(known, 1e-6)).min()


def test_prior_against_all_others(spark):
    draw = random.Random(3)
    values = [("hot", round(draw.lognormvariate(0, 2), 2)) for _ in range(300)]
    values += [("edge", x) for x in (3.0, 4.0, 2.4, 3.2, 1.92, 900.0, 1200.0, 720.0, 0.75, 1.0)]  # exactly a quarter apart
    values += [("tiny", x) for x in (1e-9, 2.5e-7, 5e-7, 7.5e-7, 1e-6, 1.25e-6, 1.1e-6, 8.5e-7)]
    values += [("far", x) for x in (1e-3, 1.0, 1e3, 1e6)] + [("two", 1.0), ("two", 1000.0), ("pair", 2.0), ("pair", 2.0), ("one", 5.0)]
    values += [("hot", x) for x in (None, 0.0, -4.0, math.nan, math.inf)] + [(None, 1.0), (None, 2.0)]
    rows = [(i, g, v, "kept") for i, (g, v) in enumerate(values)]
    out = {r["_run"]: r for r in runs.prior_among_others(spark.createDataFrame(rows, "_run long, total string, v double, near string"), "total", "v").collect()}
    assert len(out) == len(rows) and all(r["near"] == "kept" for r in out.values())
    good = lambda g, v: g is not None and v is not None and 0 < v < math.inf
    for i, g, v, _ in rows:
        want = prior(v, [y for j, h, y, _ in rows if j != i and h == g and good(h, y)]) if good(g, v) else (0.0, None)
        assert out[i]["prior"] == pytest.approx(want[0], abs=1e-12), (g, v)
        assert out[i]["nearest"] == (None if want[1] is None else pytest.approx(want[1], rel=1e-12)), (g, v)


def test_prior_of_nothing(spark):
    assert runs.prior_among_others(spark.createDataFrame([], "g string, v double"), "g", "v").collect() == []
