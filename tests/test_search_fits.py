"""Tree search, kernel parameters, the many-start fit, sketches, streams that stop and go on: each against a plain version."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.operators import resampling, search_space, sketches
from siltstone.plans import stream_queries
from siltstone.streaming import logs


def stepper():
    moves = np.array([(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0), (0.5, 0.5)])
    return lambda states: states[:, None, :] + moves[None]  # a closure travels to the workers, this module does not


steps = stepper()


def plain_tree(key, root, score, iterations):
    """One tree, node by node."""
    nodes = [{"parent": None, "kids": [], "visits": 0, "value": 0.0, "state": np.array(root, float)}]
    for i in range(iterations):
        at = 0
        while nodes[at]["kids"]:
            fresh = [k for k in nodes[at]["kids"] if not nodes[k]["visits"]]
            if fresh:
                at = fresh[0]
                break
            up = nodes[at]
            at = max(up["kids"], key=lambda k: nodes[k]["value"] / nodes[k]["visits"] + math.sqrt(2) * math.sqrt(math.log(up["visits"] + 1) / nodes[k]["visits"]))
        if not nodes[at]["kids"] and (nodes[at]["visits"] or at == 0):
            for s in steps(nodes[at]["state"][None])[0]:
                nodes[at]["kids"].append(len(nodes))
                nodes.append({"parent": at, "kids": [], "visits": 0, "value": 0.0, "state": s})
            kids = nodes[at]["kids"]
            at = kids[int(search_space.mixed(np.array([key]), i)[0] % np.uint64(len(kids)))]
        s = score(nodes[at]["state"])
        while at is not None:
            nodes[at]["visits"] += 1
            nodes[at]["value"] += s
            at = nodes[at]["parent"]
    return nodes


def test_trees_equal_plain_ones(spark):
    hyps = spark.range(0, 300).select(F.col("id").alias("h"), (F.col("id") % 7).cast("double").alias("goal"))

    def score(rows, states):
        return 1 / (1 + (states[:, 0] - rows["goal"].to_numpy()) ** 2 + states[:, 1] ** 2)

    for seed in (0, 5):
        got = search_space.tree_search(hyps, "h", ["a", "b"], [0.0, 0.0], steps, score, 60, seed).toPandas()
        keys = {r["h"]: r["k"] for r in hyps.select("h", F.xxhash64(F.lit(seed), "h").alias("k")).collect()}
        for h in (0, 1, 6, 130, 299):
            goal = float(h % 7)
            want = plain_tree(keys[h], [0, 0], lambda s, goal=goal: 1 / (1 + (s[0] - goal) ** 2 + s[1] ** 2), 60)
            mine = got[got["h"] == h].set_index("node")
            assert {n: int(v) for n, v in mine["visits"].items()} == {k: n["visits"] for k, n in enumerate(want) if n["visits"]}
            assert all(abs(mine["value"][k] - n["value"] / n["visits"]) < 1e-9 and tuple(n["state"]) == (mine["a"][k], mine["b"][k]) for k, n in enumerate(want) if n["visits"])
            top = max(want[0]["kids"], key=lambda k: want[k]["value"] / max(want[k]["visits"], 1))
            assert mine.index[mine["best"]].tolist() == [top]
    assert search_space.tree_search(hyps.limit(0), "h", ["a", "b"], [0.0, 0.0], steps, score, 5).count() == 0


def grid_parameters(x, y):
    squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    return min(search_space.gp_likelihood(squared, y, np.log([length, noise]))[0] for length in np.geomspace(0.05, 5, 9) for noise in np.geomspace(1e-8, 1, 9))


def test_kernel_parameters_are_no_worse_than_a_grid():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        n, d = int(rng.integers(3, 35)), int(rng.integers(1, 4))
        x = rng.random((n, d))
        y = np.sin(x.sum(1) * rng.uniform(1, 9)) + rng.normal(0, rng.choice([0.001, 0.1, 1.0]), n)
        y = (y - y.mean()) / (y.std() or 1)
        length, noise = search_space.gp_parameters(x, y)
        assert 0.05 - 1e-9 <= length <= 5 + 1e-9 and 1e-8 * 0.999 <= noise <= 1 + 1e-9
        squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
        assert search_space.gp_likelihood(squared, y, np.log([length, noise]))[0] <= grid_parameters(x, y) + 1e-4, seed
        slope = search_space.gp_likelihood(squared, y, np.log([0.3, 0.01]))[1]
        for k in range(2):
            e = np.eye(2)[k] * 1e-5
            up, down = (search_space.gp_likelihood(squared, y, np.log([0.3, 0.01]) + s * e)[0] for s in (1, -1))
            assert abs((up - down) / 2e-5 - slope[k]) < 1e-3 * max(1, abs(slope[k]))
    assert search_space.gp_parameters(np.zeros((2, 1)), np.zeros(2)) == (0.5, 1e-6)


def slack(t, e0, s, theta):
    return e0 - s * 8.617333262e-5 * theta * 2 / np.expm1(np.minimum(theta / t, 700))


def test_slack_from_many_starts(spark):
    rng = np.random.default_rng(3)
    frames = []
    for g, (e0, s, theta, noise) in enumerate([(1.5, 2.0, 250.0, 0), (3.4, 8.0, 900.0, 0), (1.1, 1.2, 60.0, 0), (2.0, 3.0, 400.0, 0.01), (1.0, 1.0, 1500.0, 0.02)]):
        t = np.repeat(np.linspace(20, 900, 18), 2)
        frames.append(pd.DataFrame({"g": g, "t": t, "e": slack(t, e0, s, theta) + rng.normal(0, noise, len(t)) if noise else slack(t, e0, s, theta)}))
    frames.append(pd.DataFrame({"g": 7, "t": [100.0, 200.0, 300.0, 400.0], "e": [1.0] * 4}))
    frames.append(pd.DataFrame({"g": 8, "t": [100.0, 200.0, -5.0, 0.0], "e": [1.0, 2.0, 3.0, 4.0]}))
    every = pd.concat(frames)
    got = {r["g"]: r for r in resampling.slack_fit(spark.createDataFrame(every, "g long, t double, e double"), "g", "t", "e").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 7} and got[7]["r2"] == 1
    for g, (e0, s, theta) in enumerate([(1.5, 2.0, 250.0), (3.4, 8.0, 900.0), (1.1, 1.2, 60.0)]):
        assert abs(got[g]["theta"] / theta - 1) < 1e-3 and abs(got[g]["s"] / s - 1) < 1e-3 and abs(got[g]["e0"] - e0) < 1e-5 and got[g]["r2"] > 1 - 1e-9
    for g in (3, 4):  # no theta of a fine grid, with its best line, does better
        f = every[every["g"] == g]
        best = math.inf
        for theta in np.geomspace(5, 10000, 20000):
            u = 8.617333262e-5 * theta * 2 / np.expm1(np.minimum(theta / f["t"].to_numpy(), 700))
            line = np.polyfit(u, f["e"], 1) if np.ptp(u) > 1e-12 else (0, f["e"].mean())
            if -100 <= line[0] <= -1e-9:
                best = min(best, float(((f["e"] - np.polyval(line, u)) ** 2).sum()))
        assert got[g]["rmse"] ** 2 * len(f) <= best * (1 + 1e-6) + 1e-12
    assert resampling.slack_fit(spark.createDataFrame(every.head(0), "g long, t double, e double"), "g", "t", "e").count() == 0


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(0, 60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 4001).alias("who"), (F.col("id") % 997).cast("double").alias("v"))
    slices = sketches.sliced(rows.unionByName(spark.createDataFrame([(3, None, None), (99, None, None)], "day long, who long, v double")), ["day"], "who", "v")
    one = sketches.merged(slices.where("day <> 99"), []).select(sketches.distinct().alias("n"), sketches.quantile(0.5).alias("mid"), "n").collect()[0]
    assert abs(one[0] - 4001) <= 4001 * sketches.DISTINCT_ERROR and abs(one["mid"] / 997 - 0.5) <= sketches.RANK_ERROR + 2 / 997 and one[2] == 60_001
    weeks = sketches.merged(slices, [F.expr("day div 7").alias("week")])
    assert weeks.count() == 6 and slices.where("day = 99").select(sketches.distinct()).first()[0] in (None, 0)


def plain_active(rows, pause):
    last, total = {}, {}
    for _, t, u in sorted((t is not None, t, u) for _, t, u in rows if t is not None):
        gap = (t - last[u]).total_seconds() if u in last else None
        total[u] = total.get(u, 0) + (int(gap * 1_000_000) if gap is not None and gap <= pause else 0)
        last[u] = t
    return total


@pytest.mark.parametrize("cuts", [[20], [7, 13, 20]])
def test_resumed_stream_equals_one_run(spark, tmp_path, cuts):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i == 11 else start + timedelta(minutes=(i * i) % 47 + 40 * i), i % 3) for i in range(20)]
    done = 0
    for end in cuts:
        spark.createDataFrame(rows[done:end], "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = end
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(str(tmp_path / "in"))
        got = stream_queries.drained(logs.accrued(stream, pause=7200), "update", str(tmp_path / "top"))
    final = {r["run"]: r["r"]["active"] for r in got.groupBy("run").agg(F.max_by(F.struct("active", "n"), "_batch").alias("r")).collect()}
    assert final == plain_active(rows, 7200)


def test_joined_streams_wait_for_each_other(spark, tmp_path):
    a = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (None, datetime(2024, 1, 2)), (3, None)], "k long, ts timestamp")
    b = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 30)), (1, datetime(2024, 1, 1, 0, 40)), (1, datetime(2024, 1, 1, 3)), (2, datetime(2024, 1, 1)), (3, datetime(2024, 1, 1))], "k long, ts timestamp")
    for name, frame in (("a", a), ("b", b)):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / name))
    got = stream_queries.drained(logs.durations(read("a"), read("b"), "k", "1 hour"), "append", str(tmp_path / "top"))
    assert sorted((r["k"], r["seconds"]) for r in got.collect()) == [(1, 1800.0), (1, 2400.0)]
