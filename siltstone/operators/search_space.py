"""Search over a parameter space: grids, random search, Gaussian-process search, tree search.

A grid or a random sample is rows, so scoring it is one projection.  A
sequential search is one Python task per (hypothesis, seed): groups of a few
rows, spread over the cluster by applyInPandas.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """B5's candidates: the product of short literal axes."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'double'}")))
    return out


def best_of(candidates: DataFrame, keys: list[str], score: Column, order: list[Column]) -> DataFrame:
    """The best candidate of each key; ties by order."""
    rest = [c for c in candidates.columns if c not in keys]
    scored = candidates.withColumn("score", score)
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("score", *rest), F.struct(F.col("score"), *order)).alias("b"))
    return best.select(*keys, "b.*")


def random_search(hypotheses: DataFrame, bounds: dict[str, tuple[float, float]], score: Callable[[dict[str, Column]], Column], budget: int, seed: int) -> DataFrame:
    """``budget`` uniform draws per hypothesis (hash of hypothesis, draw and name: the same on every run), best score."""
    draws = hypotheses.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    for name, (lo, hi) in bounds.items():
        key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in hypotheses.columns], F.col("draw").cast("string"), F.lit(f"{seed}:{name}")))
        unit = F.conv(F.left(key, F.lit(7)), 16, 10).cast("long") / float(1 << 28)
        draws = draws.withColumn(name, lo + unit * (hi - lo))
    return draws.withColumn("score", score({n: F.col(n) for n in bounds}))


def gp_posterior(x: np.ndarray, y: np.ndarray, new: np.ndarray, length: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """B2: mean and deviation of an RBF Gaussian process at the rows of ``new``."""
    k = lambda a, b: np.exp(-0.5 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / length**2)
    gram = k(x, x) + (noise + 1e-10) * np.eye(len(x))
    try:
        low = np.linalg.cholesky(gram)
        inverse = np.linalg.solve(low.T, np.linalg.solve(low, np.eye(len(x))))
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(gram)
    cross = k(new, x)
    return cross @ inverse @ y, np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", cross, inverse, cross), 1e-12))


#: Bounds of length and noise, the starts of the length and of the noise.
LENGTHS, NOISES, STARTS, START_NOISE = (0.05, 5.0), (1e-8, 1.0), (0.5, 0.2, 1.0), 1e-3


def gp_likelihood(squared: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of a Gaussian process at (log length, log noise), and its gradient; ``squared``: squared distances."""
    length, noise = np.exp(theta)
    bell = np.exp(-0.5 * squared / length**2)
    try:
        low = np.linalg.cholesky(bell + noise * np.eye(len(y)))
    except np.linalg.LinAlgError:
        return 1e12, np.zeros(2)
    inverse = np.linalg.inv(bell + noise * np.eye(len(y)))
    alpha = inverse @ y
    slope = inverse - np.outer(alpha, alpha)
    value = 0.5 * float(y @ alpha) + float(np.log(np.diag(low)).sum()) + 0.5 * len(y) * math.log(2 * math.pi)
    return value, 0.5 * np.array([float((slope * bell * squared).sum()) / length**2, noise * float(np.trace(slope))])


def bounded_lbfgs(value_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 200, memory: int = 8) -> tuple[np.ndarray, float]:
    """Least value within bounds: limited-memory quasi-Newton directions over the coordinates that a bound does not hold, steps cut at the bounds and halved until they lower the value enough."""
    x = np.clip(start, low, high)
    value, slope = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if not free.any() or np.abs(slope[free]).max() < 1e-5:
            break
        direction, told = np.where(free, slope, 0.0), []
        for s, d in reversed(past):
            a = float(s @ direction) / float(s @ d)
            told.append(a)
            direction = direction - a * d
        if past:
            s, d = past[-1]
            direction = direction * (float(s @ d) / float(d @ d))
        for (s, d), a in zip(past, reversed(told), strict=True):
            direction = direction + (a - float(d @ direction) / float(s @ d)) * s
        direction = -np.where(free, direction, 0.0)
        if float(direction @ slope) >= 0:
            direction, past = -np.where(free, slope, 0.0), []
        step = 1.0 if past else min(1.0, 1.0 / float(np.abs(direction).max()))
        while step > 1e-12:
            new = np.clip(x + step * direction, low, high)
            new_value, new_slope = value_and_slope(new)
            if new_value <= value + 1e-4 * float(slope @ (new - x)):
                break
            step /= 2
        else:
            break
        s, d = new - x, new_slope - slope
        if float(s @ d) > 1e-12:
            past = [*past[-(memory - 1) :], (s, d)]
        gained, x, value, slope = value - new_value, new, new_value, new_slope
        if gained < 1e-9 * max(1.0, abs(value)):
            break
    return x, value


def gp_parameters(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Length and noise of the greatest likelihood within bounds, from three starts in log space; (0.5, 1e-6) for fewer than three points."""
    if len(y) < 3:
        return 0.5, 1e-6
    squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    low, high = np.log([LENGTHS[0], NOISES[0]]), np.log([LENGTHS[1], NOISES[1]])
    found = [bounded_lbfgs(lambda t: gp_likelihood(squared, y, t), np.log([s, START_NOISE]), low, high) for s in STARTS]
    best = min(found, key=lambda f: f[1])[0]
    return float(np.exp(best[0])), float(np.exp(best[1]))


def in_regions(x: np.ndarray, regions: list[tuple[int, float, float]]) -> np.ndarray:
    """Whether each row lies in all of the regions (axis, lo, hi)."""
    out = np.ones(len(x), bool)
    for axis, lo, hi in regions:
        out &= (x[:, axis] >= lo) & (x[:, axis] <= hi)
    return out


def bayesian_search(score: Callable[[np.ndarray], float], bounds: list[tuple[float, float]], seed: int, iterations: int = 30, initial: int = 10, candidates: int = 100, pruned: list = (), focus: list = ()) -> list[dict]:
    """Random start, then the candidate of greatest upper confidence bound; a log row per evaluation."""
    rng = np.random.default_rng(seed)
    lo, hi = (np.array([b[k] for b in bounds], float) for k in (0, 1))
    span = np.where(hi > lo, hi - lo, 1.0)
    x = rng.random((initial, len(bounds)))
    y = np.array([score(lo + v * span) for v in x])
    log = [{"iteration": i, "score": float(s), "best_score": float(y[: i + 1].max())} for i, s in enumerate(y)]
    for i in range(iterations):
        sd = y.std() or 1.0
        length, noise = gp_parameters(x, (y - y.mean()) / sd)
        new = rng.random((candidates, len(bounds)))
        for region, wanted in ((pruned, False), (focus, True)):
            if region:
                keep = in_regions(lo + new * span, region) == wanted
                new = new[keep] if keep.any() else new
        mean, deviation = gp_posterior(x, (y - y.mean()) / sd, new, length, noise)
        pick = new[int(np.argmax(mean + max(0.5, 2 * (1 - i / 100)) * deviation))]
        x, y = np.vstack([x, pick]), np.append(y, score(lo + pick * span))
        log.append({"iteration": initial + i, "score": float(y[-1]), "best_score": float(y.max())})
    return log


def search_all(hypotheses: DataFrame, seeds: int, score_of: Callable[[pd.Series], Callable[[np.ndarray], float]], bounds: list[tuple[float, float]], **options) -> DataFrame:
    """Bayesian search for every (hypothesis, seed), one Python task each; hypotheses has a column ``hypothesis``."""
    tasks = hypotheses.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        log = pd.DataFrame(bayesian_search(score_of(row), bounds, int(row["seed"]), **options))
        return log.assign(hypothesis=row["hypothesis"], seed=int(row["seed"]))[["hypothesis", "seed", "iteration", "score", "best_score"]]

    kind = hypotheses.schema["hypothesis"].dataType.simpleString()
    # A stated number of parts: adaptive execution would merge so few rows into one task, however long each of them runs.
    tasks = tasks.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism, "hypothesis", "seed")
    return tasks.groupBy("hypothesis", "seed").applyInPandas(run, f"hypothesis {kind}, seed int, iteration int, score double, best_score double")


def verdict(bayesian: Column, random: Column, scale: float = 1.0) -> Column:
    """By the difference of the medians; ``scale``: how many times larger than shares both are."""
    d = bayesian - random
    return F.when(d >= 0.008 * scale, "bayesian_wins").when(d <= -0.003 * scale, "random_wins").otherwise("parity")


#: Hypotheses whose trees a task holds at once.
TREES = 128


def mixed(key: np.ndarray, number: int) -> np.ndarray:
    """64 well-mixed bits of each key and a number: the same draw on every run."""
    z = key.astype(np.uint64) + np.uint64((number * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def grow_trees(keys: np.ndarray, root: np.ndarray, children: Callable[[np.ndarray], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray], iterations: int) -> dict[str, np.ndarray]:
    """B5 for many hypotheses at once: a node table (hypothesis by node) of parent, first child, visits, value and state.

    A round selects in every tree (the first unvisited child, else the one of
    greatest upper confidence bound, constant sqrt 2, down to a leaf), expands
    leaves that were visited and the root, scores one state per tree and adds
    the score to all nodes above it.  ``children``: states (m, d) to (m, k, d);
    ``score``: numbers of hypotheses and states to scores.
    """
    n, k = len(keys), children(root[None]).shape[1]
    size = 1 + k * iterations
    parent, first = np.full((n, size), -1), np.full((n, size), -1)
    visits, value, state = np.zeros((n, size), np.int64), np.zeros((n, size)), np.zeros((n, size, len(root)))
    state[:, 0], used, every = root, np.ones(n, np.int64), np.arange(n)
    for i in range(iterations):
        at, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        while (open_ := open_ & (first[every, at] >= 0)).any():
            h = np.flatnonzero(open_)
            kids = first[h, at[h]][:, None] + np.arange(k)
            seen = visits[h[:, None], kids]
            bound = value[h[:, None], kids] / np.maximum(seen, 1) + math.sqrt(2) * np.sqrt(np.log(visits[h, at[h]] + 1)[:, None] / np.maximum(seen, 1))
            new = seen == 0
            at[h] = kids[np.arange(len(h)), np.where(new.any(1), new.argmax(1), bound.argmax(1))]
            open_[h[new.any(1)]] = False
        grown = np.flatnonzero((first[every, at] < 0) & ((visits[every, at] > 0) | (at == 0)))
        kids = used[grown][:, None] + np.arange(k)
        first[grown, at[grown]], parent[grown[:, None], kids] = used[grown], at[grown][:, None]
        state[grown[:, None], kids] = children(state[grown, at[grown]])
        used[grown] += k
        at[grown] = kids[np.arange(len(grown)), (mixed(keys[grown], i) % np.uint64(k)).astype(np.int64)]
        gained, up = score(every, state[every, at]), at
        while (up >= 0).any():
            h = np.flatnonzero(up >= 0)
            visits[h, up[h]] += 1
            value[h, up[h]] += gained[h]
            up = np.where(up >= 0, parent[every, np.maximum(up, 0)], -1)
    return {"parent": parent, "visits": visits, "value": value, "state": state}


def tree_search(hypotheses: DataFrame, key: str, axes: list[str], root: list[float], children: Callable[[np.ndarray], np.ndarray], score: Callable[[pd.DataFrame, np.ndarray], np.ndarray], iterations: int, seed: int = 0) -> DataFrame:
    """The visited nodes of every hypothesis's tree: key, node, parent, state, visits, value (a mean), best (the root's best child).

    A row of ``hypotheses`` is a search of its own; rows are dealt over tasks,
    and a task grows TREES trees in each round.  ``score`` gets the rows of its
    hypotheses, one for each state.
    """
    rows = hypotheses.withColumn("_key", F.xxhash64(F.lit(seed), key))
    kind = hypotheses.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), TREES):
                part = frame.iloc[i : i + TREES].reset_index(drop=True)
                t = grow_trees(part["_key"].to_numpy(), np.array(root, float), children, lambda h, s, part=part: score(part.iloc[h], s), iterations)
                h, node = np.nonzero(t["visits"])
                mean = t["value"] / np.maximum(t["visits"], 1)
                top = np.where(t["parent"] == 0, mean, -np.inf).argmax(1)
                out = {key: part[key].to_numpy()[h], "node": node, "parent": t["parent"][h, node], **{a: t["state"][h, node, d] for d, a in enumerate(axes)}}
                yield pd.DataFrame(out | {"visits": t["visits"][h, node], "value": mean[h, node], "best": node == top[h]})

    schema = f"{key} {kind}, node int, parent int, {', '.join(f'{a} double' for a in axes)}, visits long, value double, best boolean"
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_key").mapInPandas(run, schema)


def top_visited(nodes: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The most visited nodes (node, visits, value) of each search with their mean value."""
    from .resolve import capped

    best = capped(nodes, keys, [F.col("visits").desc(), F.col("node")], n)
    return best.select(*keys, "node", "visits", (F.col("value") / F.greatest("visits", F.lit(1))).alias("value"))
