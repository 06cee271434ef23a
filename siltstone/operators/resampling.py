"""Resampling, grid fits and verdicts for small groups of points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .resolve import capped
from .stats import f_tail


def _r2(y: np.ndarray, guess: np.ndarray) -> float:
    total = float(((y - y.mean()) ** 2).sum())
    sse = float(((y - guess) ** 2).sum())
    return 1 - sse / total if total > 0 else float(sse <= 1e-12)


def bootstrap(points: DataFrame, key: str, x: str, y: str, n_boot: int = 500, seed: int = 42) -> DataFrame:
    """Intervals of a line's slope and r2 (on the original points) and of the gain of a parabola, one Python task per group.

    Groups are the measured points of one hypothesis.  Fewer than
    max(20, half) good resamples give nulls.
    """
    kind = points.schema[key].dataType.simpleString()
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y"])
        a, b, rng, slopes, r2s, gains = f["x"].to_numpy(), f["y"].to_numpy(), np.random.default_rng(seed), [], [], []
        for _ in range(n_boot):
            i = rng.integers(0, len(a), len(a))
            if len(np.unique(a[i])) < 2:
                continue
            line = np.polyfit(a[i], b[i], 1)
            slopes.append(line[0])
            r2s.append(_r2(b, np.polyval(line, a)))
            if len(np.unique(a[i])) >= 3:
                gains.append(_r2(b[i], np.polyval(np.polyfit(a[i], b[i], 2), a[i])) - _r2(b[i], np.polyval(line, a[i])))
        enough = len(slopes) >= max(20, n_boot // 2)
        out = {key: f[key].iloc[0], "n": len(a), "n_ok": len(slopes)}
        for name, values in (("slope", slopes), ("r2", r2s), ("gain", gains)):
            low, mid, high = np.percentile(values, [2.5, 50, 97.5]) if enough and values else (None, None, None)
            out |= {f"{name}_low": low, f"{name}_median": mid, f"{name}_high": high}
        return pd.DataFrame([out])

    columns = ", ".join(f"{n}_{s} double" for n in ("slope", "r2", "gain") for s in ("low", "median", "high"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, n int, n_ok int, {columns}")


def slack_model(t: Column, e0: Column, s: Column, theta: Column) -> Column:
    """e0 - s k (theta coth(theta / 2T) - theta); k in eV per kelvin."""
    ratio = F.least(theta / (2 * t), F.lit(350.0))
    return e0 - s * 8.617333262e-5 * theta * (1 / F.tanh(ratio) - 1)


def slack_grid(points: DataFrame, key: str, t: str, e: str, thetas: list[float]) -> DataFrame:
    """R7's grid fit: for each theta of a literal list the model is a line in its coth term, so e0 and s are closed forms; the least error wins."""
    spark = points.sparkSession
    grid = F.broadcast(spark.createDataFrame([(v,) for v in thetas], "theta double"))  # the literal list
    term = F.col("theta") * (1 / F.tanh(F.least(F.col("theta") / (2 * F.col(t).cast("double")), F.lit(350.0))) - 1) * 8.617333262e-5
    rows = points.where(F.col(t) > 0).crossJoin(grid).withColumn("_u", term)
    y = F.col(e).cast("double")
    g = rows.groupBy(key, "theta").agg(F.regr_slope(y, F.col("_u")).alias("b"), F.regr_intercept(y, F.col("_u")).alias("e0"), F.regr_r2(y, F.col("_u")).alias("r2"))
    best = g.where("r2 is not null").groupBy(key).agg(F.max_by(F.struct("theta", "e0", (-F.col("b")).alias("s"), "r2"), F.struct("r2", -F.col("theta"))).alias("b"))
    return best.select(key, "b.*")


#: Bounds of theta and of the coupling; how many starts are followed, and how many thetas a bracket gets in a round.
THETA_BOUNDS, COUPLING_BOUNDS, STARTS, RUNGS = (5.0, 10000.0), (1e-9, 100.0), 4, 17

#: Rows of temperatures and thetas that a task of a round makes.
TASK_ROWS = 1 << 24


def _slack_errors(sums: DataFrame, tried: DataFrame, tasks: int) -> DataFrame:
    """_key, start, theta, e0, s, sse of every theta tried: e0 and s from the normal equations, which are grouped sums.

    ``sums`` has a row for each temperature of a group: t, n, sum and sum of
    squares of energies less the group's mean.
    """
    u = F.col("theta") / F.col("t")
    g = 8.617333262e-5 * F.col("theta") * F.when(u > 700, 0.0).otherwise(2 / F.expm1(F.least(u, F.lit(700.0))))
    rows = sums.repartition(tasks, "_key").join(tried.repartition(tasks, "_key"), "_key").withColumn("g", g)
    total = rows.groupBy("_key", "start", "theta").agg(
        F.sum("n").alias("n"), F.sum("sy").alias("y"), F.sum("syy").alias("yy"), F.sum(F.col("n") * F.col("g")).alias("g"), F.sum(F.col("n") * F.col("g") ** 2).alias("gg"), F.sum(F.col("sy") * F.col("g")).alias("yg")
    )
    n, y, yy, sg, gg, yg = (F.col(c) for c in ("n", "y", "yy", "g", "gg", "yg"))
    spread = gg - sg * sg / n
    free = F.when(spread > 1e-18, -(yg - sg * y / n) / spread).otherwise(COUPLING_BOUNDS[0])
    solved = total.withColumn("s", F.greatest(F.least(free, F.lit(COUPLING_BOUNDS[1])), F.lit(COUPLING_BOUNDS[0]))).withColumn("e0", (y + F.col("s") * sg) / n)
    e0, s = F.col("e0"), F.col("s")
    sse = yy - 2 * e0 * y + 2 * s * yg + n * e0 * e0 - 2 * e0 * s * sg + s * s * gg
    return solved.select("_key", "start", "theta", "n", "yy", "e0", "s", F.greatest(sse, F.lit(0.0)).alias("sse"))


def slack_fit(points: DataFrame, key: str, t: str, e: str, rounds: int = 9, least: int = 4) -> DataFrame:
    """e0, s, theta, r2, rmse, n of each group, from several starts, all groups and starts in each round.

    For a given theta the model is linear, so a theta is tried by a sum over the
    group.  A first round tries 120 of them (the fallback grid's number) between
    the bounds; the best STARTS local minima are brackets, each round tries RUNGS
    thetas inside every bracket and keeps the two beside the best.  Points of
    one temperature are added up once, before the rounds.  Groups with fewer
    than ``least`` points or no temperature above zero give no row; constant
    energies have r2 1.
    """
    rows = points.select(F.col(key).alias("_key"), F.col(t).cast("double").alias("t"), F.col(e).cast("double").alias("e")).where("t > 0 AND e IS NOT NULL")
    means = rows.groupBy("_key").agg(F.avg("e").alias("_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    y = F.col("e") - F.col("_mean")
    sums = cut(rows.join(means, "_key").groupBy("_key", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))
    # Every temperature of a group becomes a row for each theta: tasks follow from those rows, not from the few bytes before.
    rungs = max(120, STARTS * RUNGS)
    tasks = int(min(max(sums.count() * rungs / TASK_ROWS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000))
    low, high = (math.log(x) for x in THETA_BOUNDS)
    width = (high - low) / 119
    ladder = F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.exp(F.lit(low) + i * width)))
    first = _slack_errors(sums, means.select("_key", F.lit(0).alias("start"), ladder.alias("theta")), tasks)
    w = Window.partitionBy("_key").orderBy("theta")
    bottoms = first.withColumns({"_b": F.lag("sse").over(w), "_a": F.lead("sse").over(w)}).where("(_b IS NULL OR sse <= _b) AND (_a IS NULL OR sse <= _a)")
    best = capped(bottoms, ["_key"], [F.col("sse"), F.col("theta")], STARTS)
    brackets = cut(best.select("_key", F.row_number().over(Window.partitionBy("_key").orderBy("sse", "theta")).alias("start"), F.log("theta").alias("at"), F.lit(width).alias("half")))
    for _ in range(rounds):
        rung = F.explode(F.transform(F.sequence(F.lit(0), F.lit(RUNGS - 1)), lambda i: F.col("at") + F.col("half") * (i * (2.0 / (RUNGS - 1)) - 1)))
        tried = brackets.select("_key", "start", "half", rung.alias("at")).where(F.col("at").between(low - 1e-12, high + 1e-12)).withColumn("theta", F.exp("at"))
        errors = _slack_errors(sums, tried.select("_key", "start", "theta"), tasks)
        better = errors.groupBy("_key", "start").agg(F.min_by(F.struct("theta", "e0", "s", "sse", "n", "yy"), F.struct("sse", "theta")).alias("b"))
        width /= (RUNGS - 1) / 2
        brackets = cut(better.select("_key", "start", F.log("b.theta").alias("at"), F.lit(width).alias("half"), "b"))
    won = brackets.groupBy("_key").agg(F.min_by("b", F.struct("b.sse", "start")).alias("b")).join(means, "_key")
    r2 = F.when(F.col("b.yy") > 0, 1 - F.col("b.sse") / F.col("b.yy")).otherwise(1.0)
    return won.select(F.col("_key").alias(key), (F.col("b.e0") + F.col("_mean")).alias("e0"), F.col("b.s").alias("s"), F.col("b.theta").alias("theta"), r2.alias("r2"), F.sqrt(F.col("b.sse") / F.col("b.n")).alias("rmse"), F.col("_n").alias("n"))


def gaussian_peak(points: DataFrame, key: str, x: str, y: str, rounds: int = 200) -> DataFrame:
    """Height, centre, width and offset of a peak, by damped least squares, one Python task per group."""
    kind = points.schema[key].dataType.simpleString()
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")

    def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        best, best_sse = np.zeros(4), math.inf
        for width in (np.ptp(a) / 2, np.ptp(a) / 4, np.ptp(a) / 8):
            p, damp = np.array([b.max() - b.min(), a[b.argmax()], max(width, 1e-6), b.min()]), 1e-2
            model = lambda q: q[3] + q[0] * np.exp(-0.5 * ((a - q[1]) / q[2]) ** 2)
            sse = float(((b - model(p)) ** 2).sum())
            for _ in range(rounds):
                z = (a - p[1]) / p[2]
                bell = np.exp(-0.5 * z**2)
                jacobian = np.stack([bell, p[0] * bell * z / p[2], p[0] * bell * z**2 / p[2], np.ones_like(a)], 1)
                normal = jacobian.T @ jacobian
                step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), jacobian.T @ (b - model(p)), rcond=None)[0]
                trial = p + step
                e = float(((b - model(trial)) ** 2).sum()) if abs(trial[2]) > 1e-9 else math.inf
                p, sse, damp = (trial, e, damp / 3) if e < sse else (p, sse, damp * 4)
                if damp > 1e12:
                    break
            if sse < best_sse:
                best, best_sse = p, sse
        return best, best_sse

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["x", "y"])
        a, b = f["x"].to_numpy(), f["y"].to_numpy()
        p, sse = fit(a, b) if len(a) >= 4 else (np.full(4, np.nan), math.nan)
        total = float(((b - b.mean()) ** 2).sum())
        return pd.DataFrame([{key: f[key].iloc[0], "height": p[0], "centre": p[1], "width": abs(p[2]), "offset": p[3], "r2": 1 - sse / total if total else 0.0, "rmse": math.sqrt(sse / len(a))}])

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, height double, centre double, width double, offset double, r2 double, rmse double")


def f_test(rows: DataFrame, f: str, d1: str, d2: str, name: str = "p") -> DataFrame:
    """Tail probability of F for a small result table."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(frames):
        for t in frames:
            yield t.assign(**{name: [None if a is None or a != a else f_tail(a, b, c) for a, b, c in zip(t[f], t[d1], t[d2], strict=True)]})

    return rows.mapInPandas(run, schema)


def model_verdict(best_r2: Column, classic_r2: Column, f_supported: Column, ci_low: Column) -> Column:
    """Worse below -0.02, better from 0.05 with the F test or the interval behind it, possible without, else no improvement."""
    d = best_r2 - classic_r2
    backed = F.coalesce(f_supported, F.lit(False)) | F.coalesce(ci_low > classic_r2, F.lit(False))
    return (
        F.when(d.isNull() | F.isnan(d), "insufficient").when(d < -0.02, "candidate_worse").when((d >= 0.05) & backed, "candidate_better").when(d >= 0.05, "candidate_possible").otherwise("no_improvement")
    )
