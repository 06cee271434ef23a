"""Model fitting and statistics as closed forms over grouped sums.

Every fit is one aggregate per group: moments are summed map-side, so a hot
group is no hot task.  x is centred by the group's mean (a second aggregate,
joined back on the small table of groups) before powers are summed.  Degenerate
groups give null, never an error.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def r_squared(sse: Column, syy: Column) -> Column:
    """1 - SSE / Syy; of a constant y 1 if it is met, else 0."""
    return F.when(syy > 0, 1 - sse / syy).otherwise(F.when(sse <= 1e-12, 1.0).otherwise(0.0))


def adjusted_r2(r2: Column, n: Column, k: Column | int) -> Column:
    """R2; null without degrees of freedom."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.when(n - k > 0, 1 - (1 - r2) * (n - 1) / (n - k))


def ols(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r2, rmse of a line per group."""
    out = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(_c(y), _c(x)).alias("slope"), F.regr_intercept(_c(y), _c(x)).alias("intercept"),
        F.regr_r2(_c(y), _c(x)).alias("r2"), F.regr_syy(_c(y), _c(x)).alias("_syy"),
    )
    return out.withColumn("rmse", F.sqrt(F.greatest((1 - F.col("r2")) * F.col("_syy"), F.lit(0.0)) / F.col("n"))).drop("_syy")


def centred(points: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Adds _u = x - mean of the group and _m = that mean."""
    means = points.groupBy(*keys).agg(F.avg(_c(x)).alias("_m"))
    return points.join(means, keys).withColumn("_u", _c(x) - F.col("_m"))


def _determinant(m: list[list[Column]]) -> Column:
    """Leibniz sum; for 3 x 3 and 4 x 4 systems."""
    total = F.lit(0.0)
    for p in permutations(range(len(m))):
        sign = -1.0 if sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2 else 1.0
        term = F.lit(sign)
        for row, column in enumerate(p):
            term = term * m[row][column]
        total = total + term
    return total


def polynomial(points: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Coefficients c0..c<degree> (ascending powers of x), r2 and rmse, by normal equations in centred x."""
    sums = [F.sum(F.pow(F.col("_u"), k)).alias(f"_s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(F.col("_u"), k) * _c(y)).alias(f"_t{k}") for k in range(degree + 1)]
    g = centred(points, keys, x).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("_m").alias("_m"), F.sum(_c(y) * _c(y)).alias("_yy"), F.var_pop(_c(y)).alias("_var"), *sums, *mixed)
    if degree > 2:  # the closed form outgrows generated code; one row per group is left here
        g = _solved(g, degree)
    else:
        matrix = [[F.col(f"_s{i + j}") for j in range(degree + 1)] for i in range(degree + 1)]
        whole = F.nullif(F.when(F.col("n") > degree, _determinant(matrix)), F.lit(0.0))
        for k in range(degree + 1):
            part = [[F.col(f"_t{i}") if j == k else matrix[i][j] for j in range(degree + 1)] for i in range(degree + 1)]
            g = g.withColumn(f"_d{k}", F.try_divide(_determinant(part), whole))
    sse = F.col("_yy") - sum((F.col(f"_d{k}") * F.col(f"_t{k}") for k in range(degree + 1)), F.lit(0.0))
    g = g.withColumn("_sse", F.greatest(sse, F.lit(0.0)))
    # Expand sum d_k (x - m)^k.
    coefficients = [
        sum((F.col(f"_d{k}") * math.comb(k, j) * F.pow(-F.col("_m"), k - j) for k in range(j, degree + 1)), F.lit(0.0)).alias(f"c{j}") for j in range(degree + 1)
    ]
    return g.select(*keys, "n", *coefficients, r_squared(F.col("_sse"), F.col("_var") * F.col("n")).alias("r2"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))


def _solved(sums: DataFrame, degree: int) -> DataFrame:
    """Adds _d0.._d<degree>: the normal equations of each row, solved in batches by numpy; null where singular."""
    size = degree + 1
    schema = StructType([*sums.schema.fields, *[StructField(f"_d{k}", DoubleType()) for k in range(size)]])

    def run(frames):
        for f in frames:
            a = np.stack([np.stack([f[f"_s{i + j}"].to_numpy(float) for j in range(size)], -1) for i in range(size)], -2)
            t = np.stack([f[f"_t{k}"].to_numpy(float) for k in range(size)], -1)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))  # rows and columns to unit size before the rank test
            unit = a / scale[:, :, None] / scale[:, None, :]
            good = np.isfinite(unit).all((1, 2)) & (f["n"].to_numpy() > degree)
            good[good] = np.linalg.matrix_rank(unit[good], tol=1e-10) == size
            out = np.full((len(f), size), np.nan)
            out[good] = np.linalg.solve(unit[good], (t / scale)[good][:, :, None])[:, :, 0] / scale[good]
            yield f.assign(**{f"_d{k}": pd.Series(out[:, k], f.index).astype(object).where(good, None) for k in range(size)})

    return sums.mapInPandas(run, schema)


def transformed_fit(points: DataFrame, keys: list[str], x: str, y: str, kind: str) -> DataFrame:
    """Power a x^b, exponential a e^(b x) or logarithmic a + b ln x; r2 in the original space."""
    lx, ly = kind in ("power", "logarithmic"), kind in ("power", "exponential")
    rows = points.where((_c(x) > 0 if lx else F.lit(True)) & (_c(y) > 0 if ly else F.lit(True))).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": F.ln(_c(x)) if lx else _c(x), "_y": F.ln(_c(y)) if ly else _c(y)})
    line = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("_a"), F.avg(_c(y)).alias("_my"))
    line = line.withColumn("a", F.exp("_a") if ly else F.col("_a")).drop("_a")
    guess = {"power": F.col("a") * F.pow(_c(x), F.col("b")), "exponential": F.col("a") * F.exp(F.col("b") * _c(x)), "logarithmic": F.col("a") + F.col("b") * F.ln(_c(x))}[kind]
    err = rows.join(line, keys).withColumn("_e", _c(y) - guess)
    s = err.groupBy(*keys).agg(F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum(F.pow(_c(y) - F.col("_my"), 2)).alias("_syy"))
    return s.select(*keys, "n", "a", "b", r_squared(F.col("_sse"), F.col("_syy")).alias("r2"))


def rank_models(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Linear, quadratic, cubic, power, exponential and logarithmic fits per group, ranked by r2 (rounded to 9; then by name)."""
    fits = [ols(points, keys, x, y).select(*keys, F.lit("linear").alias("model"), "r2")]
    fits += [polynomial(points, keys, x, y, d).select(*keys, F.lit(name).alias("model"), "r2") for d, name in ((2, "quadratic"), (3, "cubic"))]
    fits += [transformed_fit(points, keys, x, y, k).select(*keys, F.lit(k).alias("model"), "r2") for k in ("power", "exponential", "logarithmic")]
    every = fits[0]
    for f in fits[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy(*keys).orderBy(F.round("r2", 9).desc(), "model")
    return every.where("r2 is not null").withColumn("rank", F.row_number().over(w))


def endpoint_line(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The line through the first and last point of each group, and its r2."""
    ends = points.groupBy(*keys).agg(
        F.min(_c(x)).alias("_x0"), F.max(_c(x)).alias("_x1"), F.min_by(_c(y), F.struct(_c(x), _c(y))).alias("_y0"), F.max_by(_c(y), F.struct(_c(x), _c(y))).alias("_y1"), F.avg(_c(y)).alias("_my")
    )
    fixed = ends.withColumn("slope", F.try_divide(F.col("_y1") - F.col("_y0"), F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0.0)))).withColumn("intercept", F.col("_y0") - F.col("slope") * F.col("_x0"))
    e = points.join(fixed, keys).withColumn("_e", _c(y) - F.col("slope") * _c(x) - F.col("intercept"))
    s = e.groupBy(*keys).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"), F.sum(F.pow(_c(y) - F.col("_my"), 2)).alias("_syy"))
    return s.select(*keys, "slope", "intercept", r_squared(F.col("_sse"), F.col("_syy")).alias("r2"))


def audit_fits(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, linear, quadratic, end_points): r2 of a line, a parabola and the mixing line of each group, for shares x in 0 .. 1.

    The mixing line goes from the y of the least x, put at 0, to the y of the greatest x, put at 1.
    """
    first, last = (f(_c(y), F.struct(_c(x), _c(y))) for f in (F.min_by, F.max_by))
    ends = points.groupBy(*keys).agg(first.alias("_y0"), last.alias("_y1"), F.avg(_c(y)).alias("_my"))
    e = _c(y) - F.col("_y0") - (F.col("_y1") - F.col("_y0")) * _c(x)
    sums = points.join(ends, keys).groupBy(*keys).agg(F.sum(e * e).alias("_sse"), F.sum(F.pow(_c(y) - F.col("_my"), 2)).alias("_syy"))
    mixed = sums.select(*keys, r_squared(F.col("_sse"), F.col("_syy")).alias("end_points"))
    fits = [classical_fit(n, points, keys, x, y).select(*keys, F.col("r2").alias(n)) for n in ("linear", "quadratic")]
    return fits[0].join(fits[1], keys).join(mixed, keys)


def _line_rows(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Each point with its group's line: _n, _sxx, _e (residual), _h (leverage), _sse."""
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct(_c(x)).alias("_nx"), F.avg(_c(x)).alias("_mx"), F.avg(_c(y)).alias("_my"), F.regr_sxx(_c(y), _c(x)).alias("_sxx"),
        F.regr_slope(_c(y), _c(x)).alias("_b"), F.regr_intercept(_c(y), _c(x)).alias("_a"), F.regr_syy(_c(y), _c(x)).alias("_syy"), F.regr_r2(_c(y), _c(x)).alias("_r2"),
    )
    rows = points.join(g, keys)
    rows = rows.withColumn("_e", _c(y) - F.col("_a") - F.col("_b") * _c(x)).withColumn("_h", 1 / F.col("_n") + F.pow(_c(x) - F.col("_mx"), 2) / F.col("_sxx"))
    return rows.withColumn("_sse", (1 - F.col("_r2")) * F.col("_syy"))


def leave_one_out(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Error of leaving each point out, from the leverages (no refit); groups of four points or more."""
    rows = _line_rows(points, keys, x, y).where("_n >= 4 and _sxx > 0").withColumn("_p", F.col("_e") / (1 - F.col("_h")))
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_p") * F.col("_p")).alias("_ss"), F.first("_syy").alias("_syy"))
    return s.select(*keys, "n", F.sqrt(F.col("_ss") / F.col("n")).alias("loo_rmse"), (1 - F.col("_ss") / F.nullif(F.col("_syy"), F.lit(0.0))).alias("loo_r2"))


def leave_group_out(points: DataFrame, keys: list[str], fold: str, x: str, y: str) -> DataFrame:
    """Each fold predicted by the line of the other folds; total minus fold moments, no self-join."""
    moments = lambda p: [
        F.count(F.lit(1)).alias(f"{p}n"), F.sum(_c(x)).alias(f"{p}x"), F.sum(_c(y)).alias(f"{p}y"), F.sum(_c(x) * _c(x)).alias(f"{p}xx"), F.sum(_c(x) * _c(y)).alias(f"{p}xy"), F.sum(_c(y) * _c(y)).alias(f"{p}yy"),
    ]
    part = points.groupBy(*keys, fold).agg(*moments("f"))
    whole = part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_folds"), *[F.sum(f"f{k}").alias(f"t{k}") for k in ("n", "x", "y", "xx", "xy", "yy")])
    g = part.join(whole, keys)
    d = lambda k: F.col(f"t{k}") - F.col(f"f{k}")
    sxx = d("xx") - d("x") * d("x") / d("n")
    g = g.where("_folds >= 2").where(d("n") >= 3).withColumn("_sxx", sxx).where("_sxx > 1e-12")
    g = g.withColumn("_b", (d("xy") - d("x") * d("y") / d("n")) / F.col("_sxx")).withColumn("_a", (d("y") - F.col("_b") * d("x")) / d("n"))
    a, b = F.col("_a"), F.col("_b")
    sse = F.col("fyy") - 2 * a * F.col("fy") - 2 * b * F.col("fxy") + F.col("fn") * a * a + 2 * a * b * F.col("fx") + b * b * F.col("fxx")
    return g.select(*keys, fold, F.col("fn").alias("n"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("fn")).alias("fold_rmse"))


def cooks_distance(points: DataFrame, keys: list[str], x: str, y: str, textbook: bool = False) -> DataFrame:
    """Leverage, distance and whether it exceeds 4 / n; divided by 1 - h, or by its square with ``textbook``."""
    rows = _line_rows(points, keys, x, y).where("_n >= 4 and _nx >= 3")
    mse = F.when(F.col("_sse") > 0, F.col("_sse") / (F.col("_n") - 2)).otherwise(1.0)
    left = 1 - F.col("_h") + 1e-12
    d = F.col("_e") * F.col("_e") / (2 * mse) * F.col("_h") / (left * left if textbook else left)
    return rows.select(*points.columns, F.col("_h").alias("leverage"), d.alias("cook")).join(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys).withColumn("influential", F.col("cook") > 4 / F.col("_n")).drop("_n")


def tiered(points: DataFrame, keys: list[str], tier: str, x: str, y: str) -> DataFrame:
    """A line per tier with three points and three distinct x or more."""
    gate = points.groupBy(*keys, tier).agg(F.countDistinct(_c(x)).alias("_nx"))
    return ols(points, [*keys, tier], x, y).join(gate.where("_nx >= 3"), [*keys, tier]).where("n >= 3").drop("_nx")


def nested_f(n: Column, rss_r: Column, k_r: int, rss_f: Column, k_f: int) -> Column:
    """F of a restricted and a full model; null without degrees of freedom."""
    f = ((rss_r - rss_f) / (k_f - k_r)) / (rss_f / (n - k_f))
    return F.when((n > k_f) & (rss_f > 0), F.greatest(f, F.lit(0.0)))


def bayes_line(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Conjugate line per group from seven sums: posterior mean, scale and degrees of freedom.

    Prior: mean (slope 0, intercept mean of y), independent variances
    (20 sy / sx)^2 and (20 sy)^2 with population deviations (0 counts as 1),
    shape 2, rate sy^2 / 2.
    """
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_c(x)).alias("_x"), F.sum(_c(y)).alias("_y"), F.sum(_c(x) * _c(x)).alias("_xx"), F.sum(_c(x) * _c(y)).alias("_xy"),
        F.sum(_c(y) * _c(y)).alias("_yy"), F.stddev_pop(_c(x)).alias("_dx"), F.stddev_pop(_c(y)).alias("_dy"),
    )
    sx, sy = (F.when(F.col(d) > 0, F.col(d)).otherwise(1.0) for d in ("_dx", "_dy"))
    p1, p2, m = 1 / F.pow(20 * sy / sx, 2), 1 / F.pow(20 * sy, 2), F.col("_y") / F.col("n")
    a11, a12, a22 = F.col("_xx") + p1, F.col("_x"), F.col("n") + p2
    b1, b2 = F.col("_xy"), F.col("_y") + p2 * m
    det = a11 * a22 - a12 * a12
    g = g.withColumns({"slope": (a22 * b1 - a12 * b2) / det, "intercept": (a11 * b2 - a12 * b1) / det, "_v11": a22 / det, "_v22": a11 / det})
    quad = a11 * F.pow("slope", 2) + 2 * a12 * F.col("slope") * F.col("intercept") + a22 * F.pow("intercept", 2)
    an, bn = 2 + F.col("n") / 2, sy * sy / 2 + 0.5 * (F.col("_yy") + p2 * m * m - quad)
    return g.select(
        *keys, "n", "slope", "intercept", (2 * an).alias("dof"), F.sqrt(F.greatest(bn / an * F.col("_v11"), F.lit(0.0))).alias("slope_scale"),
        F.sqrt(F.greatest(bn / an * F.col("_v22"), F.lit(0.0))).alias("intercept_scale"),
    )


def bayes_factor(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Log Bayes factor of a line against a constant, its band and the factor (saturated at e^100).

    Both models share the prior's shape and rate, so gamma functions cancel and
    two determinants and two rates are left: closed forms of six sums.
    """
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_c(x)).alias("_x"), F.sum(_c(y)).alias("_y"), F.sum(_c(x) * _c(x)).alias("_xx"), F.sum(_c(x) * _c(y)).alias("_xy"),
        F.sum(_c(y) * _c(y)).alias("_yy"), F.stddev_pop(_c(x)).alias("_dx"), F.stddev_pop(_c(y)).alias("_dy"),
    )
    sx, sy = (F.when(F.col(d) > 0, F.col(d)).otherwise(1.0) for d in ("_dx", "_dy"))
    g = g.withColumns({"_p1": 1 / F.pow(20 * sy / sx, 2), "_p2": 1 / F.pow(20 * sy, 2), "_m": F.col("_y") / F.col("n"), "_b0": sy * sy / 2})
    p1, p2, m = F.col("_p1"), F.col("_p2"), F.col("_m")
    a11, a12, a22, b1, b2 = F.col("_xx") + p1, F.col("_x"), F.col("n") + p2, F.col("_xy"), F.col("_y") + p2 * m
    det, base = a11 * a22 - a12 * a12, F.col("_yy") + p2 * m * m
    line = base - (a22 * b1 * b1 - 2 * a12 * b1 * b2 + a11 * b2 * b2) / det
    flat = base - b2 * b2 / a22
    rate = lambda q: F.greatest(F.col("_b0") + 0.5 * q, F.lit(1e-12))
    volume = 0.5 * (F.ln(p1 * p2) - F.ln(det)) - 0.5 * (F.ln(p2) - F.ln(a22))
    log_bf = volume - (2 + F.col("n") / 2) * (F.ln(rate(line)) - F.ln(rate(flat)))
    v = F.col("log_bf")
    band = F.when(v >= 3, "strong line").when(v >= 1, "moderate line").when(v >= 0, "weak line").when(v > -1, "weak constant").when(v > -3, "moderate constant").otherwise("strong constant")
    return g.select(*keys, "n", log_bf.alias("log_bf")).withColumns({"band": band, "factor": F.exp(F.least(F.greatest(v, F.lit(-100.0)), F.lit(100.0)))})


def mode(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per group; of equals the one met first."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("m")).select(*keys, "m.*")


def diagnostics(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Line, adjusted r2, cross-validation and number of influential points in one row per group."""
    line = ols(points, keys, x, y).withColumn("adjusted_r2", adjusted_r2(F.col("r2"), F.col("n"), 2))
    cook = cooks_distance(points, keys, x, y).groupBy(*keys).agg(F.count_if("influential").alias("n_influential"))
    return line.join(leave_one_out(points, keys, x, y).drop("n"), keys, "left").join(cook, keys, "left")


def one_sample(values: DataFrame, keys: list[str], value: str, mean: float) -> DataFrame:
    """T statistic against ``mean``, Cohen's d, and the counts of the sign test."""
    g = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count_if(F.col(value) > mean).alias("above"), F.count_if(F.col(value) < mean).alias("below"))
    d = F.try_divide(F.col("mean") - mean, F.nullif(F.col("sd"), F.lit(0.0)))
    return g.select(*keys, "n", "mean", "sd", (d * F.sqrt("n")).alias("t"), d.alias("cohens_d"), "above", "below")


def median_iqr(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles with linear interpolation."""
    q = F.percentile(_c(value), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return values.groupBy(*keys).agg(q.alias("_q")).select(*keys, *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))])


def index_quartiles(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles and upper-middle median picked by index, by ranks in a window: no group's values are gathered in one row."""
    w = Window.partitionBy(*keys)
    rows = values.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value)))
    n = F.col("_n")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), at(F.floor(n / 4)).alias("q1"), at(F.floor(n / 2)).alias("median"), at(F.floor(3 * n / 4)).alias("q3"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def robust_range(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tukey fences cut to the data from eight values on, else the data's range; widened around the median."""
    q = index_quartiles(values, keys, value)
    iqr = F.col("q3") - F.col("q1")
    lo = F.when(F.col("n") >= 8, F.greatest(F.col("lo"), F.col("q1") - 1.5 * iqr)).otherwise(F.col("lo"))
    hi = F.when(F.col("n") >= 8, F.least(F.col("hi"), F.col("q3") + 1.5 * iqr)).otherwise(F.col("hi"))
    return q.select(*keys, "n", "median", F.least(lo, F.col("median") * 0.5).alias("low"), F.greatest(hi, F.col("median") * 2).alias("high"))


# --- tails, in plain Python: for a few numbers on the driver or inside a grouped function ---


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|)."""
    return beta_fraction(dof / 2, 0.5, dof / (dof + t * t))


def sign_test(above: int, below: int) -> float:
    """Two-sided sign test."""
    n, k = above + below, min(above, below)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def classical_fit(name: str, points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A classical model by its name: (keys, model, n, r2, rmse); vegard is linear."""
    fits = {
        "linear": lambda: ols(points, keys, x, y), "vegard": lambda: ols(points, keys, x, y), "quadratic": lambda: polynomial(points, keys, x, y, 2), "power": lambda: transformed_fit(points, keys, x, y, "power"),
    }
    wanted = name.strip().lower()
    if wanted not in fits:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(fits))}")
    fit = fits[wanted]()
    return fit.select(*keys, F.lit(wanted).alias("model"), *[F.col(c) for c in ("n", "r2", "rmse") if c in fit.columns])
