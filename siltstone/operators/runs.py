"""Sorted runs: order within a group without one task for the group.

Rows are range-partitioned by group and order; each partition is a run of each group that it holds.  What a run must know
of the runs before and after it (totals, last and next values) is one row for each group and run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_QUARTER = 0.25
_FLOOR = 1e-6


def sorted_runs(rows: DataFrame, *order: str) -> DataFrame:
    """Adds _run, the number of the range partition; rows that are equal in ``order`` share a run.

    Checkpointed, since bounds are sampled anew each time a plan runs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_run", F.spark_partition_id()))


def earlier(group: str) -> Window:
    """Over one row for each group and run: the runs before."""
    return Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)


def later(group: str) -> Window:
    """Over one row for each group and run: the runs after."""
    return Window.partitionBy(group).orderBy("_run").rowsBetween(1, Window.unboundedFollowing)


def ranks(rows: DataFrame, order: str) -> DataFrame:
    """Adds rank, 1, 2, 3 ... of the rows in ascending order (equal rows in any order), without one task for all of them."""
    runs = sorted_runs(rows, order)
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    starts = sizes.select("_run", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_run").orderBy(order))
    return runs.join(starts, "_run").withColumn("rank", at).drop("_run", "_start")


def _relative(v: Column, k: Column) -> Column:
    return F.abs(v - k) / F.greatest(F.abs(k), F.lit(_FLOOR))


def _end(v: Column, guess: Column, pick) -> Column:
    """The outermost double within a quarter of ``v``: the guess or one of the doubles beside it."""
    near = F.array(*[guess + F.lit(float(i)) * guess * F.lit(2.0**-53) for i in range(-4, 5)])
    return F.coalesce(pick(F.filter(near, lambda k: _relative(v, k) <= _QUARTER)), v)


def prior_among_others(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Adds prior and nearest, of the positive values of the group's other rows: the literature prior after the
    outlier guard, and the least relative distance.

    Equal values of a group are one entry with a count.  The nearest values are the neighbours in a sorted run, the guard
    has three possible medians a group, and the share within a quarter is a difference of running totals at two ends.
    A null group, or a value that is null, not positive or not finite: prior 0, nearest null; the same in a group of one row.
    """
    v = F.col("v")
    real = F.col(group).isNotNull() & (F.col(value) > 0) & (F.col(value).cast("double") < float("inf"))
    seen = rows.where(real).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    runs = sorted_runs(seen, "g", "v")
    run = ["g", "_run"]
    marks = runs.groupBy(*run).agg(F.sum("n").alias("s"), F.min("v").alias("least"), F.max("v").alias("most")).select(
        *run, F.coalesce(F.sum("s").over(earlier("g")), F.lit(0)).alias("start"), F.sum("s").over(Window.partitionBy("g")).alias("total"),
        F.max("most").over(earlier("g")).alias("left"), F.min("least").over(later("g")).alias("right"),
    )
    inside = Window.partitionBy(*run).orderBy("v")
    placed = runs.join(marks, run).select(
        *run, "v", "n", "total", (F.col("start") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"),
        F.coalesce(F.lag("v").over(inside), "left").alias("prev"), F.coalesce(F.lead("v").over(inside), "right").alias("next"),
    )

    # One row is left out, so the middle ranks of the others move by one for the rows at or below them: three medians.
    one, two = F.floor(F.col("total") / 2), F.floor((F.col("total") - 1) / 2) + 1
    at = lambda r: F.min(F.when(F.col("upto") >= r, v))
    mids = placed.groupBy("g").agg(at(one).alias("y1"), at(one + 1).alias("z1"), at(two).alias("y2"), at(two + 1).alias("z2"))
    mids = mids.select("g", *[((F.col(a) + F.col(b)) / 2).alias(f"m{i}") for i, (a, b) in enumerate((("y1", "y2"), ("y1", "z2"), ("z1", "z2")))])
    guarded = lambda i: v.between(F.col(f"m{i}") * 0.02, F.col(f"m{i}") * 50)
    # Per-group rows meet values by group and run, so a hot group stays as many tasks as it has runs.
    held = runs.join(marks.select(*run).join(mids, "g"), run).groupBy("g", "m0", "m1", "m2").agg(
        *[f(F.when(guarded(i), F.col(c))).alias(f"{name}{i}") for i in range(3) for f, c, name in ((F.sum, "n", "k"), (F.min, "v", "f"), (F.max, "v", "l"))]
    )
    which = F.when(F.col("upto") > two, 0).when(F.col("upto") > one, 1).otherwise(2)
    chosen = lambda c: F.when(which == 0, F.col(f"{c}0")).when(which == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    judged = placed.join(marks.select(*run).join(held, "g"), run).select(
        "g", "v", "n", "total", "prev", "next", (chosen("m") * 0.02).alias("lo"), (chosen("m") * 50).alias("hi"), F.coalesce(chosen("k"), F.lit(0)).alias("k"), chosen("f").alias("f"), chosen("l").alias("l")
    )
    again = F.when(F.col("n") > 1, 0.0)
    within = F.coalesce(v.between(F.col("lo"), F.col("hi")), F.lit(False))
    judged = judged.withColumn("nearest", F.least(again, _relative(v, F.col("prev")), _relative(v, F.col("next")))).withColumn("some", F.col("k") - within.cast("int") > 0)
    kept_near = F.when(v < F.col("lo"), _relative(v, F.col("f"))).when(v > F.col("hi"), _relative(v, F.col("l"))).otherwise(
        F.least(again, F.when(F.col("prev") >= F.col("lo"), _relative(v, F.col("prev"))), F.when(F.col("next") <= F.col("hi"), _relative(v, F.col("next"))))
    )
    low = _end(v, F.when(v * 0.8 >= _FLOOR, v * 0.8).otherwise(v - _QUARTER * _FLOOR), F.array_min)
    high = _end(v, F.when(v / 0.75 >= _FLOOR, v / 0.75).otherwise(v + _QUARTER * _FLOOR), F.array_max)
    judged = judged.select(
        "g", "v", "n", "nearest", (F.col("total") > 1).alias("others"), F.when(F.col("some"), kept_near).otherwise(F.col("nearest")).alias("near"),
        F.when(F.col("some"), within).otherwise(True).cast("int").alias("own"), F.when(F.col("some"), F.col("k")).otherwise(F.col("total")).alias("k"),
        F.when(F.col("some"), F.greatest(low, "lo")).otherwise(low).alias("low"), F.when(F.col("some"), F.least(high, "hi")).otherwise(high).alias("high"),
    )

    # Values and both ends of each one's range in one order; an end's share is the running total at it.
    event = lambda place, kind, n: F.struct(place.alias("place"), F.lit(kind).alias("kind"), n.cast("long").alias("add"))
    events = judged.withColumn("e", F.explode(F.array(event(F.col("low"), 0, F.lit(0)), event(v, 1, F.col("n")), event(F.col("high"), 2, F.lit(0))))).select(
        "g", "v", "nearest", "others", "near", "own", "k", "e.place", "e.kind", "e.add"
    )
    events = sorted_runs(events, "g", "place", "kind")
    starts = events.groupBy(*run).agg(F.sum("add").alias("s")).select(*run, F.coalesce(F.sum("s").over(earlier("g")), F.lit(0)).alias("start"))
    total = F.col("start") + F.sum("add").over(Window.partitionBy(*run).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0))
    counted = events.join(starts, run).withColumn("c", total).where("kind <> 1")
    shares = counted.groupBy("g", "v").agg(F.sum(F.when(F.col("kind") == 2, F.col("c")).otherwise(-F.col("c"))).alias("c"), *[F.max(c).alias(c) for c in ("nearest", "others", "near", "own", "k")])
    share = F.greatest(F.col("c") - F.col("own"), F.lit(0)) / (F.col("k") - F.col("own"))
    prior = F.when(F.col("others"), F.least(0.6 / (1 + F.col("near")) + 0.4 * share, F.lit(1.0))).otherwise(0.0)
    out = shares.select(F.col("g").alias("_group"), F.col("v").alias("_value"), prior.alias("_prior"), F.col("nearest").alias("_nearest"))
    rows = rows.drop("prior", "nearest")
    joined = rows.join(out, (rows[group] == out["_group"]) & (rows[value].cast("double") == out["_value"]), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce("_prior", F.lit(0.0)).alias("prior"), F.col("_nearest").alias("nearest"))
