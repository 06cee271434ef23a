"""Ordered operators: running values, streaks, caps, nearest preceding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_best(frame: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Best value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("best", F.max(value).over(w))


def failure_streaks(frame: DataFrame, keys: list[str], order: list[Column], failed: Column) -> DataFrame:
    """Consecutive failures up to each row, back to zero after a success."""
    w = Window.partitionBy(*keys).orderBy(*order)
    islands = frame.withColumn("_failed", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_failed")).over(w))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return islands.withColumn("streak", F.sum("_failed").over(inside)).drop("_failed", "_island")


def last_n(frame: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, given the descending order."""
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def numbered(frame: DataFrame, keys: list[str], order: list[Column], template: str) -> DataFrame:
    """A label from a printf template with the row's number in its group."""
    return frame.withColumn("label", F.format_string(template, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))))


def preceding(frame: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """The last non-null ``value`` at or before each row (an as-of lookup on position)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn("preceding", F.last(value, ignorenulls=True).over(w))


def first_crossings(frame: DataFrame, keys: list[str], position: str, share: Column, limits: list[float]) -> DataFrame:
    """The first position at which ``share`` falls below each limit."""
    return frame.groupBy(*keys).agg(*[F.min(F.when(share < x, F.col(position))).alias(f"below_{round(100 * x)}") for x in limits])


def compact(frame: DataFrame, key: str, position: str, role: str, text: str, least: int = 10, width: int = 4000) -> DataFrame:
    """Of each conversation the first row and the last max(n / 2, least) rows, texts cut to ``width``.

    A leading tool row whose call was dropped goes too.
    """
    w = Window.partitionBy(key)
    rows = frame.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_at", F.row_number().over(w.orderBy(position)))
    from_end = F.col("_n") - F.col("_at")
    kept = rows.where((F.col("_at") == 1) | (from_end < F.greatest(F.floor(F.col("_n") / 2), F.lit(least))))
    kept = kept.withColumn("_seen", F.sum(F.when((F.col(role) != "tool") & (F.col("_at") > 1), 1).otherwise(0)).over(w.orderBy(position)))
    kept = kept.where((F.col(role) != "tool") | (F.col("_seen") > 0))
    return kept.withColumn(text, F.left(text, F.lit(width))).drop("_n", "_at", "_seen")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """Each row of ``left`` with the values of the last row of ``right`` at or before it (right rows of one time: the greatest).

    Both sides are one stream per key: the last right row seen is carried on.  No pair is made.
    """
    last = right.groupBy(*keys, at).agg(F.max(F.struct(*values)).alias("_v"))
    rows = left.withColumn("_side", F.lit(1)).unionByName(last.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_seen", seen).where("_side = 1")
    return out.select(*[c for c in left.columns], *[F.col(f"_seen.{v}").alias(v) for v in values])


#: Rows of one side of a bucket that meet in one block, and pairs that a task tries.
BLOCK_ROWS, TASK_PAIRS = 2048, 1 << 24


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows (lo, hi) whose closed intervals meet, through buckets of ``width``; right columns end with _r.

    A pair is taken in the first bucket that both reach, so it comes once.  A full bucket is cut into blocks on both
    sides and each two of them meet by themselves: tasks follow from the pairs to be tried, not from the size of the
    sides, and a hot key is as many tasks as its pairs need.
    """
    at = [*keys, "_b"]
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = lambda d: d.withColumn("_b", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    counted = [spread(d).groupBy(*at).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "_n"), (right, "_m"))]
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    counts = cut(counted[0].join(counted[1], at).select(*at, blocks("_n").alias("_p"), blocks("_m").alias("_q"), (F.col("_n") * F.col("_m")).alias("_pairs")))
    pairs = counts.agg(F.sum(F.col("_pairs").cast("double"))).first()[0] or 0.0
    tasks = int(min(max(pairs / TASK_PAIRS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000))

    def dealt(side: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.col(own_n)).cast("int")
        rows = spread(side).join(counts.drop("_pairs"), at).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return rows.drop("_p", "_q").repartition(tasks, *at, "_i", "_j")

    a = dealt(left, "_i", "_p", "_j", "_q")
    b = dealt(right, "_j", "_q", "_i", "_p")
    b = b.select(*at, "_i", "_j", *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    both = a.join(b, [*at, "_i", "_j"]).where((F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi")))
    return both.where(F.col("_b") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("_lo") / width))).drop("_b", "_lo", "_hi", "_i", "_j")
