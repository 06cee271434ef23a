"""Connected components of an edge table, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, at the
least node it sees; the least label of a component reaches all its nodes in a
logarithmic number of rounds.  Edges stay in the cluster: only two sums come to
the driver, and every round is a table in the shared folder; the one before it is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


ROWS_PER_FILE = 1_000_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over directed pairs (u, v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    seen = spread_join(edges, least, ["u"], "inner")
    if not small:
        return seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return seen.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that has an edge (a, b); label: the least node of its component."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    spark = edges.sparkSession
    pairs, path = written(pairs, "edges")
    before = (pairs.count(), None)
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        pairs = _star(large, small=True)
        if before:  # as many files as the edges need
            pairs = pairs.coalesce(1 + before[0] // ROWS_PER_FILE)
        last = path
        pairs, path = written(pairs, "edges")
        discard(spark, last)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
