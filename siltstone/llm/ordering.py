"""Places in a global order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: monotonically_increasing_id holds the partition above these bits and the row's place in it below.
PLACE_BITS = 33


def before_each(parts: DataFrame, part: str, size: str, name: str) -> DataFrame:
    """``parts`` (a row for each partition, so as many as spark.sql.shuffle.partitions says) with the sum of ``size`` over the partitions before."""
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long").alias(name))


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A written table of ``rows``, range-partitioned and sorted by ``order``, with ``_part`` and ``_place`` in it.

    It is written because ranges come from a sample: a second run of the plan
    could cut them elsewhere, and the sums of partitions would not fit the rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return materialise(ranged, name).select(*rows.columns, F.shiftright(at, PLACE_BITS).alias("_part"), at.bitwiseAND((1 << PLACE_BITS) - 1).alias("_place"))


def positions(rows: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``order``; rows alike in it get their places in any order."""
    sorted_rows = in_order(rows, order, "ordered")
    base = before_each(sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")), "_part", "_size", "_before")
    return sorted_rows.join(F.broadcast(base), "_part").select(*rows.columns, (F.col("_before") + F.col("_place")).alias(position))


def running_before(rows: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows before them in the order of ``order``, which must tell rows apart."""
    sorted_rows = in_order(rows, order, "sizes")
    base = before_each(sorted_rows.groupBy("_part").agg(F.sum(size).alias("_size")), "_part", "_size", "_before")
    here = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    summed = sorted_rows.withColumn("_here", F.coalesce(F.sum(size).over(here), F.lit(0)))
    return summed.join(F.broadcast(base), "_part").select(*rows.columns, (F.col("_before") + F.col("_here")).cast("long").alias(name))
