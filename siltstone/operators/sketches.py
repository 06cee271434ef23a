"""Mergeable sketches: distinct counts and quantiles that are kept per slice and added up over time and groups.

A slice's sketch is a column of bytes of bounded size (2^lg_k registers; a few
hundred values for each doubling of k).  Coarser answers merge the kept
sketches; rows are never read again.

Edge cases: nulls are not counted; a group of nulls alone has a null sketch and
a null estimate; merging nothing gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: Three standard errors of the distinct count, and the bound of a quantile's error in rank (99 %) at these sizes.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0085


def sliced(rows: DataFrame, keys: list[str], item: str, value: str, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """Keys, items (distinct counter), values (quantile sketch), n: one row per slice, combined map-side."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_agg(item, F.lit(lg_k)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("values"), F.count(F.lit(1)).alias("n")
    )


def merged(slices: DataFrame, keys: list[str | Column], k: int = KLL_K) -> DataFrame:
    """The slices of each coarser key added up."""
    return slices.groupBy(*keys).agg(F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values", F.lit(k)).alias("values"), F.sum("n").alias("n"))


def distinct(sketch: str = "items") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "values") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
