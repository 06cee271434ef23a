"""Claims against evidence: band joins, verdicts, nearest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1.25  # ratio of neighbouring buckets of the band join


def band_matches(claims: DataFrame, evidence: DataFrame, slack: float = 0.10) -> DataFrame:
    """Claims (claim, unit, lo, hi) joined to evidence (item, unit, value) with value in [(1 - slack) lo, (1 + slack) hi].

    Positive values only (as claims and evidence are).  Logarithmic buckets turn
    the range into equality: a claim is copied into every bucket that its band
    touches, evidence lies in one.
    """
    bucket = lambda v: F.floor(F.log(v) / F.log(F.lit(STEP)))
    lo, hi = F.col("lo") * (1 - slack), F.col("hi") * (1 + slack)
    c = claims.where("lo > 0 and hi >= lo").withColumns({"_lo": lo, "_hi": hi}).withColumn("_b", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    e = evidence.where("value > 0").withColumn("_b", bucket(F.col("value")))
    return c.join(e, ["unit", "_b"]).where("value between _lo and _hi").drop("_b", "_lo", "_hi")


OCTAVE = 1 << 20  # finest cells in a doubling of the value
CELL_BITS, LEVELS = 3, 11  # a cell of one level holds eight of the level below


def band_totals(claims: DataFrame, evidence: DataFrame, slack: float = 0.10) -> DataFrame:
    """Claim -> n_match and least item of its :func:`band_matches`, without a row for each match."""
    c = claims.where("lo > 0 and hi >= lo").select("claim", "unit", (F.col("lo") * (1 - slack)).alias("lo"), (F.col("hi") * (1 + slack)).alias("hi"))
    bands = c.select("unit", "lo", "hi").distinct()
    return c.join(_totals(bands, evidence), ["unit", "lo", "hi"]).select("claim", "n_match", "item")


def _totals(bands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct bands (unit, lo, hi) that hold a value, with n_match and the least item.

    Values lie in logarithmic cells, nested by eights.  A band is its two end
    cells, where values are compared, and the largest cells between them, where
    the logarithm's order decides and a total is read; a band meets some tens
    of totals however many items match, and claims of one band share it.
    """
    key = lambda v: F.floor(F.log2(v) * OCTAVE).cast("long")
    # Equal values of a unit are one row before cells are made of them.
    values = evidence.where("value > 0").groupBy("unit", "value").agg(F.count(F.lit(1)).alias("_n"), F.min("item").alias("_item")).withColumn("_key", key(F.col("value")))
    cells = values.select("unit", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level"), "_key", "_n", "_item").withColumn("_cell", F.expr(f"shiftright(_key, {CELL_BITS} * _level)"))
    totals = cells.groupBy("unit", "_level", "_cell").agg(F.sum("_n").alias("_n"), F.min("_item").alias("_item"))
    b = bands.withColumns({"_a": key(F.col("lo")), "_b": key(F.col("hi"))})
    ends = b.withColumn("_key", F.explode(F.array_distinct(F.array("_a", "_b")))).join(values, ["unit", "_key"]).where("value between lo and hi")
    inside = _cover(b).join(totals, ["unit", "_level", "_cell"])
    both = ends.select("unit", "lo", "hi", "_n", "_item").unionByName(inside.select("unit", "lo", "hi", "_n", "_item"))
    return both.groupBy("unit", "lo", "hi").agg(F.sum("_n").alias("n_match"), F.min("_item").alias("item"))


def _cover(bands: DataFrame) -> DataFrame:
    """Bands (_a and _b their end cells) times the fewest cells (_level, _cell) that make up the finest cells between the ends.

    Each level takes what the level above leaves at both sides, the top level all: one short expression over a row for
    each level, since the plan, and with it the driver's memory, would grow with each level written out.
    """
    up = lambda j: f"-shiftright(-(_a + 1), {CELL_BITS} * ({j}))"
    down = lambda j: f"shiftright(_b, {CELL_BITS} * ({j}))"
    at = bands.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).selectExpr(
        "*", f"{up('_level')} AS _from", f"{down('_level')} AS _to", f"shiftleft({up('_level + 1')}, {CELL_BITS}) AS _left", f"shiftleft({down('_level + 1')}, {CELL_BITS}) AS _right"
    )
    whole = F.expr(f"_level = {LEVELS - 1} OR _left >= _right")
    sides = F.when(whole, F.array(F.struct(F.col("_from").alias("f"), F.col("_to").alias("t")))).otherwise(
        F.array(F.struct(F.col("_from").alias("f"), F.col("_left").alias("t")), F.struct(F.col("_right").alias("f"), F.col("_to").alias("t")))
    )
    runs = at.where("_from < _to").select("unit", "lo", "hi", "_level", F.explode(sides).alias("_s")).where("_s.f < _s.t")
    return runs.select("unit", "lo", "hi", "_level", F.explode(F.sequence(F.col("_s.f"), F.col("_s.t") - 1)).alias("_cell"))


def first_match(claims: DataFrame, matches: DataFrame, order: list[Column]) -> DataFrame:
    """Every claim with its first match in order (null if none)."""
    best = matches.groupBy("claim").agg(F.min_by("item", F.struct(*order)).alias("item"))
    return claims.join(best, "claim", "left")


def claim_status(claims: DataFrame, evidence: DataFrame, slack: float = 0.15) -> DataFrame:
    """Two matches verify, one is partial; none, and no value of the unit within half of the middle, contradicts; else unverified.

    "The nearest value is over half away" is "no value lies in the half band",
    a second band join: no unit's values are gathered in one place.
    """
    middle = (F.col("lo") + F.col("hi")) / 2
    band = lambda half, lo, hi: F.struct(F.lit(half).alias("half"), lo.alias("lo"), hi.alias("hi"))
    # Both bands of all claims meet the evidence in one pass.
    two = claims.where("lo > 0 and hi >= lo").select("claim", "unit", F.explode(F.array(band(False, F.col("lo") * (1 - slack), F.col("hi") * (1 + slack)), band(True, middle * 0.5, middle * 1.5))).alias("s"))
    two = two.select("claim", "unit", "s.*")
    met = two.join(_totals(two.select("unit", "lo", "hi").distinct(), evidence), ["unit", "lo", "hi"])
    met = met.groupBy("claim").agg(F.max(F.when(~F.col("half"), F.col("n_match"))).alias("n_match"), F.max(F.when(F.col("half"), True)).alias("_near"))
    units = evidence.where("value > 0").select("unit").distinct().withColumn("_met", F.lit(True))
    out = claims.join(met, "claim", "left").join(units, "unit", "left")
    n = F.coalesce("n_match", F.lit(0))
    status = F.when(n >= 2, "verified").when(n == 1, "partial").when(F.col("_met") & F.col("_near").isNull(), "contradicted").otherwise("unverified")
    return out.select(*claims.columns, n.alias("n_match"), status.alias("status"))


def roll_up(status: DataFrame, group: str) -> DataFrame:
    """Share of claims found per group, rounded to 2; the unverified ones listed."""
    found = F.col("status").isin("verified", "partial")
    return status.groupBy(group).agg(
        F.round(F.avg(found.cast("double")), 2).alias("share"), F.count(F.lit(1)).alias("n_claims"), F.count_if(~found).alias("n_unverified")
    )


def nearest_value(value: Column, values: Column) -> Column:
    """The known value at the least relative distance; the smaller of two."""
    return F.array_min(F.transform(values, lambda v: F.struct((F.abs(value - v) / F.greatest(F.abs(v), F.lit(1e-6))).alias("distance"), v.alias("value"))))["value"]
