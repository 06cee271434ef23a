"""Sketches kept by day, added up by kind and by month, beside the exact values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sketches
from .registry import Tables, query

EXACT = """SELECT {by} AS part, count(DISTINCT client_id) AS clients, count(value) AS n_values, true AS distinct_within, true AS median_within, true AS tail_within FROM clicks WHERE ts IS NOT NULL GROUP BY 1"""


@query(EXACT.format(by="coalesce(kind, '-')") + " UNION ALL " + EXACT.format(by="strftime(ts, '%Y-%m')"))
def sketched_clicks(t: Tables) -> DataFrame:
    """Clients and values by kind and by month out of daily sketches; estimates lie within the sketches' error of the exact values."""
    rows = t.clicks.where("ts IS NOT NULL").select(F.to_date("ts").alias("day"), F.coalesce("kind", F.lit("-")).alias("kind"), "client_id", "value")
    daily = sketches.sliced(rows, ["day", "kind"], "client_id", "value")
    out = None
    for by in (F.col("kind"), F.date_format("day", "yyyy-MM")):
        about = sketches.merged(daily.withColumn("part", by), ["part"]).select("part", sketches.distinct().alias("about"), sketches.quantile(0.5).alias("mid"), sketches.quantile(0.95).alias("high"))
        exact = rows.withColumn("part", by).groupBy("part").agg(F.countDistinct("client_id").alias("clients"), F.count("value").alias("n_values"))
        ranks = rows.withColumn("part", by).join(about, "part").groupBy("part").agg(
            *[F.count_if(F.expr(f"value {op} {q}")).alias(f"{q}_{name}") for q in ("mid", "high") for op, name in (("<", "below"), ("<=", "upto"))]
        )
        both = exact.join(about, "part").join(ranks, "part")
        slack = F.col("n_values") * sketches.RANK_ERROR + 1
        # A value's rank is a range where others equal it; the wanted rank lies in it, or within the error of it.
        near = lambda q, share: F.coalesce((F.col(f"{q}_below") - slack <= share * F.col("n_values")) & (share * F.col("n_values") <= F.col(f"{q}_upto") + slack), F.col("n_values") == 0)
        close = F.abs(F.col("about") - F.col("clients")) <= F.ceil(F.col("clients") * sketches.DISTINCT_ERROR)
        part = both.select("part", "clients", "n_values", close.alias("distinct_within"), near("mid", 0.5).alias("median_within"), near("high", 0.95).alias("tail_within"))
        out = part if out is None else out.unionByName(part)
    return out
