"""Graphs, claims, scores, statistics, search and event logs over the star-schema and event tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions, scores
from ..operators import claims, graph, quality, resampling, resolve, runs, search_space, stats, windows
from .registry import Tables, query

# --- graphs: a part is a material, its brand a structure, suppliers its properties ---

FACTS = "SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem"


@query("SELECT lower(p_brand) AS entity, list_sort(list(DISTINCT p_type)) AS properties FROM part GROUP BY 1")
def property_matrix(t: Tables) -> DataFrame:
    """A5."""
    return graph.property_matrix(t.part, "p_brand", "p_type")


@query("""SELECT (SELECT count(*) FROM part) AS materials, (SELECT count(*) FROM lineitem) AS properties, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS unique_property_types,
 (SELECT count(*) FROM orders) AS syntheses, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS unique_methods, (SELECT count(*) FROM supplier) AS relations""")
def graph_statistics(t: Tables) -> DataFrame:
    """A4."""
    return graph.graph_statistics(t.part, t.lineitem.withColumnRenamed("l_returnflag", "property_name"), t.orders.withColumnRenamed("o_orderpriority", "method"), t.supplier)


@query("""WITH b AS (SELECT 0 AS side, o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY side, o_orderkey) AS r FROM b) SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM r WHERE r = 1""")
def graph_fusion(t: Tables) -> DataFrame:
    """E5: two halves of the orders fused on (customer, priority), left side first."""
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return graph.fuse(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("""WITH e AS (SELECT DISTINCT p_brand AS g, lower(unnest(string_split(p_type, ' '))) AS k FROM part UNION SELECT DISTINCT p_brand, lower(p_name) FROM part),
n AS (SELECT DISTINCT a.k AS inner_, b.k AS outer_ FROM (SELECT DISTINCT k FROM e WHERE k <> '') a JOIN (SELECT DISTINCT k FROM e WHERE k <> '') b ON a.k = b.k OR (length(a.k) >= 3 AND contains(b.k, a.k)))
SELECT DISTINCT least(x.g, y.g) AS group_a, greatest(x.g, y.g) AS group_b, inner_ AS key FROM n JOIN e x ON x.k = inner_ JOIN e y ON y.k = outer_ WHERE x.g <> y.g""")
def containment_theta_join(t: Tables) -> DataFrame:
    """Names that equal or contain one another across brands, through shared three-character windows."""
    words = t.part.select(F.col("p_brand").alias("g"), F.explode(F.split(F.lower("p_type"), " ")).alias("k")).unionByName(t.part.select(F.col("p_brand").alias("g"), F.lower("p_name").alias("k"))).distinct()
    return graph.containment_links(words, "g", "k")


@query("""WITH e AS (SELECT DISTINCT p_brand AS g, lower(unnest(string_split(p_type, ' '))) AS k, p_partkey AS item FROM part),
l AS (SELECT DISTINCT a.g AS group_a, b.g AS group_b, a.k AS key FROM (SELECT DISTINCT g, k FROM e) a JOIN (SELECT DISTINCT g, k FROM e) b ON a.k = b.k AND a.g < b.g),
n AS (SELECT group_a, group_b, key, count(DISTINCT item) AS n_evidence FROM l JOIN e ON l.key = e.k AND e.g IN (l.group_a, l.group_b) GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n_evidence >= 4 THEN 'high' WHEN n_evidence >= 2 THEN 'medium' ELSE 'low' END AS strength FROM n""")
def strength_bands(t: Tables) -> DataFrame:
    """Links of brands through equal type words, and the parts that support them."""
    e = t.part.select(F.col("p_brand").alias("g"), F.explode(F.split(F.lower("p_type"), " ")).alias("k"), F.col("p_partkey").alias("item"))
    g = e.select("g", "k").distinct()
    links = g.withColumnRenamed("g", "group_a").join(g.withColumnRenamed("g", "group_b"), "k").where("group_a < group_b").withColumnRenamed("k", "key")
    return graph.link_strength(links, e, "g", "k", "item")


@query("""SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def bridge_semi_join(t: Tables) -> DataFrame:
    """J14."""
    return graph.bridges(t.lineitem.select(F.col("l_partkey").alias("part"), "l_returnflag"), "part", "l_returnflag", "R", "A")


@query(f"""WITH f AS ({FACTS}), m AS (SELECT DISTINCT p_partkey AS part, p_brand AS brand FROM part), w AS (SELECT DISTINCT brand, supp FROM m JOIN f USING (part))
SELECT count(*) AS n_pairs, count(DISTINCT part) AS n_parts, sum(part * 1000 + supp)::BIGINT AS checksum FROM (SELECT DISTINCT m.part, w.supp FROM m JOIN w USING (brand) EXCEPT SELECT part, supp FROM f)""")
def unexplored_pairs(t: Tables) -> DataFrame:
    """Suppliers known for a part's brand but not for the part, counted and summed."""
    facts = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    gaps = graph.unexplored_counts(t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand")), facts, "part", "brand", "supp").where("n > 0")
    # Summed without overflow; null where the sum has no 64-bit form, in which the SQL's cast fails too.
    checksum = F.sum(F.col("n").cast("decimal(16,0)") * F.col("part").cast("decimal(19,0)") * 1000 + F.col("total")).try_cast("long")
    return gaps.agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_parts"), checksum.alias("checksum"))


@query(f"""WITH f AS ({FACTS}), m AS (SELECT DISTINCT p_partkey AS part, p_brand AS brand FROM part), w AS (SELECT DISTINCT brand, supp FROM m JOIN f USING (part))
SELECT m.part, w.supp FROM m JOIN w USING (brand) JOIN (SELECT p_partkey AS part FROM part WHERE p_size = 50) USING (part) EXCEPT SELECT part, supp FROM f""")
def unexplored_of(t: Tables) -> DataFrame:
    """J12 for the parts asked about, those of the largest size."""
    facts = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    members = t.part.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), "p_size")
    return graph.unexplored_pairs(members, facts, "part", "brand", "supp", asked=members.where("p_size = 50"))


@query("""WITH b AS (SELECT s_suppkey, s_acctbal / 10000 AS confidence FROM supplier WHERE s_acctbal / 10000 > 0.6 ORDER BY confidence DESC, s_suppkey LIMIT 8) SELECT n_nationkey, s_suppkey, round(confidence, 6) AS confidence FROM nation, b""")
def strong_relations(t: Tables) -> DataFrame:
    """Every nation beside the eight strongest suppliers (the limit is the feature)."""
    rel = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 10000).alias("confidence"))
    return graph.strong_relations(t.nation, rel, "n_nationkey", ["s_suppkey"]).select("n_nationkey", "s_suppkey", F.round("confidence", 6).alias("confidence"))


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), l AS (SELECT l_orderkey AS pos, max(l_extendedprice) AS best FROM lineitem GROUP BY 1)
SELECT o_orderkey, pos, best FROM o LEFT JOIN l USING (pos)""")
def positional_left_join(t: Tables) -> DataFrame:
    """The n-th order beside the result filed under number n."""
    # Positions from range-partitioned counts: no single partition sorts all rows.
    o = with_position(t.orders.select("o_orderkey"), "o_orderkey")
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("pos")).agg(F.max("l_extendedprice").alias("best"))
    return o.join(best, "pos", "left").select("o_orderkey", "pos", "best")


def with_position(rows: DataFrame, key: str, width: int = 1 << 12, group: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of each row (of its group, which has no nulls) by a unique integer key: rank inside a bucket of keys plus the rows of smaller buckets."""
    from pyspark.sql import Window

    b = rows.withColumn("_b", F.floor(F.col(key) / width))
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per bucket
    inside = b.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)) - 1)
    return inside.join(before.select(*group, "_b", "_before"), [*group, "_b"]).withColumn("pos", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")


# --- claims: parts claim a price range by brand; line items are evidence ---

CLAIMS = "SELECT p_partkey AS claim, p_brand AS unit, p_retailprice AS lo, p_retailprice * 1.05 AS hi FROM part"
EVIDENCE = "SELECT l_orderkey * 10 + l_linenumber AS item, p_brand AS unit, l_extendedprice / l_quantity AS value FROM lineitem JOIN part ON p_partkey = l_partkey"


def _claims(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("claim"), F.col("p_brand").alias("unit"), F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") * 1.05).alias("hi"))


def _evidence(t: Tables) -> DataFrame:
    e = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("p_brand").alias("unit"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


@query(f"""WITH c AS ({CLAIMS}), e AS ({EVIDENCE}), m AS (SELECT claim, count(*) AS n_match, min(item) AS item FROM c JOIN e USING (unit) WHERE value BETWEEN lo * 0.9 AND hi * 1.1 GROUP BY claim)
SELECT c.claim, coalesce(m.item, -1) AS item, coalesce(n_match, 0) AS n_match FROM c LEFT JOIN m USING (claim)""")
def claim_band_join(t: Tables) -> DataFrame:
    """First match of each claim within ten per cent, and how many there are."""
    c = _claims(t)
    m = claims.band_totals(c, _evidence(t), 0.10)
    return c.select("claim").join(m, "claim", "left").select("claim", F.coalesce("item", F.lit(-1)).alias("item"), F.coalesce("n_match", F.lit(0)).alias("n_match"))



STATUS = f"""WITH c AS ({CLAIMS}), e AS ({EVIDENCE}), m AS (SELECT claim, count(*) FILTER (WHERE value BETWEEN lo * 0.85 AND hi * 1.15) AS n_match, min(abs(value - (lo + hi) / 2) / ((lo + hi) / 2)) AS far FROM c JOIN e USING (unit) GROUP BY claim),
s AS (SELECT c.claim, c.unit, coalesce(n_match, 0) AS n_match, CASE WHEN n_match >= 2 THEN 'verified' WHEN n_match = 1 THEN 'partial' WHEN far > 0.5 THEN 'contradicted' ELSE 'unverified' END AS status FROM c LEFT JOIN m USING (claim))"""


@query(STATUS + " SELECT claim, n_match, status FROM s")
def claim_status(t: Tables) -> DataFrame:
    """A25."""
    return claims.claim_status(_claims(t), _evidence(t)).select("claim", "n_match", "status")


@query(STATUS + " SELECT unit, round(avg(CASE WHEN status IN ('verified', 'partial') THEN 1.0 ELSE 0.0 END), 2) AS share, count(*) AS n_claims, count(*) FILTER (WHERE status NOT IN ('verified', 'partial')) AS n_unverified FROM s GROUP BY unit")
def claim_roll_up(t: Tables) -> DataFrame:
    """A24."""
    return claims.roll_up(claims.claim_status(_claims(t), _evidence(t)), "unit")


# --- scores ---


@query("""WITH v AS (SELECT a.p_partkey, any_value(a.p_retailprice) AS x, list_sort(list(b.p_retailprice) FILTER (WHERE b.p_partkey IS NOT NULL)) AS ks FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey),
j AS (SELECT p_partkey, x, ks, list_aggregate(ks, 'median') AS med FROM v), g AS (SELECT *, CASE WHEN len(list_filter(ks, lambda y: y >= med * 0.02 AND y <= med * 50)) > 0 THEN list_filter(ks, lambda y: y >= med * 0.02 AND y <= med * 50) ELSE ks END AS gs FROM j)
SELECT p_partkey, coalesce(round(least(0.6 / (1 + list_min(list_transform(gs, lambda y: abs(x - y) / greatest(abs(y), 1e-6)))) + 0.4 * len(list_filter(gs, lambda y: abs(x - y) / greatest(abs(y), 1e-6) <= 0.25)) / len(gs), 1.0), 6), 0) AS prior,
 round(list_min(list_transform(ks, lambda y: abs(x - y) / greatest(abs(y), 1e-6))), 6) AS nearest FROM g""")
def literature_prior(t: Tables) -> DataFrame:
    """Prior of each part's price given the prices of the other parts of its brand."""
    at = t.part.select("p_partkey", "p_brand", F.col("p_retailprice").alias("x"))
    return runs.prior_among_others(at, "p_brand", "x").select("p_partkey", F.round("prior", 6).alias("prior"), F.round("nearest", 6).alias("nearest"))


@query("""WITH s AS (SELECT c_custkey, (c_acctbal + 1000) / 11003 AS s, (c_custkey % 100) / 99.0 AS u FROM customer)
SELECT c_custkey, round(CASE WHEN s <= 0 THEN 0.02 WHEN s <= 0.3 THEN 0.02 + s * 0.2 / 0.3 WHEN s <= 0.5 THEN 0.22 + (s - 0.3) * 0.2 / 0.2 WHEN s <= 0.65 THEN 0.42 + (s - 0.5) * 0.2 / 0.15 WHEN s <= 0.8 THEN 0.62 + (s - 0.65) * 0.2 / 0.15 WHEN s <= 0.9 THEN 0.82 + (s - 0.8) * 0.11 / 0.1 WHEN s < 1 THEN 0.93 + (s - 0.9) * 0.07 / 0.1 ELSE 1 END, 9) AS stretched,
 round(coalesce((CASE WHEN s > 1e-9 THEN 0.45 ELSE 0 END + CASE WHEN u > 1e-9 THEN 0.55 ELSE 0 END) / nullif(CASE WHEN s > 1e-9 THEN 0.45 / s ELSE 0 END + CASE WHEN u > 1e-9 THEN 0.55 / u ELSE 0 END, 0), 0), 9) AS fused,
 round(CASE WHEN s BETWEEN 0.4 AND 0.6 THEN 1.0 ELSE greatest(0, 1 - greatest(0.4 - s, s - 0.6) / 0.1) END, 9) AS trapezoid, round(exp(-0.5 * ((s - 0.5) / 0.1) ** 2), 9) AS gauss,
 CASE WHEN s >= 0.5 AND u >= 0.5 THEN 'strong' WHEN s >= 0.5 THEN 'underexplored' WHEN u >= 0.5 THEN 'contested' ELSE 'weak' END AS quadrant,
 round(CASE WHEN s BETWEEN 0.3 AND 0.7 THEN 0.05 + 0.05 * greatest(0, 1 - ((s - 0.5) / 0.2) ** 2) ELSE 0 END, 9) AS bonus FROM s""")
def score_functions(t: Tables) -> DataFrame:
    """M5, M7, M10, M11, M18, M22 on normalised balances."""
    s, u, lo, hi = F.col("s"), F.col("u"), F.lit(0.4), F.lit(0.6)
    rows = t.customer.select("c_custkey", ((F.col("c_acctbal") + 1000) / 11003).alias("s"), ((F.col("c_custkey") % 100) / 99.0).alias("u"))
    return rows.select(
        "c_custkey", F.round(scores.stretch("s"), 9).alias("stretched"), F.round(scores.harmonic([(s, F.lit(0.45)), (u, F.lit(0.55))]), 9).alias("fused"),
        F.round(scores.trapezoid(s, lo, hi), 9).alias("trapezoid"), F.round(scores.gaussian(s, lo, hi), 9).alias("gauss"), scores.quadrant("s", "u").alias("quadrant"),
        F.round(scores.composition_bonus(s), 9).alias("bonus"),
    )


@query("""SELECT p_partkey, round(2 * exp(least(greatest(-p_size / 10.0, -50), 50)) + sqrt(abs(p_retailprice)) / 3 - ln(greatest(abs(p_size), 1e-12)) ** 2, 6) AS value FROM part""")
def compiled_expression(t: Tables) -> DataFrame:
    """An expression in text, run as columns."""
    text = "2*exp(-x/10) + sqrt(y)/3 - log(x)^2"
    return t.part.select("p_partkey", F.round(expressions.compile_expression(text, {"x": F.col("p_size"), "y": F.col("p_retailprice")}), 6).alias("value"))


# --- statistics ---


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
 round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / count(*)), 4) AS rmse FROM lineitem GROUP BY 1""")
def ols_by_group(t: Tables) -> DataFrame:
    """R1, R3."""
    fit = stats.ols(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", "n", *[F.round(c, d).alias(c) for c, d in (("slope", 5), ("intercept", 4), ("r2", 8), ("rmse", 4))])


@query("""WITH p AS (SELECT p_brand, p_size::DOUBLE AS x, p_retailprice AS y FROM part), m AS (SELECT p_brand, avg(x) AS m FROM p GROUP BY 1), u AS (SELECT p_brand, x - m AS u, m, y FROM p JOIN m USING (p_brand)),
s AS (SELECT p_brand, any_value(m) AS m, count(*)::DOUBLE AS n, sum(u) AS s1, sum(u**2) AS s2, sum(u**3) AS s3, sum(u**4) AS s4, sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2, sum(y*y) AS yy, var_pop(y) AS vy FROM u GROUP BY 1),
d AS (SELECT *, n*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS det FROM s),
k AS (SELECT *, (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2)) / det AS d0, (n*(t1*s4 - t2*s3) - t0*(s1*s4 - s3*s2) + s2*(s1*t2 - t1*s2)) / det AS d1, (n*(s2*t2 - s3*t1) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2)) / det AS d2 FROM d)
SELECT p_brand, n::BIGINT AS n, round(d0 - d1*m + d2*m*m, 3) AS c0, round(d1 - 2*d2*m, 4) AS c1, round(d2, 5) AS c2, round(1 - (yy - d0*t0 - d1*t1 - d2*t2) / (vy*n), 6) AS r2 FROM k""")
def quadratic_fit(t: Tables) -> DataFrame:
    """R5."""
    fit = stats.polynomial(t.part, ["p_brand"], "p_size", "p_retailprice", 2)
    return fit.select("p_brand", "n", F.round("c0", 3).alias("c0"), F.round("c1", 4).alias("c1"), F.round("c2", 5).alias("c2"), F.round("r2", 6).alias("r2"))


@query("""WITH p AS (SELECT p_brand, ln(p_size) AS x, ln(p_retailprice) AS y, p_size, p_retailprice AS o FROM part WHERE p_size > 0 AND p_retailprice > 0), f AS (SELECT p_brand, regr_slope(y, x) AS b, exp(regr_intercept(y, x)) AS a, avg(o) AS mo FROM p GROUP BY 1)
SELECT p_brand, round(any_value(a), 4) AS a, round(any_value(b), 7) AS b, round(1 - sum((o - a * p_size ** b) ** 2) / sum((o - mo) ** 2), 6) AS r2 FROM p JOIN f USING (p_brand) GROUP BY 1""")
def power_fit(t: Tables) -> DataFrame:
    """R6."""
    fit = stats.transformed_fit(t.part, ["p_brand"], "p_size", "p_retailprice", "power")
    return fit.select("p_brand", F.round("a", 4).alias("a"), F.round("b", 7).alias("b"), F.round("r2", 6).alias("r2"))


@query()
def model_rank(t: Tables) -> DataFrame:
    """Six model families per brand, ranked."""
    return stats.rank_models(t.part, ["p_brand"], "p_size", "p_retailprice")


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_quantity) AS nx, regr_slope(l_extendedprice, l_quantity) AS slope, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round(slope, 5) AS slope, round(r2, 8) AS r2 FROM g WHERE n >= 3 AND nx >= 3""")
def tiered_regression(t: Tables) -> DataFrame:
    """R11."""
    fit = stats.tiered(t.lineitem, ["l_returnflag"], "l_linestatus", "l_quantity", "l_extendedprice")
    return fit.select("l_returnflag", "l_linestatus", "n", F.round("slope", 5).alias("slope"), F.round("r2", 8).alias("r2"))


LINE = """WITH p AS (SELECT p_brand, p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part), g AS (SELECT p_brand, count(*) AS n, count(DISTINCT x) AS nx, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2 FROM p GROUP BY 1),
e AS (SELECT p.*, g.*, y - a - b * x AS e, 1.0 / n + (x - mx) ** 2 / sxx AS h, (1 - r2) * syy AS sse FROM p JOIN g USING (p_brand))"""


@query(LINE + " SELECT p_brand, count(*) AS n, round(sqrt(sum((e / (1 - h)) ** 2) / count(*)), 4) AS loo_rmse, round(1 - sum((e / (1 - h)) ** 2) / any_value(syy), 6) AS loo_r2 FROM e WHERE n >= 4 AND sxx > 0 GROUP BY 1")
def loocv(t: Tables) -> DataFrame:
    """R16."""
    fit = stats.leave_one_out(t.part, ["p_brand"], "p_size", "p_retailprice")
    return fit.select("p_brand", "n", F.round("loo_rmse", 4).alias("loo_rmse"), F.round("loo_r2", 6).alias("loo_r2"))


@query(LINE + """, c AS (SELECT p_brand, n, e, h, syy, b, a, r2, sse, n >= 4 AND nx >= 3 AND e * e / (2 * CASE WHEN sse > 0 THEN sse / (n - 2) ELSE 1 END) * h / (1 - h + 1e-12) > 4.0 / n AS influential FROM e)
SELECT p_brand, any_value(n) AS n, round(any_value(b), 6) AS slope, round(any_value(r2), 6) AS r2, round(1 - (1 - any_value(r2)) * (any_value(n) - 1) / (any_value(n) - 2), 6) AS adjusted_r2, round(sqrt(sum((e / (1 - h)) ** 2) / count(*)), 4) AS loo_rmse, count(*) FILTER (WHERE influential) AS n_influential FROM c GROUP BY 1""")
def line_diagnostics(t: Tables) -> DataFrame:
    """The line of each brand with adjusted R², cross-validation and influential points."""
    d = stats.diagnostics(t.part, ["p_brand"], "p_size", "p_retailprice")
    return d.select("p_brand", "n", *[F.round(c, k).alias(c) for c, k in (("slope", 6), ("r2", 6), ("adjusted_r2", 6), ("loo_rmse", 4))], "n_influential")


@query(LINE + """, c AS (SELECT p_partkey, h, n, e * e / (2 * CASE WHEN sse > 0 THEN sse / (n - 2) ELSE 1 END) * h / (1 - h + 1e-12) AS cook FROM e WHERE n >= 4 AND nx >= 3)
SELECT p_partkey, round(h, 8) AS leverage, round(cook, 8) AS cook, cook > 4.0 / n AS influential FROM c""")
def cooks(t: Tables) -> DataFrame:
    """R18."""
    d = stats.cooks_distance(t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")
    return d.select("p_partkey", F.round("leverage", 8).alias("leverage"), F.round("cook", 8).alias("cook"), "influential")


@query("""WITH p AS (SELECT p_brand, p_type, p_size::DOUBLE AS x, p_retailprice AS y FROM part), k AS (SELECT DISTINCT p_brand, p_type FROM part),
f AS (SELECT k.p_brand, k.p_type, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM k JOIN p ON p.p_brand = k.p_brand AND p.p_type <> k.p_type GROUP BY 1, 2)
SELECT p.p_brand, p.p_type, count(*) AS n, round(sqrt(avg((y - a - b * x) ** 2)), 4) AS fold_rmse FROM p JOIN f USING (p_brand, p_type) WHERE f.n >= 3 AND sxx > 1e-12 GROUP BY 1, 2""")
def group_cv(t: Tables) -> DataFrame:
    """Each type of a brand predicted by the brand's other types."""
    cv = stats.leave_group_out(t.part, ["p_brand"], "p_type", "p_size", "p_retailprice")
    return cv.select("p_brand", "p_type", "n", F.round("fold_rmse", 4).alias("fold_rmse"))


@query("""WITH e AS (SELECT p_brand, min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, arg_min(p_retailprice, (p_size, p_retailprice)) AS y0, arg_max(p_retailprice, (p_size, p_retailprice)) AS y1, avg(p_retailprice) AS my FROM part GROUP BY 1),
f AS (SELECT *, (y1 - y0) / nullif(x1 - x0, 0) AS b FROM e) SELECT p_brand, round(any_value(b), 6) AS slope, round(1 - sum((p_retailprice - (y0 - b * x0) - b * p_size) ** 2) / sum((p_retailprice - my) ** 2), 6) AS r2 FROM part JOIN f USING (p_brand) GROUP BY 1""")
def endpoint_baseline(t: Tables) -> DataFrame:
    """R4."""
    fit = stats.endpoint_line(t.part, ["p_brand"], "p_size", "p_retailprice")
    return fit.select("p_brand", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query("""WITH g AS (SELECT p_brand, count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS sx, sum(p_retailprice) AS sy, sum(p_size * p_size)::DOUBLE AS xx, sum(p_size * p_retailprice) AS xy, stddev_pop(p_size) AS dx, stddev_pop(p_retailprice) AS dy FROM part GROUP BY 1),
a AS (SELECT *, 1 / (20 * dy / dx) ** 2 AS p1, 1 / (20 * dy) ** 2 AS p2, sy / n AS m FROM g), b AS (SELECT *, (xx + p1) * (n + p2) - sx * sx AS det FROM a)
SELECT p_brand, n::BIGINT AS n, round(((n + p2) * xy - sx * (sy + p2 * m)) / det, 6) AS slope, round(((xx + p1) * (sy + p2 * m) - sx * xy) / det, 3) AS intercept, round(2 * (2 + n / 2), 6) AS dof FROM b""")
def bayes_moments(t: Tables) -> DataFrame:
    """R20."""
    fit = stats.bayes_line(t.part, ["p_brand"], "p_size", "p_retailprice")
    return fit.select("p_brand", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("dof", 6).alias("dof"))


@query("""WITH g AS (SELECT p_brand, count(*)::DOUBLE AS n, sum(p_size)::DOUBLE AS sx, sum(p_retailprice) AS sy, sum(p_size * p_size)::DOUBLE AS xx, sum(p_size * p_retailprice) AS xy, sum(p_retailprice * p_retailprice) AS yy, stddev_pop(p_size) AS dx, stddev_pop(p_retailprice) AS dy FROM part GROUP BY 1),
a AS (SELECT *, 1 / (20 * dy / dx) ** 2 AS p1, 1 / (20 * dy) ** 2 AS p2, sy / n AS m, dy * dy / 2 AS b0 FROM g), b AS (SELECT *, (xx + p1) * (n + p2) - sx * sx AS det, sy + p2 * m AS b2, yy + p2 * m * m AS base FROM a),
q AS (SELECT *, base - ((n + p2) * xy * xy - 2 * sx * xy * b2 + (xx + p1) * b2 * b2) / det AS line, base - b2 * b2 / (n + p2) AS flat FROM b)
SELECT p_brand, round(0.5 * (ln(p1 * p2) - ln(det)) - 0.5 * (ln(p2) - ln(n + p2)) - (2 + n / 2) * (ln(b0 + 0.5 * line) - ln(b0 + 0.5 * flat)), 5) AS log_bf FROM q""")
def bayes_factor(t: Tables) -> DataFrame:
    """R21."""
    return stats.bayes_factor(t.part, ["p_brand"], "p_size", "p_retailprice").select("p_brand", F.round("log_bf", 5).alias("log_bf"))


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS r FROM n) SELECT p_brand, p_type, n FROM r WHERE r = 1""")
def dominant_value(t: Tables) -> DataFrame:
    """A9."""
    return stats.mode(t.part, ["p_brand"], "p_type", "p_partkey")


@query("""SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round((avg(c_acctbal) - 4000) / stddev_samp(c_acctbal) * sqrt(count(*)), 6) AS t, round((avg(c_acctbal) - 4000) / stddev_samp(c_acctbal), 6) AS cohens_d,
 count(*) FILTER (WHERE c_acctbal > 4000) AS above, count(*) FILTER (WHERE c_acctbal < 4000) AS below FROM customer GROUP BY 1""")
def t_stat(t: Tables) -> DataFrame:
    """A17."""
    g = stats.one_sample(t.customer, ["c_nationkey"], "c_acctbal", 4000.0)
    return g.select("c_nationkey", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("t", 6).alias("t"), F.round("cohens_d", 6).alias("cohens_d"), "above", "below")


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 5) AS q1, round(quantile_cont(c_acctbal, 0.5), 5) AS median, round(quantile_cont(c_acctbal, 0.75), 5) AS q3 FROM customer GROUP BY 1")
def median_iqr(t: Tables) -> DataFrame:
    """A14."""
    q = stats.median_iqr(t.customer, ["c_mktsegment"], "c_acctbal")
    return q.select("c_mktsegment", *[F.round(c, 5).alias(c) for c in ("q1", "median", "q3")])


@query("""WITH s AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v FROM part GROUP BY 1), q AS (SELECT p_brand, len(v) AS n, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS median, v[3 * len(v) // 4 + 1] AS q3, v[1] AS lo, v[len(v)] AS hi FROM s)
SELECT p_brand, n, median, round(least(CASE WHEN n >= 8 THEN greatest(lo, q1 - 1.5 * (q3 - q1)) ELSE lo END, median * 0.5), 5) AS low, round(greatest(CASE WHEN n >= 8 THEN least(hi, q3 + 1.5 * (q3 - q1)) ELSE hi END, median * 2), 5) AS high FROM q""")
def robust_range(t: Tables) -> DataFrame:
    """A8, Q10."""
    r = stats.robust_range(t.part, ["p_brand"], "p_retailprice")
    return r.select("p_brand", "n", "median", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


# --- search over a grid ---


@query("""WITH g AS (SELECT a.x AS x, b.x AS y, c.x AS z FROM (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) a(x), (VALUES (300.0), (400.0), (500.0)) b(x), (VALUES (1.0), (2.0), (3.0)) c(x)),
s AS (SELECT n_nationkey, x, y, z, x * (1 - x) * 4 - abs(y - 300 - 8 * n_nationkey) / 1000 + z / 100 AS score FROM nation, g), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, x DESC, y DESC, z DESC) AS r FROM s)
SELECT n_nationkey, round(score, 6)::DOUBLE AS score, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM r WHERE r = 1""")
def grid_search(t: Tables) -> DataFrame:
    """An exhaustive 5 x 3 x 3 grid per hypothesis."""
    g = search_space.grid(t.spark, {"x": [0.1, 0.3, 0.5, 0.7, 0.9], "y": [300.0, 400.0, 500.0], "z": [1.0, 2.0, 3.0]})
    every = t.nation.select("n_nationkey").crossJoin(F.broadcast(g))  # 45 literal rows
    score = F.col("x") * (1 - F.col("x")) * 4 - F.abs(F.col("y") - 300 - 8 * F.col("n_nationkey")) / 1000 + F.col("z") / 100
    return search_space.best_of(every, ["n_nationkey"], F.round(score, 9), [F.col("x"), F.col("y"), F.col("z")]).withColumn("score", F.round("score", 6))


@query()
def bayesian_search(t: Tables) -> DataFrame:
    """Gaussian-process search, one task per nation and seed."""
    h = t.nation.select(F.col("n_nationkey").alias("hypothesis"))

    def score_of(row):
        at = (int(row["hypothesis"]) + 1) / 26
        return lambda x: float(1 - (x[0] - at) ** 2 - 0.1 * abs(x[1] - 400) / 400)

    return search_space.search_all(h, 10, score_of, [(0.0, 1.0), (200.0, 800.0)], iterations=30).groupBy("hypothesis", "seed").agg(F.max("best_score").alias("best_score"), F.count(F.lit(1)).alias("evaluations"))


def _grid_steps(states: np.ndarray) -> np.ndarray:
    """45 neighbours of a state: five shares, three temperatures and three pressures around it."""
    steps = np.array([(a, b, c) for a in (-0.2, -0.1, 0.0, 0.1, 0.2) for b in (-50.0, 0.0, 50.0) for c in (-1.0, 0.0, 1.0)])
    return states[:, None, :] + steps[None]


@query()
def tree_search(t: Tables) -> DataFrame:
    """A tree search for every item, whose best share and temperature follow from its price and size; the ten most visited nodes."""
    h = t.items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.coalesce(F.max("price"), F.lit(0.0)).alias("price"), F.coalesce(F.max("size"), F.lit(0)).alias("size"))

    def score(rows, states):
        share, warm = rows["price"].to_numpy() % 100 / 100, 300 + rows["size"].to_numpy() * 4.0
        return 1 / (1 + 4 * (states[:, 0] - share) ** 2 + ((states[:, 1] - warm) / 200) ** 2 + 0.05 * (states[:, 2] - 2) ** 2)

    nodes = search_space.tree_search(h, "item_id", ["share", "temperature", "pressure"], [0.5, 350.0, 1.0], _grid_steps, score, 100)
    return search_space.top_visited(nodes.withColumn("value", F.col("value") * F.col("visits")), ["item_id"])


@query()
def slack_fit(t: Tables) -> DataFrame:
    """Each item's amounts over quantities, taken as energies over temperatures, from several starts."""
    rows = t.sale_lines.select("item_id", (F.col("quantity") * 10.0).alias("t"), (F.col("amount") / F.nullif("quantity", F.lit(0))).alias("e"))
    return resampling.slack_fit(rows.where("item_id IS NOT NULL AND e > 0"), "item_id", "t", "e")


@query("""WITH d AS (SELECT n_nationkey AS hypothesis, unnest(range(0, 40)) AS draw FROM nation),
v AS (SELECT hypothesis, ('0x' || left(md5(hypothesis || '|' || draw || '|7:x'), 7))::BIGINT / 268435456.0 AS x, 200 + ('0x' || left(md5(hypothesis || '|' || draw || '|7:y'), 7))::BIGINT / 268435456.0 * 600 AS y FROM d)
SELECT hypothesis, round(max(1 - (x - (hypothesis + 1) / 26.0) ** 2 - 0.1 * abs(y - 400) / 400), 6) AS best_score FROM v GROUP BY 1""")
def random_search(t: Tables) -> DataFrame:
    """B6."""
    h = t.nation.select(F.col("n_nationkey").alias("hypothesis"))
    at = (F.col("hypothesis") + 1) / 26
    draws = search_space.random_search(h, {"x": (0.0, 1.0), "y": (200.0, 800.0)}, lambda v: 1 - F.pow(v["x"] - at, 2) - 0.1 * F.abs(v["y"] - 400) / 400, 40, 7)
    return draws.groupBy("hypothesis").agg(F.round(F.max("score"), 6).alias("best_score"))


# --- event logs ---


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(t: Tables) -> DataFrame:
    """T6."""
    return windows.running_best(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", "user_id", "best")


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i""")
def breaker_streaks(t: Tables) -> DataFrame:
    """T8, X7."""
    return windows.failure_streaks(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "streak")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id FROM r WHERE r <= 5")
def last_n(t: Tables) -> DataFrame:
    """T7."""
    return windows.last_n(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id")


@query("SELECT event_type, coalesce(min(event_id) FILTER (WHERE value < 50), -1) AS below_50, coalesce(min(event_id) FILTER (WHERE value < 25), -1) AS below_25, coalesce(min(event_id) FILTER (WHERE value < 10), -1) AS below_10 FROM events GROUP BY 1")
def threshold_crossing(t: Tables) -> DataFrame:
    """X8."""
    return windows.first_crossings(t.events, ["event_type"], "event_id", F.col("value") / 100, [0.5, 0.25, 0.1]).na.fill(-1)


@query("SELECT user_id, count(DISTINCT round(value, 6)) AS n_distinct, round(max(value) - min(value), 6) AS spread, count(*) AS n, count(DISTINCT round(value, 6)) <= 2 OR (max(value) - min(value) < 1e-6 AND count(*) >= 2) AS stalled FROM events GROUP BY 1")
def stall_detection(t: Tables) -> DataFrame:
    """A27."""
    return quality.stalled(t.events, ["user_id"], "value").withColumn("spread", F.round("spread", 6))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users, bool_or(value > 99) AS any_top, bool_and(value >= 0) AS all_valid FROM events GROUP BY 1""")
def report_counters(t: Tables) -> DataFrame:
    """A10, A12, A22, A30."""
    v = F.col("value")
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v > 50).alias("n_high"), F.round(F.avg(v), 6).alias("mean"), F.countDistinct("user_id").alias("users"), F.bool_or(v > 99).alias("any_top"), F.bool_and(v >= 0).alias("all_valid")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, left(sha256('{\"user\": ' || user_id || '}'), 16) AS call FROM events")
def json_extract(t: Tables) -> DataFrame:
    """A field of a JSON text, and a stable parameter hash."""
    from ..functions.text import parameter_hash

    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), parameter_hash(user="user_id").alias("call"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    """Hourly counts (the batch form of streaming.hourly)."""
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session_counts(t: Tables) -> DataFrame:
    """Sessions with a gap of six hours."""
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_artefacts(t: Tables) -> DataFrame:
    """Expected but not present."""
    return resolve.missing_keys(t.customer.select(F.col("c_custkey")), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
