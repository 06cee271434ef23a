"""Checked hypotheses: stand-ins, known ranges, first scores, plausibility, nested models, evidence of topics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import graph, resampling, stats
from . import discovery
from .registry import SQL, Tables, query

_SPELLED = "lower(replace(replace({0}, ' ', ''), '-', ''))"
_HOLDS = "(contains({0}, {1}) OR contains({1}, {0}))"


@query(f"""WITH h AS (SELECT item_id, {_SPELLED.format('name')} AS m FROM items), d AS (SELECT DISTINCT {_SPELLED.format('n')} AS k, p FROM (SELECT split_part(p_name, ' ', -1) AS n, p_type AS p FROM part UNION ALL SELECT p_name || ' mk-2', p_brand FROM part))
SELECT item_id, count(DISTINCT p) AS n_proxies, min(p) AS first FROM h JOIN d ON m <> '' AND k <> '' AND {_HOLDS.format('m', 'k')} GROUP BY item_id""")
def material_proxies(t: Tables) -> DataFrame:
    """Types and brands that stand in for items, by parts of names in either direction."""
    words = t.part.select(F.substring_index("p_name", " ", -1).alias("name"), F.col("p_type").alias("proxy"))
    marks = t.part.select(F.concat("p_name", F.lit(" mk-2")).alias("name"), F.col("p_brand").alias("proxy"))
    out = discovery.proxies_of(t.items.select(F.col("item_id").alias("id"), F.array("name").alias("materials")), words.unionByName(marks))
    return out.groupBy(F.col("id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_proxies"), F.min("proxy").alias("first"))


@query(f"""WITH h AS (SELECT item_id, {_SPELLED.format('name')} AS m, CASE item_id % 4 WHEN 0 THEN 'CO2 capacity' WHEN 1 THEN 'Isosteric heat' WHEN 2 THEN 'BET of a size' END AS p FROM items),
w AS (SELECT split_part(p_name, ' ', -1) AS name, min(p_size) AS s0, max(p_size) AS s1, min(p_partkey) AS k0, max(p_partkey) AS k1 FROM part GROUP BY 1),
r AS (SELECT name, 'capacity' AS kind, s0 AS lo, s1 AS hi, {_SPELLED.format('name')} AS k FROM w UNION ALL SELECT name, 'heat', k0, k1, {_SPELLED.format('name')} FROM w),
j AS (SELECT item_id, r.name, CASE WHEN kind = 'capacity' AND p = 'CO2 capacity' OR kind = 'heat' AND p = 'Isosteric heat' THEN r.name || ': ' || kind || ' = ' || lo || '-' || hi END AS line FROM h LEFT JOIN r ON m <> '' AND k <> '' AND {_HOLDS.format('m', 'k')})
SELECT item_id, count(DISTINCT name) AS found, coalesce(string_agg(DISTINCT line, '|' ORDER BY line), '') AS entries, CASE WHEN count(line) > 0 THEN 'validated' WHEN count(name) > 0 THEN 'inconclusive' ELSE 'pending' END AS validation_status FROM j GROUP BY item_id""")
def known_range_checks(t: Tables) -> DataFrame:
    """Items against the ranges of parts that share a name, by the kind that the property's words ask for."""
    k = F.col("item_id") % 4
    prop = F.when(k == 0, "CO2 capacity").when(k == 1, "Isosteric heat").when(k == 2, "BET of a size")
    hyps = t.items.select(F.col("item_id").alias("id"), F.array("name").alias("materials"), prop.alias("property"))
    word = t.part.groupBy(F.substring_index("p_name", " ", -1).alias("name"))
    known = word.agg(F.lit("capacity").alias("kind"), F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    known = known.unionByName(word.agg(F.lit("heat").alias("kind"), F.min("p_partkey").cast("long").alias("lo"), F.max("p_partkey").cast("long").alias("hi")))
    out = discovery.known_ranges(hyps, known)
    return out.select(F.col("id").alias("item_id"), "found", F.array_join("entries", "|").alias("entries"), "validation_status")


# The priors before they are rounded for comparison.
_PRIORS = SQL["literature_prior"].replace(", 6)", ", 15)")
_SCORED = f"""l AS ({_PRIORS}), p AS (SELECT p_partkey, p_brand, (CASE WHEN contains(lower(p_name), 'widget') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), lower(p_type)) THEN 1 ELSE 0 END) / 2.0 AS share,
 CASE WHEN contains(lower(p_name), 'cold') THEN 0.2 ELSE 0 END AS named, (p_size % 10) / 10.0 AS judged, ('0x' || left(md5('part ' || p_partkey), 6))::BIGINT % 1000 AS digest FROM part),
s AS (SELECT p_partkey, p_brand, nearest IS NULL AS degraded, least((CASE WHEN nearest IS NULL THEN 0.10 + 0.12 * (digest / 1000) ELSE least(0.15 + 0.25 * share + named + 0.35 * prior, 1) END) * 0.65 + judged * 0.35, 1) AS score FROM p JOIN l USING (p_partkey))"""


def _scored(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size", F.col("p_retailprice").alias("x"))
    canonical = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    return discovery.score_candidates(rows, "p_brand", "x", F.array(F.lit("Widget"), "p_type"), F.lit("Cold"), F.col("p_name"), canonical, (F.col("p_size") % 10) / 10)


@query(f"WITH {_SCORED} SELECT p_partkey, degraded, round(score, 6) AS score FROM s")
def first_scores(t: Tables) -> DataFrame:
    """Parts by the words of their names and the prices of their brand, blended with a plausibility."""
    return _scored(t).select("p_partkey", "degraded", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 6) DESC, p_partkey DESC) AS r FROM s) SELECT p_brand, p_partkey, round(score, 6) AS score FROM r WHERE r = 1")
def discovered_candidates(t: Tables) -> DataFrame:
    """The best part of each brand."""
    best = discovery.best_candidates(_scored(t).withColumn("score", F.round("score", 6)), "p_brand", "p_partkey")
    return best.select("p_brand", "p_partkey", "score")


@query("""WITH s AS (SELECT client_id, count(*) AS n, count(*) FILTER (WHERE status = 'open') AS lost, count(*) FILTER (WHERE priority >= 4) AS chain FROM sales WHERE client_id IS NOT NULL GROUP BY 1),
h AS (SELECT c.client_id, n, lost, coalesce(chain, 0) AS chain, 1 - lost / n AS share, (c.client_id * 37 % 97) / 97.0 AS confidence, CASE WHEN c.client_id % 2 = 0 THEN 'inconclusive' ELSE 'pending' END AS status FROM (SELECT DISTINCT client_id FROM clients WHERE client_id IS NOT NULL) c LEFT JOIN s USING (client_id)),
c AS (SELECT *, CASE WHEN share < 0.5 THEN greatest(round(confidence - (0.1 + (0.5 - share) * 0.2), 2), 0.1) ELSE confidence END AS c, CASE WHEN share IS NULL THEN 0 ELSE lost / n END AS miss FROM h),
p AS (SELECT *, greatest(0, least(1, 0.3 * least(chain / 5, 1) + 0.3 * (CASE WHEN miss >= 0.5 THEN least(share, 0.25) ELSE coalesce(share, 0.5) END) + 0.4 * c - CASE WHEN miss >= 0.5 THEN 0.15 * miss + 0.1 ELSE 0 END)) AS p FROM c)
SELECT client_id, round(p, 6)::DOUBLE AS plausibility, round(CASE WHEN p < 0.35 AND c > 0.7 THEN c * 0.7 + p * 0.3 ELSE c END, 6)::DOUBLE AS confidence, round(CASE WHEN p > 0 THEN 0.6 * confidence + 0.4 * p ELSE confidence END, 6)::DOUBLE AS blended,
 CASE WHEN p < 0.35 AND c > 0.7 THEN 'contested' WHEN p > 0.7 AND c < 0.5 AND status = 'inconclusive' THEN 'underexplored' ELSE status END AS validation_status FROM p""")
def settled_hypotheses(t: Tables) -> DataFrame:
    """Clients as hypotheses; their sales are claims, open ones not found, urgent ones evidence."""
    sold = t.sales.where("client_id is not null").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("status") == "open").alias("n_unverified"), F.collect_list(F.when(F.col("priority") >= 4, F.lit("e"))).alias("evidence_chain")
    )
    first = (F.col("client_id") * 37 % 97) / 97
    hyps = t.clients.where("client_id is not null").select("client_id").distinct().join(sold, "client_id", "left").withColumns(
        {"share": 1 - F.col("n_unverified") / F.col("n_claims"), "first": first, "validation_status": F.when(F.col("client_id") % 2 == 0, "inconclusive").otherwise("pending")}
    )
    hyps = hyps.withColumn("confidence", F.when(F.col("share").isNull(), first).otherwise(scores.claim_confidence(first, F.col("share"))))
    out = discovery.settle(discovery.plausibility(hyps)).withColumn("blended", discovery.blend(F.col("first"), F.col("plausibility")))
    return out.select("client_id", *[F.round(c, 6).alias(c) for c in ("plausibility", "confidence", "blended")], "validation_status")


@query(f"""WITH q AS ({SQL["quadratic_fit"]}), f AS (SELECT p_brand, n, r2, CASE WHEN n > 3 AND r2 < 1 THEN greatest((r2 / 2) / ((1 - r2) / (n - 3)), 0) END AS f FROM q), p AS (SELECT *, (1 + 2 * f / (n - 3)) ** (-(n - 3) / 2) AS p FROM f)
SELECT p_brand, round(f, 6) AS f, round(p, 8) AS p, CASE WHEN r2 IS NULL OR isnan(r2) THEN 'insufficient' WHEN r2 < -0.02 THEN 'candidate_worse' WHEN r2 >= 0.05 AND coalesce(p < 0.05, false) THEN 'candidate_better' WHEN r2 >= 0.05 THEN 'candidate_possible' ELSE 'no_improvement' END AS verdict FROM p""")
def nested_models(t: Tables) -> DataFrame:
    """A parabola against the mean of each brand: F, its tail (in closed form for two degrees of freedom in SQL), verdict."""
    fit = stats.polynomial(t.part, ["p_brand"], "p_size", "p_retailprice", 2).select("p_brand", "n", F.round("r2", 6).alias("r2"))
    f = stats.nested_f(F.col("n"), F.lit(1.0), 1, 1 - F.col("r2"), 3)
    tested = resampling.f_test(fit.withColumns({"f": f, "d1": F.lit(2), "d2": F.col("n") - 3}), "f", "d1", "d2")
    verdict = resampling.model_verdict(F.col("r2"), F.lit(0.0), F.col("p") < 0.05, F.lit(None).cast("double"))
    return tested.select("p_brand", F.round("f", 6).alias("f"), F.round("p", 8).alias("p"), verdict.alias("verdict"))


@query("""WITH o AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS own FROM orders GROUP BY 1), n AS (SELECT c_nationkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS topic FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, coalesce(own, topic, '') AS evidence, own IS NULL AS from_topic FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN n USING (c_nationkey)""")
def topic_evidence(t: Tables) -> DataFrame:
    """Evidence of customers, that of their nation where they have none of their own."""
    entities = t.customer.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("topic"))
    out = graph.evidence_or_topic(entities, t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("item")))
    return out.select(F.col("entity").alias("c_custkey"), F.array_join("evidence", ",").alias("evidence"), "from_topic")
