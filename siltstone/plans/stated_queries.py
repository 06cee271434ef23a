"""Values, claims and evidence out of sentences rendered from the parts, where every row is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, quality, resampling
from .registry import Tables, query

UPTAKE, KELVIN = "(p_size / 2.0)::DECIMAL(9, 1)", "200 + p_size"


def _stated(t: Tables) -> DataFrame:
    half = F.format_string("%.1f", F.col("p_size") / 2.0)
    text = F.concat(
        F.lit("The uptake of "), half, F.lit(" mmol/g at a temperature of "), (200 + F.col("p_size")).cast("string"), F.lit(" K falls; the capacity of 3.5-"), (4 + F.col("p_size")).cast("string"), F.lit(" mmol/g holds.")
    )
    # Rows are dealt before they become texts: many parts lie in few bytes, which one task would read and search.
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t.part.select("p_partkey", "p_size").repartition(tasks).select("p_partkey", text.alias("text"))


VALUES = f"""SELECT p_partkey AS doc, (p_size / 2.0)::DOUBLE AS value, 'mmol/g' AS unit, {UPTAKE} || ' mmol/g' AS raw FROM part UNION ALL SELECT p_partkey, {KELVIN}, 'k', ({KELVIN}) || ' K' FROM part
UNION ALL SELECT p_partkey, 4 + p_size, 'mmol/g', (4 + p_size) || ' mmol/g' FROM part"""


@query(f"SELECT * FROM ({VALUES}) WHERE value > 0")
def stated_values(t: Tables) -> DataFrame:
    """Numbers with units."""
    return extract.values_with_context(_stated(t), "p_partkey", "text").select("doc", "value", "unit", "raw")


@query(f"""SELECT p_partkey AS doc, (p_size / 2.0)::DOUBLE AS low, (p_size / 2.0)::DOUBLE AS high, 'mmol/g' AS unit FROM part UNION ALL SELECT p_partkey, {KELVIN}, {KELVIN}, 'k' FROM part UNION ALL SELECT p_partkey, 3.5, 4 + p_size, 'mmol/g' FROM part""")
def stated_claims(t: Tables) -> DataFrame:
    """Claims as intervals."""
    return extract.claimed_values(_stated(t), "p_partkey", "text").select("doc", "low", "high", "unit")


@query(f"SELECT doc, value, unit FROM ({VALUES}) WHERE value > 0")
def stated_evidence(t: Tables) -> DataFrame:
    """U19."""
    return extract.evidence_values(_stated(t), "p_partkey", "text").select("doc", "value", "unit")


THETAS = [float(k) for k in range(1, 121)]


@query(f"""WITH g AS (SELECT unnest({THETAS}) AS theta), r AS (SELECT p_brand, theta, p_retailprice AS y, theta * (1 / ((exp(2 * least(theta / (2 * p_size), 350.0)) - 1) / (exp(2 * least(theta / (2 * p_size), 350.0)) + 1)) - 1) * 8.617333262e-5 AS u FROM part, g WHERE p_size > 0),
f AS (SELECT p_brand, theta, count(*) AS n, regr_r2(y, u) AS r2 FROM r GROUP BY 1, 2)
SELECT p_brand, round(max(r2), 6) AS best_r2 FROM f GROUP BY 1""")
def slack_grid(t: Tables) -> DataFrame:
    """The grid fit over 120 temperatures, size as temperature."""
    rows = t.part.where("p_size > 0")
    return resampling.slack_grid(rows, "p_brand", "p_size", "p_retailprice", THETAS).select("p_brand", F.round("r2", 6).alias("best_r2"))


# --- counters of reports and runs ---


@query("""SELECT s_nationkey AS run, count(*) AS total, count(*) FILTER (WHERE s_acctbal > 5000) AS validated, count(*) FILTER (WHERE s_acctbal BETWEEN 0 AND 5000) AS inconclusive,
 count(*) FILTER (WHERE s_acctbal / 10000 >= 0.5 AND s_suppkey % 2 = 0) AS strong, count(*) FILTER (WHERE s_acctbal / 10000 < 0.5 AND s_suppkey % 2 = 0) AS underexplored, count(*) FILTER (WHERE s_acctbal / 10000 >= 0.5 AND s_suppkey % 2 = 1) AS contested, count(*) FILTER (WHERE s_acctbal / 10000 < 0.5 AND s_suppkey % 2 = 1) AS weak FROM supplier GROUP BY 1""")
def outcome_counters(t: Tables) -> DataFrame:
    """Validated, inconclusive and quadrant counts of each run."""
    c = F.col("s_acctbal")
    status = F.when(c > 5000, "validated").when(c >= 0, "inconclusive").otherwise("pending")
    rows = t.supplier.select(F.col("s_nationkey").alias("run"), status.alias("status"), (c / 10000).alias("confidence"), F.when(F.col("s_suppkey") % 2 == 0, 1.0).otherwise(0.0).alias("novelty"))
    return quality.outcomes(rows, ["run"])


@query("SELECT l_orderkey AS doc, count(*) FILTER (WHERE l_returnflag = 'A') AS n_A, count(*) FILTER (WHERE l_returnflag = 'N') AS n_N, count(*) FILTER (WHERE l_returnflag = 'R') AS n_R, count(DISTINCT l_suppkey) AS n_groups FROM lineitem GROUP BY 1")
def provenance_counts(t: Tables) -> DataFrame:
    """Points by provenance, and distinct groups."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("provenance"), F.col("l_suppkey").alias("group"))
    return quality.provenance(rows, ["doc"], ["A", "N", "R"])


@query("""WITH f AS (SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_and(value >= 1) AS all_valid, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1)
SELECT user_id % 10 AS run, count(*) AS files, count(*) FILTER (WHERE any_error) AS with_error, count(*) FILTER (WHERE all_valid) AS valid, sum(clicks)::BIGINT AS clicks, bool_and(all_valid AND NOT any_error) AS passed FROM f GROUP BY 1""")
def run_checks(t: Tables) -> DataFrame:
    """Checks of each file over its events, rolled up by run."""
    rows = t.events.select((F.col("user_id") % 10).alias("run"), F.col("user_id").alias("file"), "event_type", "value")
    out = quality.event_checks(rows, "run", "file", {"with_error": F.col("event_type") == "error"}, {"valid": F.col("value") >= 1}, {"clicks": F.col("event_type") == "click"})
    return out.withColumn("passed", (F.col("valid") == F.col("files")) & (F.col("with_error") == 0))


@query("""WITH v AS (SELECT DISTINCT p_brand, round(p_retailprice, 4) AS v FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS k FROM v)
SELECT p_brand AS id, 1 AS n_blocks, 'zif-8' AS tokens, count(*)::INT AS n_values, min(v) AS lo, max(v) AS hi FROM k WHERE k <= 500 GROUP BY 1""")
def evidence_blocks(t: Tables) -> DataFrame:
    """Blocks, tokens, keywords and values of a text for a hypothesis about it."""
    line = F.format_string("- value of %s kJ/mol", F.round("p_retailprice", 4).cast("string"))
    docs = t.part.groupBy("p_brand").agg(F.concat(F.lit("# ZIF-8 in these and many other samples, with all of the values known of them\n"), F.array_join(F.collect_set(line), "\n")).alias("text"))
    hyps = docs.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("doc"), F.array(F.lit("12/ab")).alias("materials"), F.lit("Qst").alias("property"))
    out = extract.evidence_index(docs, "p_brand", "text", hyps)
    return out.select("id", F.size("blocks").alias("n_blocks"), F.array_join("material_tokens", ",").alias("tokens"), F.size("values").alias("n_values"), F.array_min("values").alias("lo"), F.array_max("values").alias("hi"))
