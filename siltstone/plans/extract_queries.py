"""Extraction, entity, fitting and matching operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entities, fixed, scores, text
from ..operators import extract, resampling, resolve, stats, symbolic
from . import discovery
from .registry import Tables, query

UNITS = "', '".join(sorted(set(fixed.UNITS_A.values())))


@query()
def model_comparison(t: Tables) -> DataFrame:
    """Pairs, line against parabola, nested F, verdict; over a table rendered from the parts of each brand."""
    line = F.format_string("| %d | %s |", "p_size", F.round("p_retailprice", 2).cast("string"))
    head = F.lit("| T (K) | Capacity (mmol/g) |\n|---|---|\n")
    docs = t.part.where("p_size > 0").groupBy("p_brand").agg(F.concat(head, F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
    return discovery.compare_models(docs, "p_brand", "text", ["K"], ["mmol/g"])


@query(r"""WITH e AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)\b(?:stability|degradation|lifetime|durability|cyclability|coulombic efficiency)\b'), regexp_extract_all(text, '(?i)\b(?:band gap|conductivity|resistivity|capacitance|dielectric|permittivity)\b'),
 regexp_extract_all(text, '(?i)\b(?:thermal conductivity|thermal expansion|specific heat|heat capacity)\b'), regexp_extract_all(text, '(?i)\b(?:figure of merit|ZT|Seebeck coefficient|carrier mobility|carrier concentration)\b'), regexp_extract_all(text, '(?i)\b(?:adsorption capacity|uptake|permeability|permeance|separation factor)\b')), lambda x: lower(x)))) AS p FROM documents)
SELECT doc_id, array_to_string(p[1:50], ',') AS properties FROM e""")
def document_properties(t: Tables) -> DataFrame:
    """P27."""
    return t.documents.select("doc_id", F.array_join(entities.document_entities("text", "properties"), ",").alias("properties"))


@query()
def candidate_scores(t: Tables) -> DataFrame:
    """Parts scored against the known prices of their brand and a text of their types."""
    known = t.part.where("p_partkey % 4 = 0").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_retailprice")).alias("known"), F.array_join(F.array_sort(F.collect_set("p_type")), "\n").alias("text"))
    rows = t.part.where("p_partkey % 4 <> 0")
    inputs = ["p_brand", "p_type", "p_retailprice"]  # what a score depends on: equal ones are scored once
    window = F.struct(F.lit(1000.0).alias("lo"), F.lit(1500.0).alias("hi"))
    s = scores.evidence_score(F.array(F.substring_index("p_type", " ", 1)), F.substring_index("p_type", " ", -1), F.col("text"), F.col("p_retailprice"), F.col("known"), F.col("p_type"), window, F.lit(0.0))
    scored = rows.select(*inputs).distinct().join(known, "p_brand").select(*[F.col(c).alias(f"_{c}") for c in inputs], s.alias("s"))
    same = [rows[c].eqNullSafe(scored[f"_{c}"]) for c in inputs]
    return rows.join(scored, same).select("p_partkey", "s.*")


@query()
def paper_dedupe(t: Tables) -> DataFrame:
    """Documents as papers in order of their id; equal or nearly equal titles without a DOI merge into the first."""
    papers = t.documents.select(F.col("doc_id").alias("ord"), F.left("text", F.lit(80)).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.9/"), F.md5("text"))).alias("doi"))
    return resolve.dedupe_papers(papers)




@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    """Intervals per nation, over the suppliers' key and balance."""
    return resampling.bootstrap(t.supplier, "s_nationkey", "s_suppkey", "s_acctbal", n_boot=500)


@query()
def gaussian_fit(t: Tables) -> DataFrame:
    """R10."""
    return resampling.gaussian_peak(t.supplier, "s_nationkey", "s_suppkey", "s_acctbal")


@query()
def symbolic_fit(t: Tables) -> DataFrame:
    """One expression per region, over its nations' customers."""
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("b")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return symbolic.symbolic_regression(n, "n_regionkey", "n", "b", generations=5, size=20)


@query(r"""SELECT event_id, CASE WHEN value < 20 THEN 'k' WHEN value < 60 THEN 'mmol/g' ELSE 'parsec' END AS unit, CASE WHEN value < 20 THEN 'temperature' WHEN value < 60 THEN 'capacity' ELSE 'parsec' END AS category, round(CASE WHEN value < 20 THEN value + 273.15 ELSE value END, 6) AS base FROM events""")
def unit_table(t: Tables) -> DataFrame:
    """Spellings to units, categories and base units."""
    raw = F.when(F.col("value") < 20, " K").when(F.col("value") < 60, "mmol / g").otherwise("parsec")
    u = t.events.select("event_id", "value", text.unit_a(raw).alias("unit"))
    base = text.to_base_unit(F.col("value"), F.when(F.col("unit") == "k", "°c").otherwise(F.col("unit")))
    return u.select("event_id", "unit", text.unit_category("unit").alias("category"), F.round(base, 6).alias("base"))
