"""Hypotheses: made from gaps, checked for substance, matched with external records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import PROPERTY_TERMS, QUERY_STOPWORDS
from ..functions.text import col, filled
from ..session import cut
from .graph import named_in
from .resolve import capped
from .runs import ranks

# Substantial words of phrases in Chinese, and names with digits.
_SUBSTANCE = "吸附|容量|选择性|稳定性|热|亲水|疏水|比例|湿|效率|浓度|再生|能耗|缺陷|位点"
_NAME_WITH_DIGIT = r"[A-Z][A-Za-z0-9\-/]*\d[A-Za-z0-9\-/]*"
# Properties that the formation energy stands for, and band gaps.
_BY_ENERGY = "formation energy|形成能|稳定性|stability|衰减|co2|吸附|adsorption|capacity|容量|qst|吸附热|结合能"
_BY_GAP = "band gap|bandgap|带隙"


def severe(gaps: DataFrame) -> DataFrame:
    """gaps of high or medium severity."""
    return gaps.where(F.col("severity").isin("high", "medium"))


def degraded(rows: DataFrame) -> DataFrame:
    """adds degraded and degraded_reason: an explanation that says so, or a frame without material and property, or without a title."""
    said = F.lower(F.coalesce("llm_explanation", F.lit(""))).rlike("llm api 不可用|degraded")
    bare = (F.size(F.coalesce("materials", F.array().cast("array<string>"))) == 0) & filled("property").isNull() | filled(F.trim(F.coalesce("title", F.lit("")))).isNull()
    reason = F.when(said, "explanation unavailable").when(bare, "placeholder frame")
    return rows.withColumns({"degraded": said | bare, "degraded_reason": reason})


def from_gaps(gaps: DataFrame, materials: DataFrame, properties: DataFrame, paragraphs: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """Hypotheses from the gaps of reports: (id, doc, gap, type, title, materials, property, confidence, novelty_score).

    gaps (doc, gap, type, severity, title, description, entities), materials (material), properties (property, ord),
    paragraphs (text).  Unexplored: materials without the gap's property, ten at most.  Missing link: materials that
    share paragraphs with both of the first two entities, else the first five materials; eight at most.  Contradiction:
    one.  Names are taken in order; ids count by report and type.  Names count wherever a text contains them, in either case;
    null and empty ones never.
    """
    most = {"unexplored": 10, "missing_link": 8, "contradiction": 1} | (most or {})
    gaps = severe(gaps)
    # The first known property that a gap's description names.
    told = gaps.select(F.struct("doc", "gap").alias("at"), "description")
    named = named_in(told, "at", "description", properties, "property").join(properties, F.col("name") == F.col("property"))
    target = named.groupBy("id.doc", "id.gap").agg(F.min_by("property", "ord").alias("property"))
    gaps = gaps.join(target, ["doc", "gap"], "left").withColumn("property", F.coalesce("property", F.lit("")))

    links = gaps.where((F.col("type") == "missing_link") & (F.size("entities") >= 2)).select("doc", "gap", "type", "title", F.get("entities", F.lit(0)).alias("a"), F.get("entities", F.lit(1)).alias("b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    names = materials.select("material").where("material <> ''").distinct()
    # Paragraphs by a digest of what they say; one pass over them finds names of all three kinds.
    told = paragraphs.select(F.unhex(F.md5(F.lower("text"))).alias("at"), "text")
    looked = names.select(F.col("material").alias("name")).unionByName(properties.select(F.col("property").alias("name"))).unionByName(ends.select(F.col("entity").alias("name")))
    found = cut(named_in(told, "at", "text", looked, "name"))
    at = found.join(names, F.col("name") == F.col("material")).select("id", "material")
    has = at.join(found, "id").join(properties, F.col("name") == F.col("property")).select("material", "property").distinct()

    # The first names without a property are among as many names as have it, and those asked for.
    asked = gaps.where("type = 'unexplored'")
    ordered = ranks(names, "material")
    width = 1000
    counts = asked.select("property").distinct().join(has.groupBy("property").agg(F.count(F.lit(1)).alias("n")), "property", "left")
    counts = counts.select("property", (F.coalesce("n", F.lit(0)) + most["unexplored"]).alias("reach"))
    blocks = counts.select("property", "reach", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("reach") - 1) / width))).alias("b"))
    reached = blocks.select("property", F.explode(F.sequence(F.col("b") * width + 1, F.least(F.col("b") * width + width, "reach"))).alias("rank"))
    lacking = reached.join(ordered, "rank").join(has, ["material", "property"], "left_anti").drop("rank")
    lacking = capped(lacking, ["property"], [F.col("material")], most["unexplored"])
    what = lambda other: F.coalesce(filled("property"), F.lit(other))
    unexplored = asked.join(lacking, "property").select(
        "doc", "gap", "type", F.lower("material").alias("rank"), F.concat(F.lower("material"), F.lit(" may exhibit enhanced "), what("target property")).alias("title"),
        F.array(F.lower("material")).alias("materials"), what("unknown").alias("property"), F.lit(0.4).alias("confidence"), F.lit(0.8).alias("novelty_score"),
    )

    met = at.join(found, "id").join(ends, F.col("name") == F.col("entity")).select("material", "entity").distinct()
    one, two = (met.withColumnRenamed("entity", x) for x in ("a", "b"))
    bridges = links.join(one, "a").join(two, ["b", "material"]).select("doc", "gap", "type", "title", "a", "b", "material")
    first = ordered.where("rank <= 5").select("material")
    others = links.join(bridges.select("doc", "gap").distinct(), ["doc", "gap"], "left_anti").crossJoin(F.broadcast(first))  # five names
    bridges = capped(bridges.unionByName(others.select(*bridges.columns)), ["doc", "gap"], [F.col("material")], most["missing_link"])
    linked = bridges.select(
        "doc", "gap", "type", F.col("material").alias("rank"), F.concat(F.lit("Bridge: "), "material", F.lit(" → "), F.left("title", F.lit(60))).alias("title"),
        F.array("material", "a", "b").alias("materials"), F.lit("").alias("property"), F.lit(0.35).alias("confidence"), F.lit(0.6).alias("novelty_score"),
    )
    resolved = gaps.where("type = 'contradiction'").select(
        "doc", "gap", "type", F.lit("").alias("rank"), F.concat(F.lit("Resolution: "), F.left("title", F.lit(80))).alias("title"),
        F.slice("entities", 1, 5).alias("materials"), "property", F.lit(0.3).alias("confidence"), F.lit(0.9).alias("novelty_score"),
    )
    rows = unexplored.unionByName(linked).unionByName(resolved)
    number = F.row_number().over(Window.partitionBy("doc", "type").orderBy("gap", "rank"))
    kind = F.when(F.col("type") == "missing_link", "link").when(F.col("type") == "contradiction", "contra").otherwise(F.col("type"))
    return rows.withColumn("id", F.concat(F.lit("hypo_"), kind, F.lit("_"), number.cast("string"))).drop("rank")


def _plain(tokens: Column) -> Column:
    """Entries that can be searched for: two characters or more, no stop word, no bare number."""
    return F.filter(F.transform(tokens, lambda e: F.trim(e)), lambda e: (F.length(e) >= 2) & ~F.lower(e).isin(QUERY_STOPWORDS) & ~e.rlike(r"^\d+$"))


def query_entities(title: Column, description: Column, materials: Column, prop: Column, relation: Column, most: int = 12) -> Column:
    """What a novelty search can ask for: materials, then names and property words of the fields, then mixed or substantial
    phrases in Chinese; first of equal ones, twelve at most, none unless one is concrete."""
    fields = F.transform(F.array(title, description, prop, relation), lambda f: F.coalesce(f, F.lit("")))
    tokens = F.flatten(F.transform(fields, lambda f: F.regexp_extract_all(f, F.lit(r"[A-Za-z][A-Za-z0-9\-/.]{1,40}"), F.lit(0))))
    telling = F.filter(tokens, lambda t: F.lower(t).isin(PROPERTY_TERMS) | t.rlike(r"\d") | t.rlike("^[A-Z]") & (F.length(t) <= 8))
    chunks = F.flatten(F.transform(fields, lambda f: F.regexp_extract_all(f, F.lit(r"[一-鿿A-Za-z0-9\-]{2,80}"), F.lit(0))))
    phrases = F.filter(chunks, lambda c: c.rlike(r"[一-鿿]") & c.rlike(f"[A-Za-z0-9]|{_SUBSTANCE}"))
    every = _plain(F.concat(F.coalesce(materials, F.array().cast("array<string>")), telling, phrases))
    keys = F.transform(every, lambda e: F.regexp_replace(F.lower(e), r"\s+", " "))
    pairs = F.transform(every, lambda e, i: F.struct(e.alias("e"), i.alias("i"), F.regexp_replace(F.lower(e), r"\s+", " ").alias("k")))
    first = F.transform(F.filter(pairs, lambda p: F.array_position(keys, p["k"]) == p["i"] + 1), lambda p: p["e"])
    concrete = F.exists(first, lambda e: e.rlike(_NAME_WITH_DIGIT) | e.rlike(r"[一-鿿]"))
    return F.when(concrete, F.slice(first, 1, most)).otherwise(F.array().cast("array<string>"))


def nomad_entries(payload: Column | str, most: int = 10) -> Column:
    """struct(total, formulas, entry_ids) of a NOMAD response in JSON."""
    shape = "struct<pagination:struct<total:long>,data:array<struct<entry_id:string,results:struct<material:struct<chemical_formula_hill:string,chemical_formula:string>>>>>"
    p = F.from_json(col(payload), shape)
    names = F.transform(p["data"], lambda d: F.coalesce(filled(d["results"]["material"]["chemical_formula_hill"]), filled(d["results"]["material"]["chemical_formula"])))
    some = lambda a: F.coalesce(F.slice(F.filter(a, lambda x: x.isNotNull()), 1, most), F.array().cast("array<string>"))
    total = F.coalesce(F.nullif(p["pagination"]["total"], F.lit(0)), F.size(p["data"]).cast("long"), F.lit(0))
    return F.struct(F.greatest(total, F.lit(0)).alias("total"), some(names).alias("formulas"), some(F.transform(p["data"], lambda d: filled(d["entry_id"]))).alias("entry_ids"))


def oqmd_entries(rows: DataFrame, formula: str, payload: str) -> DataFrame:
    """OQMD records in JSON under any of their names for the formation energy; records without one are dropped."""
    p = F.from_json(col(payload), "name string, delta_e double, formation_energy double, formation_energy_per_atom double, stability double, band_gap double")
    out = rows.select(F.col(formula).alias("requested_formula"), p.alias("p")).withColumn("delta_e", F.coalesce("p.delta_e", "p.formation_energy", "p.formation_energy_per_atom"))
    return out.where("delta_e is not null").select("requested_formula", F.coalesce(filled("p.name"), "requested_formula").alias("formula"), F.round("delta_e", 4).alias("delta_e"), "p.stability", "p.band_gap")


def external_entries(hyps: DataFrame, entries: DataFrame) -> DataFrame:
    """Hypotheses (id, formula, property) with the external records of their formula: found, match and the matching lines."""
    rows = hyps.join(entries.withColumnRenamed("formula", "_name"), hyps["formula"] == entries["requested_formula"], "left")
    low = F.lower(F.coalesce("property", F.lit("")))
    three = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.round(c, 3)))
    energy = F.when(
        F.col("requested_formula").isNotNull() & low.rlike(_BY_ENERGY),
        F.concat("_name", F.lit(" (OQMD): formation_energy = "), three("delta_e"), F.lit(" eV/atom, stability = "), F.coalesce(three("stability"), F.lit("n/a")), F.lit(" eV/atom")),
    )
    gap = F.when(F.col("band_gap").isNotNull() & low.rlike(_BY_GAP), F.concat("_name", F.lit(" (OQMD): band_gap = "), F.col("band_gap").cast("string"), F.lit(" eV")))
    lines = F.filter(F.array(energy, gap), lambda x: x.isNotNull())
    return rows.withColumn("_l", lines).groupBy("id").agg(
        F.count("requested_formula").alias("found"), F.bool_or(F.size("_l") > 0).alias("match"), F.array_sort(F.flatten(F.collect_list("_l"))).alias("matching_entries")
    )
