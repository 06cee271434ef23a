"""Composed plans: text to model comparison, hypotheses to a checked report, topics to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..functions.text import accepted_units, col
from ..operators import claims, extract, graph, resampling, runs, search_space, stats


def compare_models(docs: DataFrame, id_col: str, text_col: str, x_units: list[str] | None = None, y_units: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Pairs out of text (all, or the first ``most`` of a document), a line against a parabola per document, nested F, verdict."""
    points = extract.usable_points(extract.xy_pairs(docs, id_col, text_col, x_units, y_units, most))
    line = stats.ols(points, ["doc"], "x", "y").select("doc", "n", F.col("r2").alias("r2_line"), F.col("rmse").alias("rmse_line"))
    curve = stats.polynomial(points, ["doc"], "x", "y", 2).select("doc", F.col("r2").alias("r2_curve"), F.col("rmse").alias("rmse_curve"))
    both = line.join(curve, "doc")
    n = F.col("n")
    f = stats.nested_f(n, F.pow("rmse_line", 2) * n, 2, F.pow("rmse_curve", 2) * n, 3)
    tested = resampling.f_test(both.withColumns({"f": f, "d1": F.lit(1), "d2": n - 3}), "f", "d1", "d2")
    return tested.withColumn("verdict", resampling.model_verdict(F.col("r2_curve"), F.col("r2_line"), F.col("p") < 0.05, F.lit(None).cast("double")))


def tiered_fit(points: DataFrame) -> DataFrame:
    """A line per document and tier: A tables, B sequences and explicit pairs, C the rest."""
    tier = F.when(F.col("provenance") == "table", "A").when(F.col("provenance").isin("sequence", "explicit"), "B").otherwise("C")
    return stats.tiered(points.withColumn("tier", tier), ["doc"], "tier", "x", "y")


def verify_hypotheses(hyps: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims of (id, text, confidence) against evidence texts (id, text); confidence after the penalty."""
    c = extract.claimed_values(hyps, "id", "text").select(F.concat_ws(":", "doc", "start").alias("claim"), F.col("doc").alias("id"), "unit", F.col("low").alias("lo"), F.col("high").alias("hi"))
    e = extract.evidence_values(evidence, "id", "text").select(F.concat_ws(":", "doc", "start").alias("item"), "unit", "value")
    share = claims.roll_up(claims.claim_status(c, e), "id")
    out = hyps.join(share, "id", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return out.withColumn("confidence", scores.claim_confidence(F.col("confidence"), F.col("share")))


def blend(search: Column, plausibility: Column) -> Column:
    """0.6 search and 0.4 plausibility, where there is one."""
    return F.when(plausibility > 0, search * 0.6 + plausibility * 0.4).otherwise(search)


def settle(rows: DataFrame) -> DataFrame:
    """Contested and underexplored hypotheses, from confidence and plausibility."""
    c, p = F.col("confidence"), F.col("plausibility")
    contested = (p < 0.35) & (c > 0.7)
    status = F.when(contested, "contested").when((p > 0.7) & (c < 0.5) & (F.col("validation_status") == "inconclusive"), "underexplored").otherwise(F.col("validation_status"))
    return rows.withColumns({"validation_status": status, "confidence": F.when(contested, c * 0.7 + p * 0.3).otherwise(c)})


def plausibility(rows: DataFrame) -> DataFrame:
    """Adds plausibility: 0.3 for up to five pieces of evidence, 0.3 for verification, 0.4 for confidence.

    rows (evidence_chain array, share of claims found, n_claims, n_unverified, confidence).  Where half of the claims or
    more were not found, verification counts a quarter at most and 0.10 + 0.15 of their share is taken off.  Without a
    share, verification and confidence count a half each and nothing is taken off.  The result lies in 0 .. 1.
    """
    e = F.least(F.size(F.coalesce("evidence_chain", F.array().cast("array<string>"))) / 5, F.lit(1.0))
    found = F.coalesce("share", F.lit(0.5))
    lost = F.when(F.col("share").isNull(), 0.0).otherwise(F.coalesce(F.try_divide("n_unverified", "n_claims"), 1 - F.col("share")))
    doubted = lost >= 0.5
    score = 0.30 * e + 0.30 * F.when(doubted, F.least(found, F.lit(0.25))).otherwise(found) + 0.40 * F.coalesce("confidence", F.lit(0.5))
    score = score - F.when(doubted, 0.15 * lost + 0.10).otherwise(0.0)
    return rows.withColumn("plausibility", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _spelled(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(name), "[ -]", ""))


def proxies_of(hyps: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, proxy): stand-ins (dictionary: name, proxy) of the materials of hypotheses (id, materials): a name that
    contains a material or is part of one, without blanks and hyphens, in either case."""
    materials = hyps.select("id", F.explode("materials").alias("m")).select("id", _spelled("m").alias("m")).distinct()
    known = dictionary.select(_spelled("name").alias("k"), "proxy").distinct()
    # Names settle their stand-ins first: an id is not multiplied by all names that meet its material.
    met = graph.either_holds(materials, "m", known, "k").join(known, "k").select("m", "proxy").distinct()
    return materials.join(met, "m").select("id", "proxy").distinct()


def known_ranges(hyps: DataFrame, known: DataFrame) -> DataFrame:
    """Hypotheses (id, materials, property) against known ranges (name, kind, lo, hi): id, found (names met), entries
    (lines of the ranges that the property asks for, in order) and validation_status.

    Names meet as in :func:`proxies_of`; the words of a property select kinds (``fixed.RANGE_WORDS``), several if it
    names several.  An entry validates, a name without one leaves the matter inconclusive, no name leaves it pending.
    """
    rows = hyps.select("id", F.lower(F.coalesce("property", F.lit(""))).alias("_p"), F.explode_outer("materials").alias("m")).select("id", "_p", _spelled("m").alias("m")).distinct()
    ranges = known.select("name", "kind", "lo", "hi", _spelled("name").alias("k"))
    hit = rows.join(graph.either_holds(rows, "m", ranges, "k"), "m", "left").join(ranges, "k", "left")
    asked = F.lit(False)
    for kind, words in fixed.RANGE_WORDS.items():
        asked = asked | (F.col("kind") == kind) & F.coalesce(F.col("lo"), F.col("hi")).isNotNull() & F.col("_p").rlike("|".join(words))
    line = F.when(asked, F.concat("name", F.lit(": "), "kind", F.lit(" = "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string")))
    out = hit.groupBy("id").agg(F.countDistinct("name").alias("found"), F.array_sort(F.collect_set(line)).alias("entries"))
    return out.withColumn("validation_status", F.when(F.size("entries") > 0, "validated").when(F.col("found") > 0, "inconclusive").otherwise("pending"))


def score_candidates(candidates: DataFrame, group: str, value: str, materials: Column, prop: Column, text: Column, canonical: Column, judged: Column | None = None) -> DataFrame:
    """Adds prior, nearest, degraded and score, the values of the group's other candidates being the literature.

    Without any, the score is the stable one of ``canonical`` and degraded is true.  ``judged``: a plausibility of weight 0.35.
    """
    rows = runs.prior_among_others(candidates, group, value).withColumn("degraded", F.col("nearest").isNull())
    score = F.when(F.col("degraded"), scores.empty_evidence(canonical)).otherwise(scores.first_score(materials, prop, text, F.col("prior")))
    return rows.withColumn("score", scores.blended(score, judged))


def best_candidates(scored: DataFrame, group: str, order: str) -> DataFrame:
    """The best candidate of each group, the greatest ``order`` of equal ones."""
    return search_space.best_of(scored.withColumnRenamed("score", "_score"), [group], F.round("_score", 9), [F.col(order)]).drop("_score")


def link_topics(entities: DataFrame, evidence: DataFrame, most: int = 24) -> DataFrame:
    """Links between topics with evidence and strength; ``most`` in order of the topics (null: all)."""
    links = graph.link_strength(graph.containment_links(entities, "topic", "entity"), evidence, "topic", "entity", "item")
    ordered = links.orderBy("group_a", "group_b", "key")
    return ordered.limit(most) if most else ordered


def units_of(hyps: DataFrame, prop: str) -> DataFrame:
    """P24."""
    return hyps.withColumn("units", accepted_units(prop))
