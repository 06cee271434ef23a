"""Scoring expressions: plain column arithmetic, one definition per formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .entities import matches_any, property_keys
from .text import col, let, match_key, material_keys


def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""))


def relevance(query: Column, title: Column, abstract: Column, material: Column | None = None, prop: Column | None = None, year: Column | None = None, year_from: Column | None = None) -> Column:
    """M1: title overlap, phrase or word in the abstract, material, property, recency; at most 1."""
    q, a = _words(query), F.lower(F.coalesce(abstract, F.lit("")))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(q, _words(title))), F.size(q)), F.lit(0.0)) * 0.5
    text = F.when(a.contains(F.lower(query)), 0.3).when(F.exists(q, lambda w: (F.length(w) > 3) & a.contains(w)), 0.2).otherwise(0.0)
    bonus = F.lit(0.0)
    for part in (material, prop):
        if part is not None:
            bonus = bonus + F.when(a.contains(F.lower(part)), 0.15).otherwise(0.0)
    if year is not None and year_from is not None:
        bonus = bonus + F.when(year >= year_from, 0.05).otherwise(0.0)
    return F.least(overlap + text + bonus, F.lit(1.0))


def relevance_cited(query: Column, title: Column, abstract: Column, citations: Column) -> Column:
    """M2: base, title overlap, word in the abstract, logarithm of citations; at most 1."""
    q, a = _words(query), F.lower(F.coalesce(abstract, F.lit("")))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(q, _words(title))), F.size(q)), F.lit(0.0)) * 0.4
    text = F.when(F.exists(q, lambda w: (F.length(w) > 3) & a.contains(w)), 0.2).otherwise(0.0)
    cited = F.when(citations > 0, F.least(F.log10(citations + 1) / 10, F.lit(0.15))).otherwise(0.0)
    return F.least(F.lit(0.3) + overlap + text + cited, F.lit(1.0))


def default_score(score: Column, relevance_: Column, citations: Column) -> Column:
    """M3: the source's score, else its relevance, else citations / 1000, else one half."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), F.nullif(relevance_, F.lit(0.0)), F.nullif(citations / 1000.0, F.lit(0.0)), F.lit(0.5))


def stretch(score: Column | str) -> Column:
    """M5: piecewise linear through fixed anchors; null is 0.02."""
    s = F.least(F.greatest(col(score), F.lit(0.0)), F.lit(1.0))
    out = F.when(s.isNull(), fixed.STRETCH[0][1])
    for (x0, y0), (x1, y1) in zip(fixed.STRETCH[:-1], fixed.STRETCH[1:], strict=True):
        out = out.when(s <= x1, F.lit(y0) + (s - x0) * ((y1 - y0) / (x1 - x0)))
    return out


def type_weights(kind: Column | str) -> Column:
    """M6: struct(coverage, cooccurrence, prior) by words in the hypothesis id; a third each otherwise."""
    out = None
    for word, w in fixed.TYPE_WEIGHTS.items():
        value = F.struct(*[F.lit(x).alias(n) for x, n in zip(w, ("coverage", "cooccurrence", "prior"), strict=True)])
        out = F.when(F.lower(col(kind)).contains(word), value) if out is None else out.when(F.lower(col(kind)).contains(word), value)
    return out.otherwise(F.struct(*[F.lit(1.0 / 3).alias(n) for n in ("coverage", "cooccurrence", "prior")]))


def harmonic(pairs: list[tuple[Column, Column]]) -> Column:
    """M7: weighted harmonic mean of the positive signals; 0 if none."""
    live = [(F.when(s > 1e-9, w).otherwise(0.0), F.when(s > 1e-9, w / s).otherwise(0.0)) for s, w in pairs]
    top, bottom = (reduce(lambda a, b: a + b, [x[k] for x in live]) for k in (0, 1))
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def trapezoid(v: Column, lo: Column, hi: Column, width: float = 0.5) -> Column:
    """1 inside the window, falling to 0 over ``width`` times its span on both sides."""
    edge = F.greatest((hi - lo) * width, F.lit(1e-9))
    return F.when(v.isNull(), 0.0).when((v >= lo) & (v <= hi), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(lo - v, v - hi) / edge))


def gaussian(v: Column, lo: Column, hi: Column, sigma: float = 0.5) -> Column:
    """A bell around the middle of the window."""
    s = F.greatest((hi - lo) * sigma, F.lit(1e-9))
    return F.exp(-0.5 * F.pow((v - (lo + hi) / 2) / s, 2))


def literature_prior(v: Column, values: Column) -> Column:
    """Closeness to the nearest known value and share of known values within a quarter, after the outlier guard."""
    relative = lambda k: F.abs(v - k) / F.greatest(F.abs(k), F.lit(1e-6))

    def prior(kept: Column) -> Column:
        near = F.array_min(F.transform(kept, relative))
        share = F.try_divide(F.size(F.filter(kept, lambda k: relative(k) <= 0.25)), F.size(kept))
        return F.when((v <= 0) | v.isNull() | (F.size(kept) == 0), 0.0).otherwise(F.least(0.6 / (1 + near) + 0.4 * share, F.lit(1.0)))

    return let(guarded(F.filter(F.coalesce(values, F.array().cast("array<double>")), lambda k: k > 0)), prior)


def median_of(values: Column) -> Column:
    """Median of an array: the mean of the middle two of an even number."""

    def middle(s: Column) -> Column:
        at = lambda k: F.try_element_at(s, k.cast("int"))
        return (at(F.floor((F.size(s) + 1) / 2)) + at(F.floor(F.size(s) / 2) + 1)) / 2

    return let(F.array_sort(values), middle)


def guarded(values: Column) -> Column:
    """F8: values within [0.02, 50] times the median; all of them if none is."""

    def near(s: Column) -> Column:  # the median is taken once, not for each value
        kept = F.filter(s["values"], lambda k: (k >= s["mid"] * 0.02) & (k <= s["mid"] * 50))
        return let(kept, lambda x: F.when(F.size(x) > 0, x).otherwise(s["values"]))

    return let(let(values, lambda x: F.struct(x.alias("values"), median_of(x).alias("mid"))), near)


def quadrant(novelty: Column | str, confidence: Column | str) -> Column:
    """Strong, underexplored, contested or weak; one half counts as high."""
    n, c = col(novelty) >= 0.5, col(confidence) >= 0.5
    return F.when(n & c, "strong").when(n, "underexplored").when(c, "contested").otherwise("weak")


def overlap_level(similarity: Column | str) -> Column:
    """Band of an overlap."""
    s = col(similarity)
    return F.when(s >= 0.35, "high").when(s >= 0.15, "moderate").when(s >= 0.05, "low").otherwise("none")


def novelty_penalty(similarity: Column | str) -> Column:
    """Penalty of an overlap, by its band."""
    s = col(similarity)
    return F.when(s >= 0.35, F.least(F.lit(0.40), s * 0.8)).when(s >= 0.15, F.least(F.lit(0.25), s * 0.5)).when(s >= 0.05, F.least(F.lit(0.10), s * 0.3)).otherwise(0.0)


def claim_confidence(confidence: Column, share: Column) -> Column:
    """Confidence after the penalty for claims that were not found."""
    return F.when(share < 0.5, F.greatest(F.round(confidence - (0.1 + (0.5 - share) * 0.2), 2), F.lit(0.1))).otherwise(confidence)


def composition_bonus(x: Column) -> Column:
    """Bonus of a composition between 0.3 and 0.7."""
    return F.when(x.between(0.3, 0.7), 0.05 + 0.05 * F.greatest(F.lit(0.0), 1 - F.pow((x - 0.5) / 0.2, 2))).otherwise(0.0)


def empty_evidence(canonical: Column) -> Column:
    """A stable score in [0.10, 0.22] from the MD5 of the parameters' canonical text."""
    return 0.10 + 0.12 * ((F.conv(F.substring(F.md5(canonical), 1, 6), 16, 10).cast("long") % 1000) / 1000)


def coverage(materials: Column, text: Column) -> Column:
    """M17, first signal: share of materials that the text names, by key."""

    def share(t: Column) -> Column:
        hit = F.filter(materials, lambda m: F.contains(t["low"], F.lower(m)) | matches_any(material_keys(m), t["key"]))
        return F.size(hit) / F.greatest(F.size(materials), F.lit(1))

    return let(F.struct(F.lower(text).alias("low"), match_key(text).alias("key")), share)


def together(materials: Column, prop: Column, text: Column) -> Column:
    """M17, second signal: of the paragraphs that name a material, the share that names the property."""
    # What every paragraph is held against is bound once.
    bound = F.struct(
        F.flatten(F.transform(materials, lambda m: F.concat(material_keys(m), F.array(match_key(m))))).alias("keys"), F.transform(materials, F.lower).alias("names"),
        property_keys(prop).alias("wanted"), F.lower(prop).alias("prop"),
    )
    lines = F.transform(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.lower(p).alias("low"), match_key(p).alias("key")))

    def share(s: Column) -> Column:
        named = F.filter(lines, lambda p: matches_any(s["keys"], p["key"]) | F.exists(s["names"], lambda m: F.contains(p["low"], m)))

        def part(ps: Column) -> Column:
            both = F.filter(ps, lambda p: F.contains(p["low"], s["prop"]) | matches_any(s["wanted"], p["key"]))
            return F.when(F.size(ps) > 0, F.size(both) / F.size(ps)).otherwise(0.0)

        return let(named, part)

    return let(bound, share)


def evidence_score(materials: Column, prop: Column, text: Column, value: Column, known: Column, kind: Column, window: Column, bonus: Column) -> Column:
    """struct(coverage, cooccurrence, numerical, window, score) of a candidate.

    Harmonic mean of the three signals, 0.6 to 0.4 with the window where the
    hypothesis has one, mapped to 0.05 .. 0.90, bonuses added, stretched.
    """
    signals = F.struct(
        coverage(materials, text).alias("c"), together(materials, prop, text).alias("t"), literature_prior(value, known).alias("n"), type_weights(kind).alias("w"),
        F.when(window.isNotNull(), trapezoid(value, window["lo"], window["hi"])).alias("inside"),
    )

    def judged(s: Column) -> Column:
        w = s["w"]
        fused = harmonic([(s["c"], w["coverage"]), (s["t"], w["cooccurrence"]), (s["n"], w["prior"])])
        fused = F.coalesce(0.60 * fused + 0.40 * s["inside"], fused)
        score = let(F.least(0.05 + 0.85 * fused + bonus, F.lit(1.0)), stretch)
        return F.struct(s["c"].alias("coverage"), s["t"].alias("cooccurrence"), s["n"].alias("numerical"), s["inside"].alias("window"), score.alias("score"))

    return let(signals, judged)


def temperature_bonus(t: Column) -> Column:
    """M18."""
    return F.when(t.between(273, 373), 0.05).when((t > 373) & (t <= 500), 0.02).otherwise(0.0)


def diversity_bonus(point: Column, explored: Column, most: float = 0.10) -> Column:
    """M8: distance to the nearest explored point (arrays already scaled to 0..1) over 0.3, times ``most``; ``most`` without any."""
    distance = lambda q: F.sqrt(F.aggregate(F.zip_with(point, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    near = F.array_min(F.transform(explored, distance))
    return F.when(F.size(explored) > 0, most * F.least(near / 0.3, F.lit(1.0))).otherwise(most)


def blended(score: Column, plausibility: Column | None, weight: float = 0.35) -> Column:
    """A score and a plausibility of weight 0.35, where there is one; at most 1."""
    both = score if plausibility is None else F.coalesce(score * (1 - weight) + plausibility * weight, score)
    return F.least(both, F.lit(1.0))


def first_score(materials: Column, prop: Column, text: Column, prior: Column) -> Column:
    """0.15, 0.25 for the share of materials named, 0.20 for the property, 0.35 for the prior."""
    low = F.lower(F.coalesce(text, F.lit("")))
    share = F.size(F.filter(materials, lambda m: low.contains(F.lower(m)))) / F.greatest(F.size(materials), F.lit(1))
    named = F.when((F.size(materials) > 0) & (prop != "") & low.contains(F.lower(prop)), 0.20).otherwise(0.0)
    return F.least(0.15 + 0.25 * share + named + 0.35 * prior, F.lit(1.0))


def text_score(materials: Column, prop: Column, text: Column, value: Column, known: Column, plausibility: Column | None = None) -> Column:
    """M16, by texts: 0.30, 0.20 for the share of materials named, 0.15 for the property, 0.30 for the prior."""
    low = F.lower(text)
    hits = F.size(F.filter(materials, lambda m: low.contains(F.lower(m)))) / F.greatest(F.size(materials), F.lit(1))
    named = F.when((prop != "") & low.contains(F.lower(prop)), 0.15).otherwise(0.0)
    return blended(F.least(0.30 + 0.20 * hits + named + 0.30 * literature_prior(value, known), F.lit(1.0)), plausibility)


def graph_score(n_similar: Column, value: Column, known: Column, plausibility: Column | None = None) -> Column:
    """M16, by graphs: 0.30, 0.30 for the prior, 0.10 for each similar material."""
    return blended(F.least(0.30 + 0.30 * literature_prior(value, known) + 0.10 * n_similar, F.lit(1.0)), plausibility)


#: Weights of :func:`block_score`: base, coverage, cooccurrence, nearness of values, share of the window.
TOOL, BASELINE = (0.15, 0.25, 0.20, 0.35, 0.0), (0.15, 0.20, 0.15, 0.25, 0.30)


def block_score(n_blocks: Column, n_named: Column, n_both: Column, value: Column, known: Column, bonus: Column, weights: tuple[float, ...], window: Column | None = None) -> Column:
    """M16, by blocks of evidence (all, naming a material, naming the property as well): TOOL or BASELINE weights.

    Nearness is the mean of the three nearest known values; bonuses add up to 1, then the window takes its share.
    """
    base, cover, joint, near, share = weights
    close = F.slice(F.array_sort(F.transform(known, lambda k: -1 / (1 + F.abs(value - k) / F.greatest(k, F.lit(1e-6))))), 1, 3)
    mean = -F.aggregate(close, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(close), F.lit(1))
    nearness = F.when((F.size(known) > 0) & (value != 0), near * mean).otherwise(0.0)
    found = F.when(n_named > 0, cover * n_named / n_blocks + joint * n_both / F.greatest(n_named, F.lit(1)) + nearness).otherwise(0.0)
    score = F.when(n_blocks == 0, base).otherwise(F.least(base + found + bonus, F.lit(1.0)))
    return score if window is None or not share else F.when(window.isNull() | (n_blocks == 0), score).otherwise((1 - share) * score + share * window)


def window_score(value: Column, window: Column, mode: str = "trapezoid") -> Column:
    """struct(score, lo, hi): 0 without a window or a positive value."""
    shape = gaussian if mode == "gaussian" else trapezoid
    inside = F.when(window.isNull() | value.isNull() | (value <= 0), 0.0).otherwise(shape(value, window["lo"], window["hi"]))
    return F.struct(inside.alias("score"), window["lo"].alias("lo"), window["hi"].alias("hi"))


def by_version(new: Column, old: Column, setting: str = "true") -> Column:
    """the second version of a score unless the setting switches it off."""
    return old if setting.strip().lower() in ("false", "0", "no", "off") else new
