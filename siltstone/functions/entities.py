"""Entities, codes, keywords and small renderings out of text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, filled, formula_key, let, match_key


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def property_keywords(name: Column | str) -> Column:
    """Search words of a property, sorted; a default list if there are none."""
    t = F.lower(F.coalesce(col(name), F.lit("")))
    mapped = [F.when(t.contains(w), F.array(*map(F.lit, words))).otherwise(_none()) for w, words in fixed.PROPERTY_SEARCH.items()]
    found = F.array_sort(F.array_distinct(F.concat(*mapped, _all(t, r"[a-z][a-z0-9\-]{1,20}"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, fixed.DEFAULT_SEARCH)))


def property_keys(name: Column | str) -> Column:
    """The property's own key and the keys of its synonyms, distinct, in order."""
    t = F.lower(F.coalesce(col(name), F.lit("")))
    mapped = [F.when(t.contains(w.lower()), F.array(*[match_key(F.lit(x)) for x in words])).otherwise(_none()) for w, words in fixed.PROPERTY_KEYS.items()]
    return F.array_distinct(F.filter(F.concat(F.array(match_key(F.coalesce(col(name), F.lit("")))), *mapped), lambda k: k != ""))


def matches_any(keys: Column, target: Column) -> Column:
    """whether the target holds one of the keys."""
    return F.exists(keys, lambda k: (k != "") & F.contains(target, k))


def is_formula(token: Column) -> Column:
    """Two element symbols or more, all real; no code or model number."""
    symbols = _all(token, r"[A-Z][a-z]?")
    real = F.forall(symbols, lambda s: s.isin(fixed.ELEMENTS))
    return ~token.rlike(r"(?i)^(?:R|Gap|H|Q)\d+") & ~token.rlike(r"^[A-Za-z]{1,4}\d{2,}$") & (F.size(symbols) >= 2) & real


def formulas(text: Column | str) -> Column:
    """Array of struct(key, name): the first name of each formula's key."""
    found = F.filter(_all(F.translate(F.coalesce(col(text), F.lit("")), "₀₁₂₃₄₅₆₇₈₉", "0123456789"), fixed.FORMULA), is_formula)
    keys = F.array_distinct(F.transform(found, formula_key))
    return let(found, lambda f: F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(f, lambda x: formula_key(x) == k), 1).alias("name"))))


def query_entities(text: Column | str) -> Column:
    """struct(material, property, method): the first hit of each class, null if none."""
    return F.struct(*[filled(F.regexp_extract(col(text), p, 0)).alias(n) for n, p in fixed.QUERY_ENTITIES.items()])


def document_entities(text: Column | str, kind: str, most: int = 50) -> Column:
    """Materials, properties (lower case) or methods of a document, sorted, at most ``most``."""
    t = F.coalesce(col(text), F.lit(""))
    found = F.concat(*[_all(t, p) for p in fixed.DOCUMENT_ENTITIES[kind]])
    if kind == "materials":
        found = F.filter(found, lambda m: F.length(m) > 2)
    if kind == "properties":
        found = F.transform(found, F.lower)
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def paper_ids(text: Column | str, most: int = 10) -> Column:
    """pN, DOI and bold ids, distinct, at most ``most``."""
    t = F.coalesce(col(text), F.lit(""))
    return F.slice(F.array_distinct(F.concat(_all(t, r"\b(p\d{1,4})\b", 1), _all(t, r"\b(10\.\d{4,}/[^\s,;|)\]]+)", 1), _all(t, r"\*\*ID:\*\*\s*(\S+)", 1))), 1, most)


def evidence_codes(text: Column | str) -> Column:
    """Codes of all patterns, split at separators, prefix restored, distinct, in order of the patterns."""
    t = F.coalesce(col(text), F.lit(""))

    def split(raw: Column) -> Column:
        te = F.upper(raw).contains("TE")
        parts = F.filter(F.split(F.trim(raw), r"[/,;\s]+"), lambda p: p != "")
        whole = raw.rlike(r"^10\.\d|^PhysRev|^\d{4}-\d{4}/")
        return F.when(whole, F.array(raw)).otherwise(F.transform(parts, lambda p: F.when(te & p.rlike(r"^\d+$"), F.concat(F.lit("TE"), p)).otherwise(p)))

    return F.array_distinct(F.flatten(F.transform(F.concat(*[_all(t, p) for p in fixed.EVIDENCE_CODES]), split)))


def evidence_order(codes: Column) -> Column:
    """T4: alphabetic codes first, then by text."""
    return F.transform(F.sort_array(F.transform(codes, lambda c: F.struct((~c.rlike("^[A-Za-z]")).alias("k"), c.alias("c")))), lambda x: x["c"])


def reverse_queries(materials: Column, prop: Column, most: int = 5) -> Column:
    """Queries that look for known work on the same pairs, distinct by their lower-case text."""
    pairs = F.transform(F.slice(materials, 1, 3), lambda m: F.concat_ws(" ", m, prop))
    every = F.concat(pairs, F.array(F.concat_ws(" ", F.array_join(F.slice(materials, 1, 2), " "), prop, F.lit("review")), prop))
    kept = F.filter(every, lambda q: F.length(F.trim(q)) > 0)
    keys = F.array_distinct(F.transform(kept, lambda q: F.lower(F.trim(q))))
    return F.slice(keys, 1, most)


def result_summary(titles: Column, most: int = 5, width: int = 80) -> Column:
    """The first titles, cut, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(titles, 1, most), lambda t: F.left(t, F.lit(width))), " | ")
    return F.when(F.size(titles) > most, F.concat(shown, F.lit(" (+"), (F.size(titles) - most).cast("string"), F.lit(" more)"))).otherwise(shown)


def is_placeholder(value: Column | str) -> Column:
    """An unset configuration value."""
    return F.coalesce(F.trim(col(value)), F.lit("")).rlike(r"(?i)^$|^your[-_ ]|^xxx|^<.*>$|placeholder|changeme|^sk-x+$")


def verification_plan(expression: Column | str) -> Column:
    """How to check a claim, by the first rule its text meets (any h counts as hours, as the rules say)."""
    t = F.lower(col(expression))
    rules = [("mmol/g", "isotherm"), ("kj/mol", "calorimetry"), ("m2/g", "nitrogen sorption"), ("ev", "optical spectroscopy"), ("wt%", "elemental analysis"), ("bar", "pressure series"), ("k", "temperature series"), ("h", "time series"), ("%", "replicates")]
    out = None
    for unit, plan in rules:
        out = F.when(t.contains(unit), plan) if out is None else out.when(t.contains(unit), plan)
    return out.otherwise("literature review")


def novelty_label(score: Column, increment: Column, scale: float = 1.0) -> Column:
    """P46; ``scale``: how many times larger than a share the score is."""
    return F.when(score >= 0.80 * scale, "high").when(score >= 0.65 * scale, "medium").when(F.length(F.trim(increment)) > 0, "incremental").otherwise("low")


def evidence_class(item: Column | str) -> Column:
    """A paper, a novelty remark, or other."""
    t = F.trim(col(item))
    return F.when(t.rlike(r"(?i)^p\d+\b|10\.\d{4,}/|arxiv"), "papers").when(t.rlike(r"(?i)novel|新颖|查重"), "novelty").otherwise("other")


def plausible_window(lo: Column, hi: Column) -> Column:
    """no years, no code ranges, not over 100 000."""
    years = (lo >= 1000) & (hi <= 9999) & (lo == F.floor(lo)) & (hi == F.floor(hi))
    return (lo >= 0) & (lo < hi) & ~years & (hi <= 100000)


def window_of(*texts: Column | str) -> Column:
    """M9: struct(lo, hi): the first plausible window of the first text that has one; numbers with a unit before numbers with a word."""
    found = []
    for t in texts:
        for pattern in (fixed.WINDOW_UNIT, fixed.WINDOW_WORD):
            c = F.coalesce(col(t), F.lit(""))
            pairs = F.arrays_zip(_all(c, pattern, 1).alias("a"), _all(c, pattern, 2).alias("b"))
            w = F.transform(pairs, lambda x: F.struct(x["a"].cast("double").alias("lo"), x["b"].cast("double").alias("hi")))
            found.append(F.filter(w, lambda x: plausible_window(x["lo"], x["hi"])))
    return F.try_element_at(F.concat(*found), F.lit(1))


def wide_percentage(unit: Column, lo: Column, hi: Column) -> Column:
    """a percentage claim over half the scale."""
    return (unit == "%") & (hi - lo >= 50)


def claim_semantics(around: Column) -> Column:
    """humidity, proportion or nothing, from the words around a claim."""
    return (
        F.when(around.rlike(r"(?i)\brh\b|湿度|humidity|水蒸气|湿气|water\s*vapou?r|moisture|疏水|亲水|hydrophobi|hydrophili"), "humidity")
        .when(around.rlike(r"(?i)比例|摩尔比|配比|组成|composition|ratio|mole|mol\s*%|molar|content|含量|fraction|分率"), "proportion").otherwise("")
    )
