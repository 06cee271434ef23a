"""Normalisers, tokenizers and parsers as columns; Catalyst sees every one of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """A small literal map; a missing key gives ``default`` (null if none)."""
    if table and all(isinstance(x, str) for pair in table.items() for x in pair):  # one literal: plans that name it often stay short
        known = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))
    else:
        known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(known, key)
    return found if default is None else F.coalesce(found, default)


def filled(x: Column | str) -> Column:
    """Null when missing or empty: text that counts as absent."""
    return F.nullif(col(x), F.lit(""))


def normalize_doi(doi: Column | str) -> Column:
    """Trimmed, without resolver and prefix, without trailing . , ; in lower case; empty is null."""
    bare = F.regexp_replace(F.trim(col(doi)), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return filled(F.lower(F.regexp_replace(F.regexp_replace(F.trim(bare), r"(?i)^doi:\s*", ""), r"[.,;]+$", "")))


def normalize_doi_bib(doi: Column | str) -> Column:
    """Keeps trailing punctuation; placeholders are null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(doi)), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    return F.when(bare.isin("", "—", "-", "None", "N/A"), None).otherwise(F.lower(bare))


def derived_id(doi: Column | str, paper_id: Column | str, title: Column | str) -> Column:
    """Doi, else paper id, else the first 12 digits of the title's MD5."""
    return F.coalesce(
        F.concat(F.lit("doi:"), filled(doi)), F.concat(F.lit("paper:"), filled(paper_id)), F.concat(F.lit("title:"), F.substring(F.md5(F.coalesce(col(title), F.lit(""))), 1, 12))
    )


def normalize_title(title: Column | str) -> Column:
    """Lower case, letters a-z, digits and white space only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(title)), r"[^a-z0-9\s]", ""))


def title_key(title: Column | str) -> Column:
    """P5: lower-case letters a-z and digits."""
    return F.regexp_replace(F.lower(col(title)), "[^a-z0-9]", "")


def tokenize(text: Column | str, unicode: bool = True) -> Column:
    """Words over two letters that are no stop words, repeats kept.  ``unicode=False`` takes a-z and digits only."""
    other = r"(?U)[^\w\s-]" if unicode else r"[^a-z0-9\s-]"
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), other, " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.STOPWORDS))


def token_set(text: Column | str, unicode: bool = True) -> Column:
    """Distinct words over two letters, hyphens split, stop words kept."""
    other = r"(?U)[^\w\s]" if unicode else r"[^a-z0-9\s]"
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), other, " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def query_terms(text: Column | str, most: int = 10) -> Column:
    """Quoted phrases first, then words over one letter, without noise words; at most ``most``."""
    phrases = F.regexp_extract_all(col(text), F.lit('"([^"]+)"'), F.lit(1))
    words = F.filter(F.split(F.regexp_replace(col(text), '"[^"]+"', ""), r"\s+"), lambda w: F.length(w) > 1)
    return F.slice(F.filter(F.concat(phrases, words), lambda t: ~F.lower(t).isin(fixed.QUERY_NOISE)), 1, most)


def ngrams(text: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams; none of a shorter text."""
    t = col(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: t.substr(i, F.lit(n)))
    return F.when(F.length(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def plain_upper(text: Column | str) -> Column:
    """Upper case letter by letter, as SQL has it: one that has no single upper-case letter (ß) stays."""
    letters = F.filter(F.split(col(text), ""), lambda c: c != "")
    return F.array_join(F.transform(letters, lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def match_key(text: Column | str) -> Column:
    """P10: lower case without separators and brackets."""
    return F.regexp_replace(F.lower(col(text)), r"[\s\-_/()（）\[\].,，、:：;；]+", "")


def material_keys(name: Column | str) -> Column:
    """The full key and the key without bracketed parts."""
    plain = match_key(F.regexp_replace(col(name), r"[(（][^)）]*[)）]", ""))
    return F.array_distinct(F.filter(F.array(match_key(name), plain), lambda k: k != ""))


def formula_key(text: Column | str) -> Column:
    """Subscript digits as digits, without separators and brackets, lower case."""
    return F.lower(F.regexp_replace(F.translate(col(text), "₀₁₂₃₄₅₆₇₈₉", "0123456789"), r"[\s\-_()\[\]{}·.,]+", ""))


def _unit(raw: Column, table: dict, dashes: str, ones: bool) -> Column:
    u = F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")
    u = F.regexp_replace(u, dashes, "")
    u = F.trim(F.replace(F.replace(u, F.lit("¹"), F.lit("1")) if ones else u, F.lit("1"), F.lit("")))
    # Spellings are compared without blanks, as the table's own keys are.
    keyed = {}
    for spelling, unit in table.items():
        keyed.setdefault(spelling.replace(" ", ""), unit)
    return lookup(F.replace(u, F.lit(" "), F.lit("")), keyed, u)


def unit_a(raw: Column | str) -> Column:
    """Unit of an extracted value."""
    return _unit(col(raw), fixed.UNITS_A, "-+", False)


def unit_b(raw: Column | str) -> Column:
    """Unit of a claim; knows more spellings, and % RH as %."""
    return _unit(col(raw), fixed.UNITS_B, "[⁻¹−\\-–—]", True)


def unit_category(unit: Column | str) -> Column:
    """Physical category; an unknown unit is its own."""
    return lookup(col(unit), fixed.UNIT_CATEGORY, col(unit))


def unit_range(unit: Column | str) -> Column:
    """struct(lo, hi) of plausible values, null if unknown."""
    both = lookup(F.lower(F.trim(col(unit))), {k: f"{lo};{hi}" for k, (lo, hi) in fixed.UNIT_RANGE.items()})
    ends = [F.substring_index(both, ";", side).cast("double").alias(name) for side, name in ((1, "lo"), (-1, "hi"))]
    return F.when(both.isNotNull(), F.struct(*ends))


def unit_from_header(cell: Column | str) -> Column:
    """P20: the unit in brackets, else behind the last slash."""
    inside = F.regexp_extract(F.trim(col(cell)), r"[(（]([^()（）]*)[)）]", 1)
    behind = F.regexp_extract(F.trim(col(cell)), r"\s*/\s*([^\s/|]+)\s*$", 1)
    has = F.trim(col(cell)).rlike(r"[(（][^()（）]*[)）]")
    return F.when(has, filled(F.trim(inside))).otherwise(filled(behind))


def first_number(cell: Column | str) -> Column:
    """The first number of a cell if it lies in (0, 1e6)."""
    v = F.regexp_extract(col(cell), r"[-+]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", 0).try_cast("double")
    return F.when((v > 0) & (v < 1e6), v)


def to_base_unit(value: Column, unit: Column) -> Column:
    """Celsius to kelvin, kPa, MPa and GPa to bar; others unchanged."""
    return (
        F.when(unit.isin("°c", "℃"), value + 273.15).when(unit == "kpa", value / 100).when(unit == "mpa", value * 10).when(unit == "gpa", value * 1e4).otherwise(value)
    )


def accepted_units(name: Column | str) -> Column:
    """The units of the bucket with most property words in the name (ties merged); null if none."""
    t = F.lower(F.coalesce(col(name), F.lit("")))
    hits = [sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0)) for _, words in fixed.UNIT_BUCKETS]
    best = F.greatest(*hits)
    units = F.flatten(F.array(*[F.when(h == best, F.array(*map(F.lit, u))).otherwise(F.array().cast("array<string>")) for h, (u, _) in zip(hits, fixed.UNIT_BUCKETS, strict=True)]))
    return F.when(best > 0, F.array_sort(F.array_distinct(units)))


def truncated(text: Column | str, n: int) -> Column:
    """At most n characters, the last an ellipsis if cut."""
    t = col(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.left(t, F.lit(n - 1)), F.lit("…")))


def _balanced(depth: int) -> str:
    """A pattern for objects and arrays nested up to ``depth`` levels; strings may hold any bracket."""
    string, inner = r'"(?:[^"\\\\]|\\\\.)*+"'.replace("\\\\", "\\"), ""
    for _ in range(depth):
        deeper = f"|{inner}" if inner else ""
        inner = rf'(?:\{{(?:[^{{}}\[\]"]|{string}{deeper})*+\}}|\[(?:[^{{}}\[\]"]|{string}{deeper})*+\])'
    return inner


def parsed_json(text: Column | str) -> Column:
    """The text as JSON, else its first fenced part, else the first object or array in it that parses, else all between the
    first and the last brace (bracket); null if none parses.  Values inside prose are found up to six levels deep."""
    t = F.regexp_replace(F.trim(col(text)), "^\ufeff", "")
    fenced = F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)
    inside = F.regexp_extract_all(t, F.lit(_balanced(6)), F.lit(0))
    first = F.get(F.filter(F.transform(inside, lambda x: F.try_parse_json(x)), lambda v: v.isNotNull()), F.lit(0))
    greedy = [F.try_parse_json(filled(F.regexp_extract(t, p, 0))) for p in (r"\{[\s\S]*\}", r"\[[\s\S]*\]")]
    return F.coalesce(F.try_parse_json(filled(t)), F.try_parse_json(filled(fenced)), first, *greedy)


def parameter_hash(**parts: Column | str) -> Column:
    """16 digits of the SHA-256 of the parts as JSON with sorted keys."""
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.to_json(F.array(col(parts[k]))).substr(F.lit(2), F.length(F.to_json(F.array(col(parts[k])))) - 2)) for k in sorted(parts)])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 16)


def strip_markup(text: Column | str) -> Column:
    """Tags dropped, the five basic entities decoded, white space collapsed."""
    t = F.regexp_replace(col(text), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """Matches with their place, as array<struct(start, whole, g1..gn)>; start counts from 0, in code points.

    Built from split and regexp_extract_all, so it stays in the JVM.
    """

    def placed(pieces: Column) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
        names = ["whole", *[f"g{g}" for g in range(1, groups + 1)]]
        rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), *[p.alias(n) for p, n in zip(parts, names, strict=True)])
        rows = F.slice(rows, 1, F.size(pieces) - 1)
        kind = "array<struct<start:int," + ",".join(f"{n}:string" for n in names) + ">>"

        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + x["gap"]
            row = F.struct(start.alias("start"), *[x[n].alias(n) for n in names])
            return F.struct((start + F.length(x["whole"])).alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.when(F.size(pieces) > 1, F.aggregate(rows, F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out")), step)["out"]).otherwise(F.array().cast(kind))

    return let(F.split(text, pattern, -1), placed)
