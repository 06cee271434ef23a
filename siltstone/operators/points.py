"""Points (x, y) of a property out of texts: tables column by column, sequences, sentences, and what is left over.

A text is cut into blocks, and what a block says is read inside its row, by
built-in functions over arrays: lines of tables become cells, a table's head is
the first line whose cells name an x and a y, and the rows below it give pairs.
Only pairs become rows of their own.  So a text is shuffled by nothing here, and
pairs only if the documents do not lie by their id already; every x of a block
meets every y in rows, never in an array.

Edge cases: a null or empty text has no points; ragged rows lack the cells they
lack; a document without a dominant unit, or whose kinds of x all have too few
distinct values, has no points; ties go to what stands first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import accepted_units, let, unit_b, unit_range
from . import extract, resolve

PAIR = "struct<kind:string,x:double,y:double>"
#: Kinds of x, and how a pair was found; of equal pairs of a document the first in the text stays.
KINDS, WAYS = ("temperature", "pressure", "composition", "percentage"), ("table", "sequence", "explicit", "implicit")


def each(rows: DataFrame, keys: list[str], array: Column, pos: str, value: str) -> DataFrame:
    """keys, pos, value of every element.  Outer, for a plain explode makes Spark test the array's size below it, and compute the array there again, and again for each name in it."""
    return rows.select(*keys, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns ``keep`` and new ones, each computed once a row: Spark copies no expression over a generator, but does over a projection."""
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return rows.select(*keep, F.explode_outer(one).alias("_once")).select(*keep, "_once.*")


def tables_of(text: Column) -> Column:
    """The tables of a text, each an array of struct(line, cells) without its rules (| --- |)."""
    is_row = lambda s: s.startswith("|") & (F.regexp_count(s, F.lit(r"\|")) >= 2)
    # A row with its number before it; other lines are empty, so tables lie between empty lines.
    numbered = F.transform(F.split(text, "\n"), lambda s, i: let(F.trim(s), lambda s: F.when(is_row(s), F.concat(i.cast("string"), s)).otherwise("")))
    tables = F.split(F.regexp_replace(F.array_join(numbered, "\n"), r"^\n+|\n+$", ""), r"\n\n+")
    cells = lambda s: F.transform(F.split(F.regexp_replace(s, r"^\d+\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    rows = lambda table: F.transform(F.split(table, "\n"), lambda s: F.struct(F.substring_index(s, "|", 1).try_cast("int").alias("line"), cells(s).alias("cells")))
    rule = lambda r: F.forall(r["cells"], lambda c: (c == "") | c.rlike(r"^:?-{2,}:?$"))
    return F.transform(tables, lambda table: F.filter(rows(table), lambda r: ~rule(r)))


HEAD = "struct<at:int,x_col:int,x_kind:string,y_col:int>"


def table_head(rows: Column, y_unit: Column, wanted: Column) -> Column:
    """Of a table the first line that names an x and a y, as struct(at, x_col, x_kind, y_col); null if none does.  Lines behind it are not looked at.

    ``wanted``: the units of the property (empty: any).  The last column that
    names an x counts, and the first that names a y.
    """
    filtered = F.size(wanted) > 0

    def named(c: Column, col: Column) -> Column:
        def of(h: Column) -> Column:
            unit, low = h["unit"], h["low"]
            known = unit_range(F.coalesce(unit, F.lit(""))).isNotNull()
            y_like = F.coalesce(F.when(filtered, F.array_contains(wanted, unit)).otherwise(known), F.lit(False))
            is_x = F.coalesce(unit.isin("k", "bar", "atm", "kpa"), F.lit(False)) | (low.rlike(fixed.X_HEAD) & ~y_like)
            kind = (
                F.when(unit == "k", "temperature").when(unit.isin("bar", "atm", "kpa") | low.rlike(fixed.PRESSURE_HEAD), "pressure").when(low.rlike(fixed.COMPOSITION_HEAD), "composition").otherwise("temperature")
            )
            by_unit = F.coalesce(F.when(filtered, F.array_contains(wanted, unit)).otherwise(unit == y_unit), F.lit(False))
            by_word = low.rlike(fixed.Y_HEAD) & ((y_unit != "dimensionless") | low.rlike(fixed.MERIT_HEAD))
            # An x has a kind, and what is no x may be a y: neither is asked of an empty cell.
            return let(F.when(is_x, kind), lambda k: F.struct(col.alias("col"), k.alias("kind"), (k.isNull() & (by_unit | by_word)).alias("is_y")))

        nothing = F.struct(col.alias("col"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("is_y"))
        return F.when(c == "", nothing).otherwise(let(F.struct(F.when(c.rlike(fixed.BRACKETED), unit_b(F.regexp_extract(c, fixed.BRACKETED, 1))).alias("unit"), F.lower(c).alias("low")), of))

    def head(cells: Column, at: Column) -> Column:
        def of(names: Column) -> Column:
            x = F.array_max(F.transform(F.filter(names, lambda n: n["kind"].isNotNull()), lambda n: F.struct(n["col"].alias("col"), n["kind"].alias("kind"))))
            y = F.array_min(F.transform(F.filter(names, lambda n: n["is_y"]), lambda n: n["col"]))
            both = let(F.struct(x.alias("x"), y.alias("y")), lambda b: F.when(b["x"].isNotNull() & b["y"].isNotNull(), F.struct(at.alias("at"), b["x"]["col"].alias("x_col"), b["x"]["kind"].alias("x_kind"), b["y"].alias("y_col"))))
            return both.cast(HEAD)

        return let(F.transform(cells, named), of)

    state = f"struct<n:int,head:{HEAD}>"
    step = lambda s, r: F.when(s["head"].isNotNull(), s).otherwise(F.struct((s["n"] + 1).alias("n"), head(r["cells"], s["n"]).alias("head")).cast(state))
    return F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(None).cast(HEAD).alias("head")).cast(state), step, lambda s: s["head"])


def filled_down(cells: Column) -> Column:
    """Empty and missing cells as the last one above that is neither; null before the first.  Cells hold no line feed."""
    told = F.concat(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "\n"), F.lit("\n"))
    runs = F.transform(F.regexp_extract_all(told, F.lit(r"[^\n]+\n+"), F.lit(0)), lambda m: let(F.rtrim(m, F.lit("\n")), lambda c: F.array_repeat(c, F.length(m) - F.length(c))))
    return F.concat(F.array_repeat(F.lit(None).cast("string"), F.length(F.regexp_extract(told, r"^\n*", 0))), F.flatten(runs))


def pairs_of_tables(text: Column, y_unit: Column, wanted: Column, carry: tuple[str, ...] = ()) -> Column:
    """array<struct(table, line, kind, x, y)> of the rows below each table's head, in order.

    Cells in degrees Celsius become kelvin, in kPa bar.  Columns named in
    ``carry`` ("x", "y") are half empty: an empty cell repeats the last value
    above it in its table, as a merged cell is read.  Otherwise a row without
    both numbers gives no pair.
    """
    number = lambda c: F.regexp_extract(c, r"\d+(?:\.\d+)?", 0).try_cast("double")

    def pair(r: Column, table: Column, kind: Column) -> Column:
        low, x = F.lower(r["x"]), number(r["x"])
        x = F.when(kind == "temperature", F.round(x + F.when(low.contains("°c") | low.contains("℃"), 273.15).otherwise(0.0), 3)).otherwise(
            F.round(F.when((kind == "pressure") & low.contains("kpa"), x / 100).otherwise(x), 5)
        )
        return F.struct(table.alias("table"), r["line"].alias("line"), kind.alias("kind"), x.alias("x"), number(r["y"]).alias("y"))

    def below(rows: Column, table: Column) -> Column:
        def of(h: Column) -> Column:
            under = F.slice(rows, h["at"] + 2, F.size(rows))
            column = lambda side: F.transform(under, lambda r: F.get(r["cells"], h[f"{side}_col"]))
            sides = [(filled_down(column(side)) if side in carry else column(side)).alias(side) for side in ("x", "y")]
            pairs = F.transform(F.arrays_zip(F.transform(under, lambda r: r["line"]).alias("line"), *sides), lambda r: pair(r, table, h["x_kind"]))
            return F.when(h.isNotNull(), F.filter(pairs, lambda p: p["x"].isNotNull() & (p["y"] > 0) & (p["y"] < 1e6)))

        found = let(table_head(rows, y_unit, wanted), of)
        return F.coalesce(found, F.array().cast("array<struct<table:int,line:int,kind:string,x:double,y:double>>"))

    return F.flatten(F.transform(tables_of(text), below))


def table_pairs(blocks: DataFrame, keys: list[str], y_unit: Column, wanted: Column, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """keys, table, line, kind, x, y of :func:`pairs_of_tables`."""
    return each(blocks, keys, pairs_of_tables(F.col(text), y_unit, wanted, carry), "_p", "pair").select(*keys, "pair.*")


def matches(text: Column, pattern: str, groups: int) -> Column:
    """Matches in order, as array<struct(g0..gn)>; g0 is the whole match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])


def structure_values(text: Column, scaled: bool) -> Column:
    """Structure variables of a text in order, as array<struct<kind, x>>; ``scaled``: MPa and GPa become bar too.

    The text is searched once: how a match begins and ends says which of the pattern's forms it has.
    """

    def one(m: Column) -> Column:
        whole = F.lower(m)
        v = F.regexp_extract(m, r"\d+(?:\.\d+)?", 0).cast("double")
        bar = F.when(whole.endswith("kpa"), v / 100)
        if scaled:
            bar = bar.when(whole.endswith("gpa"), v * 10000).when(whole.endswith("mpa"), v * 10)
        named, percent = ~F.left(m, F.lit(1)).between("0", "9"), whole.endswith("%")
        pressure = whole.endswith("bar") | whole.endswith("atm") | whole.endswith("pa")
        kind = F.when(named, "composition").when(percent, "percentage").when(pressure, "pressure").otherwise("temperature")
        x = F.when(named | percent, v).when(pressure, F.round(bar.otherwise(v), 5)).otherwise(F.round(v + F.when(whole.endswith("°c") | whole.endswith("℃"), 273.15).otherwise(0.0), 3))
        return F.struct(kind.alias("kind"), x.alias("x"))

    return F.transform(F.regexp_extract_all(text, F.lit(fixed.POINT_X), F.lit(0)), one)


def value_units(text: Column) -> Column:
    """Values with a unit in order, as array<struct<v, u>>: numbers as they stand and spelled units.  The text is searched once; no unit begins with a digit, so a match parts in one way."""

    def two(m: Column) -> Column:
        number = F.regexp_extract(m, r"^\d+(?:\.\d+)?", 0)
        return F.struct(number.alias("v"), F.regexp_replace(F.substring(m, F.length(number) + 1, F.length(m)), r"^\s+", "").alias("u"))

    return F.transform(F.regexp_extract_all(text, F.lit(fixed.POINT_VALUE), F.lit(0)), two)


def unit_values(text: Column, y_unit: Column) -> Column:
    """The values of a text that stand with the unit, in order."""
    found = F.filter(value_units(text), lambda m: unit_b(m["u"]) == y_unit)
    return F.filter(F.transform(found, lambda m: m["v"].cast("double")), lambda v: (v > 0) & (v < 1e6))


def without_structure(text: Column) -> Column:
    """A text whose structure variables are a letter (or a sign of per cent) each, so that numbers inside them are none and those beside them keep their neighbours' kind."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d+(?:\.\d+)?)\s*%(?!\s*(?:rh|湿度))", "%"), fixed.POINT_X, "a")


def bare_values(text: Column, low: Column, high: Column) -> Column:
    """Numbers without a unit between ``low`` and ``high``; large integers are years or numbers of something."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(fixed.BARE_NUMBER), F.lit(1)), lambda n: n.cast("double"))
    return F.filter(numbers, lambda v: v.between(low, high) & ~((v == F.floor(v)) & (v > 10000)))


def pairs_of_sentence(t: Column, y_unit: Column) -> Column:
    """U16: array<PAIR> of a sentence in lower case: "from A to B" of x with the "from A to B" of y, and as many values of x as of y in order."""
    spelled = F.array_join(F.regexp_extract_all(y_unit, F.lit(r"[a-z]+|\d+|%|[^\x00-\x7F]"), F.lit(0)), r"[\s/]*")
    y_range = F.concat(F.lit(r"(?i)\bfrom\s+(\d+(?:\.\d+)?)\s+to\s+(\d+(?:\.\d+)?)\s*"), spelled, F.lit(r"(?!\w)"))
    group = lambda pattern, g: F.regexp_extract_all(t, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(g))
    xa, xb, xu, ya, yb = group(fixed.X_FROM_TO, 1), group(fixed.X_FROM_TO, 2), group(fixed.X_FROM_TO, 3), group(y_range, 1), group(y_range, 2)

    def ranges(z: Column) -> Column:
        warm, hot = F.lower(z["u"]).isin("k", "°c", "℃"), F.lower(z["u"]).isin("°c", "℃")
        kind = F.when(warm, "temperature").otherwise("pressure")
        return F.array(*[F.struct(kind.alias("kind"), F.round(z[x].cast("double") + F.when(hot, 273.15).otherwise(0.0), 5).alias("x"), z[y].cast("double").alias("y")).cast(PAIR) for x, y in (("xa", "ya"), ("xb", "yb"))])

    none = F.array().cast(f"array<{PAIR}>")
    both = F.filter(F.arrays_zip(xa.alias("xa"), xb.alias("xb"), xu.alias("u"), ya.alias("ya"), yb.alias("yb")), lambda z: z["xa"].isNotNull() & z["ya"].isNotNull())
    told = F.when(t.contains("from"), F.flatten(F.transform(both, ranges))).otherwise(none)  # sentences are in lower case
    pair = lambda x, y: F.struct(x["kind"].alias("kind"), x["x"].alias("x"), y.alias("y")).cast(PAIR)
    zipped = lambda x, y: F.when(F.size(x) == F.size(y), F.zip_with(x, y, pair)).otherwise(none)
    # Most sentences have no value of the unit: they are not searched for structure variables.
    return F.concat(told, let(unit_values(t, y_unit), lambda y: F.when(F.size(y) > 0, let(structure_values(t, False), lambda x: zipped(x, y))).otherwise(none)))


def sentences_of(text: Column, ends: str) -> Column:
    """The sentences of a text, in lower case and trimmed; one of fewer than eight characters is empty."""
    return F.transform(F.split(F.lower(text), ends), lambda s: let(F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")), lambda t: F.when(F.length(t) >= 8, t).otherwise("")))


def sentence_pairs(blocks: DataFrame, keys: list[str], y_unit: Column, text: str = "text", ends: str = fixed.POINT_SENTENCE) -> DataFrame:
    """keys, place, kind, x, y of the pairs of each sentence (:func:`pairs_of_sentence`).

    ``ends`` parts sentences; the fixed one also parts at a decimal point.
    """
    extra = [c for c in blocks.columns if c not in (*keys, text)]
    sentences = each(blocks, [*keys, *extra], sentences_of(F.col(text), ends), "_s", "_t").where("_t <> ''")
    return each(sentences, [*keys, "_s"], pairs_of_sentence(F.col("_t"), y_unit), "_p", "pair").select(*keys, (F.col("_s") * 1000 + F.col("_p")).alias("place"), "pair.*")


def dominant_unit(texts: Column, wanted: Column, merit: Column) -> Column:
    """The unit most values of the texts have (of equals the one met first); where none has one, the unit most heads name; "dimensionless" for a figure of merit."""
    fits = lambda u: (F.size(wanted) == 0) | F.array_contains(wanted, u)
    # Spellings are counted first, so that each is read as a unit once: spellings of one unit add up.
    spelled = lambda found, raw: F.struct(unit_b(raw).alias("unit"), F.size(F.filter(found, lambda v: v == raw)).alias("n"), F.array_position(found, raw).alias("first"))
    of_unit = lambda counts, u: let(F.filter(counts, lambda c: c["unit"] == u), lambda own: F.struct(F.aggregate(own, F.lit(0), lambda n, c: n + c["n"]).alias("n"), (-F.array_min(F.transform(own, lambda c: c["first"]))).alias("first"), u.alias("unit")))
    most = lambda counts: let(counts, lambda cs: F.array_max(F.transform(F.array_distinct(F.transform(cs, lambda c: c["unit"])), lambda u: of_unit(cs, u)))["unit"])

    def units(pattern: str, g: int) -> Column:
        found = F.flatten(F.transform(texts, lambda b: F.regexp_extract_all(b, F.lit(pattern), F.lit(g))))
        return let(found, lambda a: F.transform(F.array_distinct(a), lambda raw: spelled(a, raw)))

    shown = F.filter(units(fixed.POINT_VALUE, 2), lambda c: fits(c["unit"]))
    heads = F.filter(units(r"\(([^)]+)\)", 1), lambda c: fits(c["unit"]) & unit_range(c["unit"]).isNotNull())
    bare = F.exists(texts, lambda b: F.size(bare_values(F.lower(b), F.lit(0.01), F.lit(20.0))) > 0)
    return F.when(merit, F.when(bare, "dimensionless")).otherwise(F.coalesce(most(shown), most(heads)))


def related_blocks(parts: Column, materials: Column) -> Column:
    """Of blocks, an array of struct(block, text), those that name a material of the document (lower-case words), if three or more do; else all."""
    words = F.filter(F.coalesce(materials, F.array().cast("array<string>")), lambda w: F.length(w) >= 3)
    hits = let(words, lambda ws: F.filter(parts, lambda p: let(F.lower(p["text"]), lambda low: F.exists(ws, lambda w: F.contains(low, w)))))
    return let(hits, lambda h: F.when(F.size(h) >= 3, h).otherwise(parts))


def literature_points(
    docs: DataFrame, id_col: str, text_col: str, prop: Column | str, materials: str | None = None, carry: tuple[str, ...] = (), ends: str = fixed.POINT_SENTENCE, least: int = 3, per_doc: int | None = None
) -> DataFrame:
    """Doc, block, x_kind, x, y, provenance, y_unit of each document's points.

    Four ways give pairs, in this order: tables, sentences, the ends of a
    composition range (band gaps only), and every x with every y of a block (not
    for figures of merit), whose candidates the tables back-fill.  A pair counts
    once, where it comes first; the kind of x with most pairs and ``least``
    distinct x stays, with all of its points (``per_doc``: the first so many by
    x and y).  ``prop`` is a literal or a column of ``docs``.
    """
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text"), (F.lit(prop) if isinstance(prop, str) else prop).alias("_prop"), *([F.col(materials).alias("_materials")] if materials else []))
    parts = F.transform(extract.block_texts(F.col("_text")), lambda b, i: F.struct(i.alias("block"), b.alias("text")))
    named = once(source, ["doc", "_prop", *(["_materials"] if materials else [])], _units=F.coalesce(accepted_units("_prop"), F.array().cast("array<string>")), _parts=parts)
    if materials:
        named = once(named, ["doc", "_prop", "_units"], _parts=related_blocks(F.col("_parts"), F.col("_materials")))
    wanted, merit, y_unit = F.col("wanted"), F.col("merit"), F.col("y_unit")
    named = once(named, ["doc", "_parts"], wanted=F.array_remove("_units", "dimensionless"), merit=F.array_contains("_units", "dimensionless"), gaps=F.lower("_prop").rlike(_band_gap()))
    known = once(named, named.columns, y_unit=dominant_unit(F.transform("_parts", lambda p: p["text"]), wanted, merit))
    keys = ["doc", "y_unit", "block"]
    blocks = each(known, ["doc", "y_unit", "wanted", "merit", "gaps"], F.when(y_unit.isNotNull(), F.col("_parts")), "_k", "_b").select("doc", "y_unit", "wanted", "merit", "gaps", "_b.*")

    # What a block says, each once: pairs of its tables, of its sentences and of its ranges, and candidates of its text.
    low, pairs = F.lower("text"), f"array<{PAIR}>"
    rows = once(
        blocks, [*keys, "merit", "text"],
        _t=pairs_of_tables(F.col("text"), y_unit, wanted, carry), _s=F.flatten(F.transform(sentences_of(F.col("text"), ends), lambda t: F.when(t != "", pairs_of_sentence(t, y_unit)).otherwise(F.array().cast(pairs)))),
        _ends=F.when(F.col("gaps") & ~merit, range_points(low)).otherwise(F.array().cast(pairs)), _x=structure_values(low, True), _shown=unit_values(low, y_unit),
    )
    bounds, head, plain = unit_range(y_unit), unit_b(F.regexp_extract("text", fixed.BRACKETED, 1)), without_structure(low)
    bare = F.when(bounds.isNotNull() & (head == y_unit) & F.col("text").rlike(fixed.BRACKETED), bare_values(plain, bounds["lo"], bounds["hi"]))
    ys = F.when(merit, bare_values(F.regexp_replace(plain, fixed.POINT_VALUE, "a"), F.lit(0.01), F.lit(20.0))).when(F.size("_shown") > 0, F.col("_shown")).otherwise(F.coalesce(bare, F.array().cast("array<double>")))
    rows = once(rows, [*keys, "merit", "_t", "_s", "_ends", "_x", "_shown"], _y=ys)
    # Back-fill: what tables and ranges say joins the candidates of the text.  Kind by kind, for numbers are told apart by hash and structs one by one.
    said = [F.col(c) for c in ("_x", "_t", "_ends")]
    of_kind = lambda kind: F.array_distinct(F.flatten(F.array(*[F.transform(F.filter(c, lambda p: p["kind"] == kind), lambda p: p["x"]) for c in said])))
    item = lambda kind, x, y, way: F.struct(kind.alias("kind"), x.alias("x"), y.alias("y"), way.alias("way")).cast("struct<kind:string,x:double,y:double,way:int>")
    of_pairs = lambda c, way: F.transform(c, lambda p: item(p["kind"], p["x"], p["y"], F.lit(way)))
    left_over = F.when(~merit & (F.size("_shown") == 0), 3).otherwise(2)
    alone = lambda kind: F.transform(of_kind(kind), lambda x: item(F.lit(kind), x, F.lit(None), left_over))
    crossed = F.concat(*map(alone, KINDS))
    no_items = F.array().cast("array<struct<kind:string,x:double,y:double,way:int>>")
    items = F.concat(of_pairs("_t", 0), of_pairs("_s", 1), of_pairs("_ends", 1), F.when(merit, no_items).otherwise(crossed))
    all_y = F.array_distinct(F.concat(F.col("_y"), F.transform("_t", lambda p: p["y"]), F.transform("_ends", lambda p: p["y"])))
    rows = once(rows, keys, _items=items, _all_y=all_y, _implicit=F.size("_y") > 0)
    found = each(rows, [*keys, "_all_y", "_implicit"], F.col("_items"), "_place", "p")
    way = F.when((F.col("p.way") == 3) & ~F.col("_implicit"), 2).otherwise(F.col("p.way"))
    # block, place and way in one number: a text of 2^31 bytes has fewer than 2^29 blocks.
    at = F.shiftleft(F.col("block").cast("long"), 34) + F.shiftleft(F.col("_place").cast("long"), 2) + way
    found = found.select("doc", "y_unit", "p.kind", "p.x", at.alias("at"), F.explode_outer(F.when(F.col("p.way") >= 2, F.col("_all_y")).otherwise(F.array("p.y"))).alias("y")).where("y IS NOT NULL")
    points = found.groupBy("doc", "y_unit", "kind", "x", "y").agg(F.min("at").alias("at"))
    of_kind, of_doc = Window.partitionBy("doc", "kind"), Window.partitionBy("doc")
    points = points.withColumn("_nth", F.dense_rank().over(of_kind.orderBy("x")))
    points = points.withColumns({"_n": F.count(F.lit(1)).over(of_kind), "_nx": F.max("_nth").over(of_kind), "_first": F.min(F.struct("x", "y")).over(of_kind)})
    best = F.min(F.when(F.col("_nx") >= least, F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"), F.col("kind").alias("kind")))).over(of_doc)
    points = points.withColumn("_best", best).where("kind = _best.kind")
    points = points if per_doc is None else resolve.capped(points, ["doc"], [F.col("x"), F.col("y")], per_doc)
    provenance = F.element_at(F.array(*map(F.lit, WAYS)), (F.col("at").bitwiseAND(F.lit(3)) + 1).cast("int"))
    return points.select("doc", F.shiftright("at", 34).cast("int").alias("block"), F.col("kind").alias("x_kind"), "x", "y", provenance.alias("provenance"), "y_unit")


def _band_gap() -> str:
    from .parsing import BAND_GAP

    return BAND_GAP


def range_points(text: Column) -> Column:
    """U17 by block: both ends of every composition range of a lower-case text."""
    from .parsing import RANGE_ENDS

    def two(m: Column) -> Column:
        y1, y2, x1, x2 = (m[f"g{k}"].cast("double") for k in range(1, 5))
        good = x1.between(0, 1) & x2.between(0, 1) & (y1 > 0) & (y1 < 1e3) & (y2 > 0) & (y2 < 1e3)
        pair = lambda x, y: F.struct(F.lit("composition").alias("kind"), x.alias("x"), y.alias("y")).cast(PAIR)
        return F.when(good, F.array(pair(x1, y1), pair(x2, y2))).otherwise(F.array().cast(f"array<{PAIR}>"))

    return F.flatten(F.transform(matches(text, RANGE_ENDS, 4), two))


