"""Fields out of papers, reports and agent texts: headers, sections, keys, round configurations, plain (x, y) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import col, filled, find_all, normalize_doi_bib

# Headings and field names of papers.
TITLE = r"(?m)^#\s+(.+)$"
ABSTRACT = [
    r"(?is)(?:^|\n)#*\s*(?:Abstract|摘要)\s*\n+(.*?)(?:\n#+\s|\n\n(?:Introduction|INTRO|引言))",
    r"(?is)(?:^|\n)Abstract[：:]\s*(.*?)(?:\n\n|\n(?:Keywords|关键词))",
]
AUTHORS = [r"(?:Authors?|AUTHORS)[：:]\s*(.+?)(?:\n|$)", r"\n([A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:,\s*[A-Z][a-z]+(?:\s+[A-Z]\.?)?){2,})"]
# Keys of evidence, and the words that mark prose.
KEY = r"\b(?:p\d+|TE\d+|P\d+|v\d+s\d+(?:_[0-9a-f]+)?|r\d+s\d+(?:_[0-9a-f]+)?|10\.\d{4,}/[^\s()]+)\b"
WHOLE_KEY = r"^(?:p\d+|TE\d+|P\d+|v\d+s\d+(?:_[0-9a-f]+)?|r\d+s\d+(?:_[0-9a-f]+)?|10\.\d{4,}/[^\s()]+)$"
PROSE = ["Novelty", "Overlap", "LLM", "Assessment"]
NUMBERED_DOI = r"p(\d+)\s*[（(]\s*(?:DOI:\s*)?(10\.\S+?)\s*[）)]"
# What a round's text says of its queries, materials and properties.
ROUND = {
    "search_queries": r"(?i)(?:search|query|检索)[:\s]*[\"']?([^\"'\n]{5,100})[\"']?",
    "materials": r"(?i)(?:material|材料)[:\s]*([A-Z][a-z]?[0-9A-Za-z]{1,20})",
    "properties": r"(?i)(?:property|性质)[:\s]*(band gap|conductivity|PCE|stability|efficiency)[\w\s]*",
}
# End points of a range of compositions, "1.55→2.3 (x 0→1)".
RANGE_ENDS = r"(?i)(\d+(?:\.\d+)?)\s*(?:→|->|至|~|to)\s*(\d+(?:\.\d+)?)\s*[（(]\s*x\s*[:=：]?\s*(\d+(?:\.\d+)?)\s*(?:→|->|至|~|to)\s*(\d+(?:\.\d+)?)\s*[，,]?\s*[^）)]{0,30}[）)]"
BAND_GAP = r"带隙|band\s*gap|bandgap|禁带|能隙|\beg\b|e_g"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _match(text: Column, pattern: str) -> Column:
    """The stripped first group of the first match; null without one or if it is empty."""
    return filled(strip(F.regexp_extract(text, pattern, 1)))


def paper_title(text: Column, name: Column) -> Column:
    """P25: the first heading, else the first of five lines with more than ten characters, else the name."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), strip), lambda x: F.length(x) > 10)
    return F.coalesce(_match(text, TITLE), F.left(F.get(lines, F.lit(0)), F.lit(200)), name)


def paper_abstract(text: Column) -> Column:
    """P25: the abstract's section or line, else the first of five paragraphs with more than a hundred characters that is no heading."""
    parts = F.filter(F.transform(F.slice(F.split(text, "\n\n"), 1, 5), strip), lambda x: (F.length(x) > 100) & ~x.startswith("#"))
    return F.left(F.coalesce(*[_match(text, p) for p in ABSTRACT], F.get(parts, F.lit(0)), F.lit("")), F.lit(2000))


def paper_authors(text: Column) -> Column:
    """P25: the authors' line, else a line of names; names of more than two characters."""
    line = F.coalesce(*[_match(F.left(text, F.lit(2000)), p) for p in AUTHORS], F.lit(""))
    return F.filter(F.transform(F.split(line, "[,;、]"), strip), lambda x: F.length(x) > 2)


def flat_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, section, heading, text, n_lines): headings of any level start a section; lines before the first are section 0."""
    text = F.regexp_replace(F.coalesce(col(text_col), F.lit("")), r"\r\n?", "\n")
    lines = docs.select(F.col(id_col).alias("doc"), text.alias("_t")).where("_t <> ''").select("doc", F.posexplode(F.split("_t", "\n")).alias("line", "s"))
    head = F.col("s").rlike(r"^#{1,6}\s+.*$")
    lines = lines.withColumn("section", F.count_if(head).over(Window.partitionBy("doc").orderBy("line")))
    return lines.groupBy("doc", "section").agg(
        F.min(F.when(head, F.trim("s"))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines")
    )


def first_engine(rows: DataFrame, engines: list[tuple[str, str, str]], fallback: tuple[str, str]) -> DataFrame:
    """Adds text and parse_engine.

    engines: (name, column of its text, column of its error) by priority; the first text wins.  Else the fallback's
    (name, column) with the reason: the first error of an engine that ran, or that none was available.
    """
    name, plain = fallback
    text, engine = F.col(plain), F.concat(F.lit(f"{name} ("), F.coalesce(*[filled(e) for _, _, e in engines], F.lit("no engine available")), F.lit(")"))
    for label, found, _ in reversed(engines):
        engine = F.when(F.col(found).isNotNull(), F.lit(label)).otherwise(engine)
        text = F.coalesce(F.col(found), text)
    return rows.withColumns({"text": text, "parse_engine": engine})


def parse_all(files: DataFrame, parse: Callable[[str, bytes], tuple[str, str]], path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, text, parse_engine) of every file; one that fails is a row with its error and the engine "error"."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((path, *parse(path, content)))
                except Exception as e:  # noqa: BLE001  (one bad file must not stop the others)
                    rows.append((path, f"[Parse Error: {e}]", "error"))
            yield pd.DataFrame(rows, columns=["path", "text", "parse_engine"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInPandas(run, "path string, text string, parse_engine string")


def evidence_keys(items: Column | str) -> Column:
    """Keys named by an evidence chain, in order; entries of prose are skipped, whole keys taken, others searched."""
    plain = F.filter(F.transform(col(items), strip), lambda e: (e != "") & ~e.rlike("|".join(PROSE)))
    return F.flatten(F.transform(plain, lambda e: F.when(e.rlike(WHOLE_KEY), F.array(e)).otherwise(F.regexp_extract_all(e, F.lit(KEY), F.lit(0)))))


def numbered_dois(docs: DataFrame, id_col: str, text_col: str, above: int = 180) -> DataFrame:
    """(doc, number, doi) of "p181 (DOI: 10...)" with numbers beyond ``above``; the last mention of a number stands."""
    found = docs.select(F.col(id_col).alias("doc"), F.explode(find_all(F.coalesce(col(text_col), F.lit("")), NUMBERED_DOI, 2)).alias("m"))
    found = found.select("doc", F.col("m.g1").cast("int").alias("number"), F.col("m.start").alias("start"), normalize_doi_bib("m.g2").alias("doi")).where(F.col("number") > above)
    return found.groupBy("doc", "number").agg(F.max_by("doi", "start").alias("doi"))


def round_config(text: Column | str) -> Column:
    """struct(search_queries, materials, properties) of a round's text: the first five queries, up to ten names in order."""
    found = {k: F.regexp_extract_all(col(text), F.lit(p), F.lit(1)) for k, p in ROUND.items()}
    names = lambda a: F.slice(F.array_sort(F.array_distinct(F.transform(a, strip))), 1, 10)
    return F.struct(F.slice(found["search_queries"], 1, 5).alias("search_queries"), names(found["materials"]).alias("materials"), names(found["properties"]).alias("properties"))


def strategy(text: Column | str) -> Column:
    """The last two sentences; of a text without any its first 200 characters."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(col(text), "\n", " "), "。"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), "。")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.left(col(text), F.lit(200))))


def touched_files(tools: Column | str) -> Column:
    """Files that a round wrote or edited; tools: array of struct(tool, file, ...)."""
    return F.filter(F.transform(F.filter(col(tools), lambda t: t["tool"].isin("write_file", "edit_file")), lambda t: t["file"]), lambda f: filled(f).isNotNull())


def range_ends(docs: DataFrame, id_col: str, text_col: str, prop: Column | str) -> DataFrame:
    """(doc, x, y, place): the two end points of a composition range, for band gaps only."""
    rows = docs.where(F.lower(col(prop)).rlike(BAND_GAP)).select(F.col(id_col).alias("doc"), F.explode(find_all(F.lower(F.coalesce(col(text_col), F.lit(""))), RANGE_ENDS, 4)).alias("m"))
    y1, y2, x1, x2 = (F.col(f"m.g{k}").cast("double") for k in range(1, 5))
    good = x1.between(0, 1) & x2.between(0, 1) & (y1 > 0) & (y1 < 1e3) & (y2 > 0) & (y2 < 1e3)
    ends = F.array(*[F.struct(x.alias("x"), y.alias("y"), (F.col("m.start") * 2 + k).alias("place")) for k, (x, y) in enumerate(((x1, y1), (x2, y2)))])
    return rows.where(good).select("doc", F.inline(ends))


def grid_cells(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, part, row, place, cell: the filled cells of the lines with bars in each part of a text (parts end at an empty line or a heading), from the first line that has two bars."""
    parts = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(col(text_col), F.lit("")), r"\n\n|\n(?=##)")).alias("part", "_p"))
    tables = parts.select("doc", "part", F.regexp_extract("_p", r"(?s)(\|[^\n]+\|.*)$", 1).alias("_t")).where("_t <> ''")
    lines = F.filter(F.split("_t", "\n"), lambda line: line.contains("|"))
    rows = tables.select("doc", "part", F.posexplode(lines).alias("row", "_line"))
    cells = F.filter(F.transform(F.split("_line", r"\|"), strip), lambda c: c != "")
    return rows.select("doc", "part", "row", F.posexplode(cells).alias("place", "cell"))


def own_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, x, y, source, pair) of every text: two numeric columns of its tables, values at a temperature, and lists; no units are compared.

    A table's third line and those below it are data.  Its columns are the first
    two whose heads look numeric, or else the first two with a number in the
    first five lines of data; commas are decimal points.
    """
    cells = grid_cells(docs, id_col, text_col).withColumn("v", F.replace("cell", F.lit(","), F.lit(".")).try_cast("double"))
    places = lambda chosen: F.array_sort(F.collect_set(F.when(chosen, F.col("place"))))
    named = places((F.col("row") == 0) & F.col("cell").rlike(fixed.NUMERIC_HEAD))
    numeric = places(F.col("row").between(2, 6) & F.col("v").isNotNull())
    columns = cells.groupBy("doc", "part").agg(named.alias("_n"), numeric.alias("_v")).select("doc", "part", F.when(F.size("_n") > 1, F.col("_n")).otherwise(F.col("_v")).alias("_c"))
    data = cells.where("row > 1").join(columns.where(F.size("_c") > 1), ["doc", "part"])
    at = lambda k: F.max(F.when(F.col("place") == F.get("_c", F.lit(k)), F.col("v")))
    tables = data.groupBy("doc", "part", "row").agg(at(0).alias("x"), at(1).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    found = tables.select("doc", "x", "y", F.lit("table").alias("source"), F.struct(F.lit(0).alias("way"), "part", "row").alias("_at"))
    text = F.coalesce(col(text_col), F.lit(""))
    for way, (pattern, source) in enumerate(((fixed.PAIR_AT, "sentence"), (fixed.PAIR_LIST, "list_pair")), 1):
        both = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2)])
        said = docs.select(F.col(id_col).alias("doc"), F.posexplode(both).alias("row", "m"))
        found = found.unionByName(said.select("doc", F.col("m.g1").cast("double").alias("x"), F.col("m.g2").cast("double").alias("y"), F.lit(source).alias("source"), F.struct(F.lit(way).alias("way"), F.lit(0).alias("part"), "row").alias("_at")))
    order = Window.partitionBy("doc").orderBy("_at")
    return found.select("doc", "x", "y", "source", (F.row_number().over(order) - 1).alias("pair"))
