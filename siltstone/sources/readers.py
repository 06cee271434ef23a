"""Readers of saved results, logs and documents; every scan has an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import filled, normalize_doi


def records(spark: SparkSession, path: str, schema: str, required: list[str] = (), multiline: bool = True) -> DataFrame:
    """Tolerant JSON: unknown keys vanish, rows without a required field are dropped, broken files give no rows."""
    rows = spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """S3: entries of an Atom feed as papers; score 0, year from the date, the link titled pdf as pdf_url."""
    schema = "id string, title string, summary string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_rel:string>>, published string, doi string, journal_ref string"
    e = spark.read.format("xml").schema(schema).option("rowTag", "entry").option("ignoreNamespace", True).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    pdf = F.filter("link", lambda x: x["_title"] == "pdf")
    return e.select(
        squeeze("title").alias("title"), F.transform("author", lambda a: a["name"]).alias("authors"), squeeze("summary").alias("abstract"),
        F.left("published", F.lit(4)).try_cast("int").alias("year"), normalize_doi("doi").alias("doi"), F.trim("id").alias("url"), F.lit(0.0).alias("score"),
        F.col("journal_ref").alias("journal"), F.try_element_at(F.transform(pdf, lambda x: x["_href"]), F.lit(1)).alias("pdf_url"),
    )


def _any(variant: Column, names: list[str], kind: str = "string") -> Column:
    """The first filled one of several field names."""
    found = [F.try_variant_get(variant, f"$.{n}", "string") for n in names]
    text = F.coalesce(*[filled(F.trim(x)) for x in found])
    return text if kind == "string" else text.try_cast(kind)


def any_doi(v: Column) -> Column:
    """The DOI under any of its names, in the ids of an entry, or behind doi.org/ in its address."""
    url = F.try_variant_get(v, "$.url", "string")
    behind = F.when(url.contains("doi.org"), F.substring_index(url, "doi.org/", -1))
    return normalize_doi(F.coalesce(_any(v, ["doi", "DOI", "Doi", "ids.DOI", "ids.doi", "external_ids.DOI", "external_ids.doi"]), filled(behind)))


def search_response(spark: SparkSession, path: str, list_names: tuple[str, ...] = ("results", "data", "papers", "items")) -> DataFrame:
    """Responses of several shapes to papers; rows without a title are skipped."""
    body = F.try_parse_json("value")
    lists = F.coalesce(*[F.try_variant_get(body, f"$.{n}", "array<variant>") for n in list_names], F.try_variant_get(body, "$", "array<variant>"))
    item = spark.read.text(path, wholetext=True).select(F.explode(lists).alias("v"))
    v = F.col("v")
    rows = item.select(
        _any(v, ["title", "Title", "name"]).alias("title"), _any(v, ["abstract", "summary", "snippet"]).alias("abstract"),
        _any(v, ["year", "publication_year", "published_year"], "int").alias("year"), any_doi(v).alias("doi"),
        _any(v, ["url", "link"]).alias("url"), _any(v, ["score", "relevance"], "double").alias("score"),
        F.coalesce(_any(v, ["citation_count", "citationCount", "citations"], "bigint"), F.lit(0)).alias("citation_count"),
        _any(v, ["journal", "venue"]).alias("journal"), _any(v, ["paper_id", "paperId", "id"]).alias("paper_id"),
    )
    return rows.where("title is not null")


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """A list, or an object with hypotheses or results; ``pos`` is the place in the list (Q13)."""
    body = F.try_parse_json("value")
    lists = F.coalesce(*[F.try_variant_get(body, p, "array<variant>") for p in ("$", "$.hypotheses", "$.results")])
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(lists).alias("pos", "v"))
    parsed = F.from_json(F.to_json("v"), schemas.HYPOTHESES)
    return rows.select("pos", parsed.alias("h")).select("pos", "h.*")


def search_scores(spark: SparkSession, pattern: str) -> DataFrame:
    """Best score by hypothesis number, from the number in the file's name."""
    rows = spark.read.schema(schemas.SEARCH_FILE).option("multiLine", True).json(pattern)
    index = F.regexp_extract(F.col("_metadata.file_path"), r"search_h(\d+)\.json", 1).try_cast("int")
    return rows.select(index.alias("pos"), "search_method", "best_score", "iteration_log")


def report(hyps: DataFrame, scores: DataFrame) -> DataFrame:
    """Hypotheses beside the search files of their place."""
    return hyps.drop("best_score").join(scores.select("pos", "search_method", "best_score"), "pos", "left")


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """Key, type and fields of BibTeX entries; an entry ends where the next one starts."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\s*@)")).alias("e")).where(F.col("e").rlike(r"^\s*@\w+\s*\{"))
    field = lambda name: filled(F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?is)\b{name}\s*=\s*[{{\"]+(.*?)[}}\"]+\s*(?:,\s*\n|\n?\s*\}}\s*$)", 1), r"[{}]", "")))
    return entries.select(
        F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("kind"), field("title").alias("title"),
        normalize_doi(field("doi")).alias("doi"), field("author").alias("authors"), field("year").try_cast("int").alias("year"), field("journal").alias("journal"),
    )


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a Markdown summary: id, title, year, venue."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=### )")).alias("b")).where(F.col("b").rlike("^### "))
    field = lambda names: filled(F.trim(F.regexp_extract("b", rf"(?i)\*\*(?:{names}):?\*\*:?\s*([^\n]+)", 1)))
    return blocks.select(
        field("id").alias("id"), F.trim(F.regexp_extract("b", r"^### (?:\d+\.\s*)?([^\n]*)", 1)).alias("title"), F.regexp_extract(F.coalesce(field("year|年份"), F.lit("")), r"((?:19|20)\d{2})", 1).try_cast("int").alias("year"), field("venue|journal|期刊").alias("venue")
    )


def quantitative_pairs(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """S35."""
    rows = records(spark, path, schemas.QUANT_PAIRS).select(F.inline("pairs"))
    return rows.where(F.col("dataset") == dataset) if dataset else rows


def meta_systems(spark: SparkSession, path: str) -> DataFrame:
    """Systems with the ratio of the middle to the mean of the ends."""
    rows = records(spark, path, schemas.META_SYSTEMS).select(F.inline("systems"))
    return rows.withColumn("ratio", F.try_divide(F.col("midpoint_value"), (F.col("endpoint_low") + F.col("endpoint_high")) / 2))


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken lines give no rows."""
    rows = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """One row per tool call of each round."""
    rows = records(spark, path, schemas.TRAJECTORY).select(F.inline("trajectory"))
    return rows.select("round", "iteration", "budget_remaining", F.explode_outer("tools_called").alias("t")).select("round", "iteration", "budget_remaining", "t.tool", "t.file")


def documents(spark: SparkSession, folder: str, pattern: str = "*.{md,txt,html}") -> DataFrame:
    """Text files of a folder and below: path, text."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def slice_text(text: Column | str, offset: int, limit: int) -> Column:
    """S8."""
    return F.substring(text, offset + 1, limit)


def run_folders(paths: DataFrame, column: str = "path") -> DataFrame:
    """folders of runs whose own name holds neither test nor smoke."""
    return paths.where(~F.lower(F.element_at(F.split(F.rtrim(F.col(column), F.lit("/")), "/"), -1)).rlike("test|smoke"))
