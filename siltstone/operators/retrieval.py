"""Inverted-index retrieval, federation and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, normalize_doi, tokenize
from ..session import cut


def postings(docs: DataFrame, id_col: str, text_col: str, unicode: bool = True) -> DataFrame:
    """A1 (exploded): one row per distinct term of a document."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(tokenize(text_col, unicode))).alias("term"))


def naming_any(docs: DataFrame, text_col: str, query: str) -> DataFrame:
    """The documents that hold one of the query's terms as a string: what a search has to tokenise (terms are letters, digits and dashes of the lower-cased text)."""
    spark = docs.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokenize("q", False))).alias("t")).collect()  # terms of a query
    low = F.lower(text_col)
    return docs.where(reduce(lambda a, b: a | b, [low.contains(r["t"]) for r in terms], F.lit(False)))


def postings_of(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """The postings of a query's terms only, as ``postings(..., unicode=False)`` has them: a text is searched once for all of them, not cut into words."""
    terms = docs.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokenize("q", False))).alias("t")).collect()  # terms of a query
    words = "|".join(sorted((r["t"] for r in terms), key=len, reverse=True))  # letters, digits and hyphens
    pattern = f"(?<![a-z0-9-])(?:{words})(?![a-z0-9-])" if words else "(?!)"
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern), F.lit(0))
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(found)).alias("term"))


def inverted_index(posts: DataFrame, width: int = 1 << 16) -> DataFrame:
    """A1: (term, part) -> ordered list of documents, ``width`` ids a part: a frequent term has many bounded lists."""
    part = F.floor(F.col("doc") / width).cast("long").alias("part")
    return posts.groupBy("term", part).agg(F.array_sort(F.collect_list("doc")).alias("docs"))


def term_statistics(posts: DataFrame) -> DataFrame:
    """Document frequency by term."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def search(posts: DataFrame, query: str, unicode: bool = True) -> DataFrame:
    """score = number of query tokens (repeats count) that a document holds; M4 caps score / 10 at 1.

    The query's terms are a handful of literals, so the scan of the postings is
    filtered by them and the join broadcasts a table bounded by the query.
    """
    spark = posts.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(tokenize("q", unicode)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    hits = posts.join(F.broadcast(terms), "term")
    return hits.groupBy("doc").agg(F.sum("n").cast("double").alias("raw")).withColumn("score", F.least(F.col("raw") / 10, F.lit(1.0)))


def search_idf(posts: DataFrame, query: str, n_docs: int, unicode: bool = True) -> DataFrame:
    """Q1's separate function: the same with a real inverse document frequency."""
    spark = posts.sparkSession
    terms = spark.createDataFrame([(query,)], "q string").select(F.explode(tokenize("q", unicode)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    hits = cut(posts.join(F.broadcast(terms), "term"))  # read twice
    idf = hits.groupBy("term").agg(F.log(F.lit(float(n_docs)) / F.count(F.lit(1))).alias("idf"))
    return hits.join(F.broadcast(idf), "term").groupBy("doc").agg(F.sum(F.col("n") * F.col("idf")).alias("score"))  # a row per query term


def top(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k by a total order."""
    return frame.orderBy(*order).limit(k)


def federate(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the sources' results; missing columns become null, each row names its source."""
    marked = [df.withColumn("source", F.lit(name)) for name, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def survivors(papers: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """A3: one row per key; best score, first filled field in order, first non-zero citation count.  Rows without a key stay alone."""
    rank = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(filled(c).isNotNull(), rank)).alias(c)
    keyed = papers.withColumn("_key", F.coalesce(key, F.concat(F.lit("row:"), F.to_json(F.struct(*order)))))
    aggregates = [F.max("score").alias("score")]
    for name, kind in papers.dtypes:
        if name == "score":
            continue
        if kind == "string":
            aggregates.append(first(name))
        elif name == "citation_count":
            aggregates.append(F.min_by(name, F.when(F.col(name) != 0, rank)).alias(name))
        else:
            aggregates.append(F.min_by(name, F.when(F.col(name).isNotNull(), rank)).alias(name))
    return keyed.groupBy("_key").agg(*aggregates).drop("_key").select(*papers.columns)


def dedupe_by_doi(papers: DataFrame, order: list[Column]) -> DataFrame:
    """E1, first stage: papers with the same normalised DOI merge; the others stay."""
    return survivors(papers, normalize_doi("doi"), order)


def available_sources(parts: dict[str, DataFrame | None], always: tuple[str, ...] = ("arxiv", "semantic_scholar")) -> list[str]:
    """Names of the sources that can be asked: those that always can, then those that are there."""
    return [*always, *[name for name in sorted(parts) if name not in always and parts[name] is not None]]


def federated_search(parts: dict[str, DataFrame], order: str, top_k: int = 30, failures: DataFrame | None = None, breaker: int = 3, similar: float = 0.9) -> DataFrame:
    """Results of all sources (title, doi, score, ... and an ``order`` column), merged by DOI and title, best first.

    failures (source, streak): sources with ``breaker`` or more failures in a row are left out.
    """
    from .resolve import dedupe_papers

    rows = federate(parts)
    if failures is not None:
        rows = rows.join(failures.where(F.col("streak") >= breaker).select("source"), "source", "left_anti")
    rows = rows.withColumnRenamed(order, "ord")
    into = dedupe_papers(rows, least=similar).where("id <> into").toDF("_id", "_into")
    named = rows.join(into, F.col("ord") == F.col("_id"), "left").withColumn("_group", F.coalesce("_into", "ord")).drop("_id", "_into")
    merged = survivors(named, F.col("_group").cast("string"), [F.col("ord")]).drop("_group")
    return top(merged, top_k, F.col("score").desc(), F.col("ord"))


def smart_query(title: Column | str, abstract: Column | str | None = None) -> Column:
    """What a search for a question or a paper asks for: the start of the title, its materials and properties."""
    from ..functions.entities import document_entities, formulas

    whole = F.concat_ws(". ", title, abstract) if abstract is not None else F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    start = F.left(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")), F.lit(100))
    return F.concat_ws(" ", start, F.get(formulas(whole), F.lit(0))["name"], F.get(document_entities(whole, "properties"), F.lit(0)))
