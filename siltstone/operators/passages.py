"""Passages (lines of documents) searched by phrases and words, and records by their fields.

A phrase is looked up by its rarest word: only the places of that word meet the
phrase, and the words around each place are compared.  A frequent word is no hot
key unless all words of a phrase are frequent, and then its places are split by
adaptive execution like any join's.

Edge cases: null and empty texts have no passages; a passage shorter than the
phrase has no match; phrases without words match nothing; overlapping matches
all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import capped, first_wins

WORD = r"[a-z0-9]+"


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, chunk, words of every line that has a word."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("chunk", "line"))
    return lines.select("doc", "chunk", words_of("line").alias("words"))


def phrase_places(parts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Query, doc, chunk, at: every place where the words of a phrase (query, words) stand in a row."""
    wanted = phrases.select("query", F.col("words").alias("phrase"), F.posexplode("words").alias("offset", "word"))
    places = parts.select("doc", "chunk", F.posexplode("words").alias("pos", "word"))
    frequency = places.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = first_wins(wanted.join(frequency, "word"), ["query"], [F.col("df"), F.col("offset")]).select("query", "phrase", "offset", "word")
    # A phrase with a word that no passage has was joined by its other words; the comparison below rejects it.
    # Merge joins: exploded words look small to the estimate, which goes by compressed files, and are not.
    met = places.hint("merge").join(rarest, "word").withColumn("at", F.col("pos") - F.col("offset")).where("at >= 0")
    met = met.join(parts.hint("merge"), ["doc", "chunk"])
    same = F.slice("words", F.col("at") + 1, F.size("phrase")) == F.col("phrase")
    return met.where(same).select("query", "doc", "chunk", "at")


def search(parts: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """Query, doc, chunk, hits, shared, score of the passages that hold a query's phrase, best first, ``most`` a query.

    score: a half for each match of the phrase up to two, and the share of the
    passage's distinct words that the query names.
    """
    hits = phrase_places(parts, queries).groupBy("query", "doc", "chunk").agg(F.count(F.lit(1)).alias("hits"))
    rows = hits.join(parts.hint("merge"), ["doc", "chunk"]).join(queries.withColumnRenamed("words", "phrase"), "query")
    shared = F.size(F.array_intersect("words", "phrase"))
    scored = rows.select("query", "doc", "chunk", "hits", shared.alias("shared"), (F.least("hits", F.lit(2)) * 0.5 + shared / F.size(F.array_distinct("words"))).alias("score"))
    return capped(scored, ["query"], [F.col("score").desc(), F.col("doc"), F.col("chunk")], most) if most else scored


def metadata_search(records: DataFrame, fields: list[str], text: str, number: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The records whose fields together hold every word of ``text``, with ``number`` in a range; filters reach the scan."""
    rows = records
    if low is not None:
        rows = rows.where(F.col(number) >= low)
    if high is not None:
        rows = rows.where(F.col(number) <= high)
    held = words_of(F.concat_ws(" ", *fields))
    wanted = sorted({w for w in text.lower().split() if w})
    return rows.where(F.forall(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda w: F.array_contains(held, w)))
