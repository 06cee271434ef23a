"""Passages, records, and an index that a stream keeps up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index_store, passages, retrieval
from .registry import Tables, query
from .stream_queries import fresh_folder
from .text_queries import POSTS

LINES = "c AS (SELECT doc_id, unnest(range(len(l))) AS chunk, unnest(list_transform(l, lambda x: regexp_extract_all(lower(x), '[a-z0-9]+'))) AS w FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@query(f"""WITH {LINES}, q AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z0-9]+')[1:4] AS phrase FROM benchmark),
p AS (SELECT doc_id, chunk, w, unnest(list_transform(range(1, greatest(len(w) - 2, 1)), lambda i: w[i:i+3])) AS phrase FROM c)
SELECT query, doc_id AS doc, chunk, count(*) AS hits, len(list_intersect(w, phrase)) AS shared, round(least(count(*), 2) * 0.5 + len(list_intersect(w, phrase)) / len(list_distinct(w)), 6)::DOUBLE AS score
FROM p JOIN q USING (phrase) WHERE len(phrase) = 4 GROUP BY query, doc_id, chunk, w, phrase""")
def passage_search(t: Tables) -> DataFrame:
    """Lines of documents that hold the first four words of a benchmark text."""
    queries = t.benchmark.select(F.col("item_id").alias("query"), F.slice(passages.words_of("text"), 1, 4).alias("words")).where(F.size("words") == 4)
    found = passages.search(passages.passages(t.documents, "doc_id", "text"), queries)
    return found.select("query", "doc", "chunk", "hits", "shared", F.round("score", 6).alias("score"))


@query("""SELECT item_id, name, price FROM items WHERE size BETWEEN 10 AND 30 AND list_has_all(regexp_extract_all(lower(concat_ws(' ', name, brand, kind)), '[a-z0-9]+'), ['home', 'small'])""")
def metadata_search(t: Tables) -> DataFrame:
    """Small things for the home by their fields, with a size in a range."""
    return passages.metadata_search(t.items, ["name", "brand", "kind"], "small home", "size", 10, 30).select("item_id", "name", "price")


@query(f"SELECT term, count(*) AS df FROM ({POSTS}) GROUP BY term")
def index_refreshed(t: Tables) -> DataFrame:
    """An index of older versions of most documents; a stream brings the rest and all changes; the same as one built anew."""
    top = fresh_folder(t)
    older = t.documents.where("doc_id % 10 <> 0").withColumn("text", F.left("text", (F.length("text") / 2).cast("int")))
    index_store.write_segment(older, "doc_id", "text", f"{top}/index", 0, unicode=False)
    changed = t.documents.select("doc_id", "text")
    changed.repartition(3, "doc_id").write.parquet(f"{top}/in")
    stream = t.spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    index_store.refreshed_by(stream, "doc_id", "text", f"{top}/index", f"{top}/state", unicode=False).awaitTermination()
    return retrieval.term_statistics(index_store.read_index(t.spark, f"{top}/index"))
