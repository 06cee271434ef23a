"""An index that is kept up to date: segments of postings, each document counted by its latest.

A refresh writes a segment of its own postings and the ids it speaks for;
nothing written before is touched, so a refresh costs what it brings and a
repeated one overwrites itself.  Readers join postings with each document's
latest segment; :func:`compacted` folds segments into one when there are many.
Postings lie in buckets by term, so that a lookup reads its terms' buckets only.

Edge cases: a document without terms, or with a null text, replaces its older
postings by none; an id that a segment repeats has the terms of all its rows; a
null id is left out; an empty refresh changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .retrieval import postings

BUCKETS = 64
POSTS, IDS = "term string, doc long, bucket int, segment long", "doc long, segment long"


def bucket_of(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_segment(docs: DataFrame, id_col: str, text_col: str, path: str, segment: int, unicode: bool = True, buckets: int = BUCKETS) -> None:
    """The postings of ``docs`` as segment ``segment`` of the index at ``path``."""
    rows = docs.where(F.col(id_col).isNotNull())
    posts = postings(rows, id_col, text_col, unicode).select("term", F.col("doc").cast("long").alias("doc")).distinct().withColumn("bucket", bucket_of("term", buckets))
    # Dealt by bucket, and by document within it: few files a bucket, and none of a frequent term's is large.
    posts.repartition("bucket", F.pmod("doc", F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/posts/segment={segment}")
    rows.select(F.col(id_col).cast("long").alias("doc")).distinct().write.mode("overwrite").parquet(f"{path}/ids/segment={segment}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc, bucket): the postings of every document's latest segment."""
    ids = spark.read.schema(IDS).parquet(f"{path}/ids")
    latest = ids.groupBy("doc").agg(F.max("segment").alias("segment"))
    return spark.read.schema(POSTS).parquet(f"{path}/posts").join(latest, ["doc", "segment"]).select("term", "doc", "bucket")


def lookup(spark: SparkSession, path: str, query: str, unicode: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """The postings of a query's terms; only their buckets are read."""
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(tokenize("q", unicode))).alias("t"))
    found = words.select("t", bucket_of("t", buckets).alias("b")).collect()  # the words of a query
    return read_index(spark, path).where(F.col("bucket").isin([r["b"] for r in found]) & F.col("term").isin([r["t"] for r in found]))


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """The index at ``path`` as a single segment at ``target``."""
    read_index(spark, path).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/posts/segment=0")
    spark.read.schema(IDS).parquet(f"{path}/ids").select("doc").distinct().write.mode("overwrite").parquet(f"{target}/ids/segment=0")


def refreshed_by(stream: DataFrame, id_col: str, text_col: str, path: str, state: str, unicode: bool = True):
    """A stream of new and changed documents into the index; a batch that is run again writes the same segment."""

    def save(batch: DataFrame, number: int) -> None:
        write_segment(batch, id_col, text_col, path, number + 1, unicode)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start()


def checked(index: DataFrame) -> DataFrame:
    """One row: posts, terms, docs, broken (a null or empty term, a null document), repeated."""
    broken = F.col("term").isNull() | (F.col("term") == "") | F.col("doc").isNull()
    by_pair = index.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("n"))
    return by_pair.agg(F.sum("n").alias("posts"), F.countDistinct("term").alias("terms"), F.countDistinct("doc").alias("docs"), F.coalesce(F.sum(F.when(broken, F.col("n"))), F.lit(0)).alias("broken"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def install(spark: SparkSession, source: str, path: str) -> None:
    """A ready-made table of postings (term, doc) becomes the index at ``path``, if it is sound."""
    given = spark.read.parquet(source)
    if not {"term", "doc"} <= set(given.columns):
        raise ValueError(f"an index has columns term and doc, not {given.columns}")
    told = checked(given).first()
    if told["broken"] or told["repeated"]:
        raise ValueError(f"{told['broken']} broken and {told['repeated']} repeated postings")
    given.select("term", F.col("doc").cast("long").alias("doc"), bucket_of("term").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/posts/segment=0")
    given.select(F.col("doc").cast("long").alias("doc")).distinct().write.mode("overwrite").parquet(f"{path}/ids/segment=0")
