"""Operator 12, target-distribution importance resampling: position-table n-grams.

Words are laid out in a table of positions (``posexplode``); for runs longer than
a word, window ``lead`` over a document's positions brings up the words that
follow, and each order's run is their concatenation.  Runs are hashed into
buckets, counted over the corpus and over the target texts, and the logarithm of
the two shares is a bucket's gain.  Joining gains to the table and averaging by
document gives its weight; weight plus Gumbel noise drawn from a hash of the id
is its score, and the highest scores are a sample without replacement.

Counts and sums are combined before they are shuffled: a row for each bucket and
task, or for each document.  The table of gains has as many rows as there are
buckets, a parameter, and is broadcast.  Runs of one word need no window, so
words are not shuffled; longer ones are shuffled once, by document.

Edge cases: a null or empty text has no features, weight 0 and is not drawn; a
null id counts as the empty string in the noise and comes first among equal
scores; rows that repeat an id are scored and drawn each by itself; texts made
of one long word are one feature; an empty table gives an empty result, an empty
target leaves only the corpus's shares; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clustered_layout import CRC32_SQL
from .common import read_table
from .ordering import positions

#: Fixed value: what parts words, once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 2024, 10, 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; in plain ASCII the built-in function says the same, sooner."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def position_table(texts: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """A row for each word, with its position; a text without words has one row whose word is null."""
    split = F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), GAPS)
    table = texts.select(*carry, F.posexplode(split).alias("pos", "_word"))
    return table.select(*carry, "pos", F.when(F.col("_word") != "", F.col("_word")).alias("word"))  # gaps at either end leave an empty word


def run_buckets(table: DataFrame, key: list[str], max_order: int, buckets: int) -> DataFrame:
    """A row for each run of 1 to ``max_order`` words: key, whether it is a word itself, bucket (null: no run)."""
    if max_order == 1:
        return table.select(*key, F.col("word").isNotNull().alias("is_word"), (F.crc32("word") % buckets).alias("bucket"))
    follow = W.partitionBy(*key).orderBy("pos")
    for k in range(1, max_order):
        table = table.withColumn(f"_next{k}", F.lead("word", k).over(follow))
    runs = [F.col("word"), *[F.concat(*[x for j in range(k + 1) for x in ([F.lit(" ")] if j else []) + [F.col(f"_next{j}") if j else F.col("word")]]) for k in range(1, max_order)]]
    orders = F.array(*[F.struct(F.lit(k).alias("order"), r.alias("run")) for k, r in enumerate(runs)])
    each = table.select(*key, F.explode(orders).alias("r"))
    return each.select(*key, ((F.col("r.order") == 0) & F.col("r.run").isNotNull()).alias("is_word"), (F.crc32("r.run") % buckets).alias("bucket"))


def bucket_counts(texts: DataFrame, text_col: str, max_order: int, buckets: int, name: str) -> DataFrame:
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    runs = run_buckets(position_table(rows, "_text", ["_row"]), ["_row"], max_order, buckets)
    return runs.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", max_order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket of the documents: thousandths of the logarithm of the target's share over the corpus's, each count raised by one."""
    here = bucket_counts(docs, text_col, max_order, buckets, "s")
    there = bucket_counts(target, text_col, max_order, buckets, "t")
    both = here.join(there, "bucket", "full").select("bucket", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in "st"])
    whole = W.partitionBy(F.lit(0))  # at most as many rows as buckets
    counts = both.withColumn("all_s", F.sum("s").over(whole)).withColumn("all_t", F.sum("t").over(whole))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def document_weights(docs: DataFrame, gains: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_order: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the floored mean of its features' gains."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    key = ["_row", "doc_id"]
    runs = run_buckets(position_table(rows, "_text", key), key, max_order, buckets)
    summed = runs.join(F.broadcast(gains), "bucket", "left").groupBy(*key).agg(
        F.count_if("is_word").alias("n_words"), F.count("bucket").alias("n_features"), F.sum("gain").alias("_sum")
    )
    return summed.select("doc_id", "n_words", "n_features", F.coalesce(F.floor(F.col("_sum") / F.col("n_features")), F.lit(0)).cast("long").alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_order: int = 1, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least_words: int = LEAST_WORDS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row; rank is null where a document is not drawn.

    ``share`` of a hundred documents with ``least_words`` words or more are drawn.
    """
    weights = document_weights(docs, bucket_gains(docs, target, text_col, max_order, buckets), id_col, text_col, max_order, buckets)
    scored = weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_may", F.col("n_words") >= least_words)
    placed = positions(scored, [F.col("_may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    drawn = placed.where("_may").count() * share // 100
    rank = F.when(F.col("_may") & (F.col("position") < drawn), F.col("position") + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), k AS (
  SELECT word, {CRC32_SQL.format(bytes="list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::INT)")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w)
), b AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN k USING (word) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM b
), d AS (
  SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY id
), e AS (
  SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(documents.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN d USING (doc_id)
), f AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM e
), p AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM f
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank, n_features AS n_words FROM p
"""
