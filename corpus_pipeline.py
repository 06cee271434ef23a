"""The corpus pipeline: quality, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before it kept; all but the last return the columns of ``documents``.

Edge cases: a null or empty text fails the quality rules, so its row goes; rows
with a null id are judged, kept and encoded like others (they are never near
copies); rows that repeat an id are judged together by stages 1, 2 and 4 and stay
or go together; an empty table gives empty results; extra columns are carried to
the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from siltstone.llm.common import discard, read_table, release, written


#: Bytes of input for each file that a filtering stage writes.
FILE_BYTES = 16 << 20


def in_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` in parts of a useful size, by the size of the files behind ``before``; at least one for each core.

    A stage that keeps most of its rows would otherwise write one file per
    shuffle partition, however small.
    """
    size = int(str(before._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return after.coalesce(min(1 << 30, max(before.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality rules reject go."""
    return in_files(docs, quality_rules.keep_good(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of equal texts stays."""
    return in_files(docs, exact_dedup.drop_exact_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 at its wide reach: of documents linked by five-word shingles at a similarity of 0.8 or more one stays."""
    return in_files(docs, simhash.drop_near_copies(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents by their fitted rates; poor and toxic text is cut to its share."""
    return in_files(docs, mixing.mix_sources(docs, read_table(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document that is left."""
    return bpe.encode_texts(docs, bpe.load_vocabulary(bpe.public_vocabulary()), carry=("lang", "source"), with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Expectation-maximisation, classifier and components have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        release()
        if last:  # the table of the stage before has been read
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
