"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: As a character class for Java and RE2 patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Inside a lambda Catalyst may inline a column that is named once in the text
    but evaluated once per array element; a bound lambda variable is evaluated
    exactly once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def strip_spaces(text: Column) -> Column:
    """Delete every ASCII white-space character; byte searches take a third of translate()'s time."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join whose two sides are always shuffled by Spark itself.

    An aggregate that feeds a join on its own keys is not shuffled again, and
    then adaptive execution can't split a hot key.  A derived bucket among the
    join keys makes both sides need a shuffle of their own, so the skew-join
    rule splits the left side of a hot key over many tasks.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1 << 20))
    name = "_bucket"
    return left.withColumn(name, bucket).join(right.withColumn(name, bucket), [name, *keys], how).drop(name)


#: Rows up to which the small side of a join may be broadcast, once counted.
BROADCAST_ROWS = 100_000


def marked_join(left: DataFrame, few: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """Left join with a table of ``rows`` narrow rows: broadcast up to BROADCAST_ROWS, else both sides are shuffled."""
    return left.join(F.broadcast(few), keys, "left") if rows <= BROADCAST_ROWS else spread_join(left, few, keys, "left")


def rows_named(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``ids`` (one column, distinct): broadcast up to BROADCAST_ROWS of them, else both sides are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:  # only where the session has none, as in tests
        top = os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_checkpoints")
    return f"{top.rstrip('/')}/siltstone-{uuid.uuid4().hex}"


def only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is in the one column of ``ids`` (null matches null), with all their columns, whatever their names."""
    name = f"_only_{uuid.uuid4().hex}"
    return docs.join(ids.toDF(name), docs[id_col].eqNullSafe(F.col(name)), "left_semi")


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a narrow table that is read more than once; a lost executor's part is computed again.

    Disk takes what memory can't hold.  :func:`release` drops all of them.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Drop what :func:`keep` holds, once the results that read it are written."""
    while _kept:
        _kept.pop().unpersist()


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage by a table in the shared folder, which survives lost executors; and where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written` that nothing reads any more, with its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
