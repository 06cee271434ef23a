"""Session settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own beside the warehouse only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"), "_checkpoints")
        sc.setCheckpointDir(top)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
