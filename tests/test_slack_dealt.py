"""The rounds of a slack fit are dealt by the rows they make."""

from pyspark.sql import functions as F

from siltstone.operators import resampling


def test_rounds_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "TASK_ROWS", 1000, raising=False)
    plain, tasks = resampling._slack_errors, []

    def spied(*a):
        out = plain(*a)
        tasks.append(out.select(F.spark_partition_id().alias("p")).distinct().count())
        return out

    monkeypatch.setattr(resampling, "_slack_errors", spied)
    rows = spark.range(240).select((F.col("id") % 40).alias("g"), (F.col("id") + 1.0).alias("t"), (F.col("id") % 7 + 1.0).alias("e"))
    assert resampling.slack_fit(rows, "g", "t", "e", rounds=1).count() == 40
    assert min(tasks) > 8
