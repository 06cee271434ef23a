"""Searching rendered texts is dealt over tasks, however few bytes their table has."""

import pytest
from pyspark.sql import functions as F

from siltstone import plans


@pytest.mark.parametrize("name", ["stated_values", "stated_claims", "stated_evidence"])
def test_texts_are_searched_in_many_tasks(spark, name):
    rows = plans.QUERIES[name](spark, "/root/testdata/sf0.001").withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() == 4
