"""Joins whose result is quadratic: every pair once, and no key in a single task."""

from pyspark.sql import functions as F

from siltstone.operators import graph, windows


def test_ranges_of_one_key_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_ROWS", 16, raising=False)
    monkeypatch.setattr(windows, "TASK_PAIRS", 512, raising=False)
    rows = spark.range(240).select(F.lit("k").alias("key"), "id", (F.col("id") % 9).alias("lo"), (F.col("id") % 9 + F.col("id") % 5).alias("hi"))
    rows = rows.unionByName(rows.where("id < 6")).unionByName(rows.where("id = 1").withColumn("key", F.lit(None).cast("string")))
    left, right = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    got = windows.overlaps(left, right, ["key"], 4.0).select("id", "id_r", F.spark_partition_id().alias("task")).collect()
    a, b = ([r for r in d.collect() if r["key"]] for d in (left, right))
    want = sorted((x["id"], y["id"]) for x in a for y in b if x["lo"] <= y["hi"] and y["lo"] <= x["hi"])
    assert sorted((r["id"], r["id_r"]) for r in got) == want
    assert len({r["task"] for r in got}) > 4


def test_gaps_of_one_structure_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_PROPS", 8, raising=False)
    monkeypatch.setattr(graph, "TASK_PAIRS", 64, raising=False)
    members = [(e, "s") for e in range(60)] + [(1, "t"), (90, "t"), (91, None), (None, "s")]
    known = [(e, p) for e in range(60) for p in range(50) if (e * 7 + p) % 11 == 0] + [(90, 3), (90, 777), (2, None)]
    frames = [spark.createDataFrame(r, t) for r, t in ((members, "e long, s string"), (known, "e long, p long"))]
    asked = spark.createDataFrame([(e,) for e in (*range(0, 60, 2), 1, 90, 91)], "e long")
    got = graph.unexplored_pairs(*frames, "e", "s", "p", asked=asked).withColumn("task", F.spark_partition_id()).collect()
    of = {}
    for e, s in members:
        of.setdefault(s, set()).update(p for k, p in known if k == e)
    want = {(e, p) for e, s in members if s and e in {*range(0, 60, 2), 1, 90} for p in of[s]} - set(known)
    assert sorted(((r["e"], r["p"]) for r in got), key=str) == sorted(want, key=str)
    assert len({r["task"] for r in got}) > 4
