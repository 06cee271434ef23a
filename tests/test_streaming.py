"""Event logs as streams against their batch forms."""

from datetime import datetime, timedelta

from siltstone.streaming import logs

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def run(spark, tmp_path, plan, mode="append", batches=2):
    start = datetime(2024, 1, 1)
    kinds = ["running", "error", "error", "error", "done", "running", "done"]
    rows = [(i, start + timedelta(minutes=20 * i), i % 2, kinds[(i // 2) % 7], float(100 - 5 * i)) for i in range(20)]
    for b in range(batches):
        part = rows[b * len(rows) // batches : (b + 1) * len(rows) // batches]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = plan(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect(), rows


def test_hourly(spark, tmp_path):
    got, rows = run(spark, tmp_path, lambda s: logs.hourly(s, "100 days"), mode="update")
    last = {(r["start"], r["event_type"]): r["n"] for r in got}
    assert sum(last.values()) == len(rows)


def test_breaker_and_notices(spark, tmp_path):
    got, _ = run(spark, tmp_path, logs.breaker, batches=1)
    assert sorted((r["source"], r["failures"]) for r in got) == [(0, 3), (1, 3)]
    spark.catalog.dropTempView("out")
    got, _ = run(spark, tmp_path / "b", logs.budget_notices, batches=1)
    assert sorted((r["run"], r["below"]) for r in got) == [(0, 25), (0, 50), (1, 10), (1, 25), (1, 50)]


def test_state_machine(spark, tmp_path):
    got, _ = run(spark, tmp_path, logs.state_machine, batches=1)
    mine = [(r["before"], r["wanted"], r["accepted"]) for r in sorted(got, key=lambda r: r["event_id"]) if r["run"] == 0]
    assert mine[:5] == [("idle", "running", True), ("running", "error", True), ("error", "error", False), ("error", "error", False), ("error", "done", True)]


def test_dedupe_and_sink(spark, tmp_path):
    got, rows = run(spark, tmp_path, lambda s: logs.deduped(s, ["user_id", "event_type"], "100 days"))
    assert len(got) == len({(r[2], r[3]) for r in rows})
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        logs.append_new(frame, str(tmp_path / "sink"), ["k"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
