"""Event logs as streams: windows, dedupe, durations, state machines, breakers, notices.

Every function maps a streaming DataFrame to a streaming DataFrame and works on
a batch one as well where Spark allows it; the sink and its checkpoint folder
are the caller's (K15, X5: resume comes from ``checkpointLocation``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: allowed transitions.
TRANSITIONS = {
    "idle": ["running"], "running": ["tool_executing", "paused", "done", "error"], "tool_executing": ["running", "error"], "paused": ["running", "done"], "error": ["running", "done"], "done": [],
}


def read_log(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines appended to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The events table as a stream; the zone-less time is cast, for watermarks need a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by hour and type; state older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduped(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def durations(starts: DataFrame, ends: DataFrame, key: str, longest: str = "1 hour") -> DataFrame:
    """Start and end events paired by their call id, within ``longest``."""
    a = starts.select(F.col(key), F.col("ts").alias("started")).withWatermark("started", longest)
    b = ends.select(F.col(key).alias("_key"), F.col("ts").alias("ended")).withWatermark("ended", longest)
    joined = a.join(b, F.expr(f"{key} = _key and ended >= started and ended <= started + interval {longest}"))
    return joined.select(key, "started", "ended", (F.col("ended").cast("double") - F.col("started").cast("double")).alias("seconds"))


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = [f for f in frames if len(f)]
    return pd.concat(rows).sort_values(["ts", "event_id"], kind="stable") if rows else pd.DataFrame()


def state_machine(events: DataFrame, key: str = "user_id", target: str = "event_type") -> DataFrame:
    """Each event asks for a state; transitions that are not allowed are rejected and leave the state as it is."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "idle"
        out = []
        for r in _ordered(frames).itertuples():
            want = getattr(r, target)
            ok = want in TRANSITIONS.get(now, [])
            out.append((k[0], r.event_id, now, want, ok))
            now = want if ok else now
        state.update((now,))
        yield pd.DataFrame(out, columns=["run", "event_id", "before", "wanted", "accepted"])

    schema = "run long, event_id long, before string, wanted string, accepted boolean"
    return events.groupBy(key).applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def accrued(events: DataFrame, key: str = "user_id", pause: int = 3600) -> DataFrame:
    """Microseconds of activity per key so far: gaps between its events of ``pause`` seconds or less.

    The last event's time and the sum are state, so a run that stops and starts
    again on its checkpoint goes on where it was.  Each batch gives a row for
    every key it met; events of a later batch must not be earlier.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, n = state.get if state.exists else (None, 0, 0)
        times = _ordered(frames)["ts"].astype("datetime64[us]").astype("int64").tolist()
        for t in times:
            if last is not None and 0 <= t - last <= pause * 1_000_000:
                total += t - last
            last = t
        n += len(times)
        state.update((last, total, n))
        yield pd.DataFrame([(k[0], total, n)], columns=["run", "active", "n"])

    return events.where("ts IS NOT NULL").groupBy(key).applyInPandasWithState(step, "run long, active long, n long", "last long, total long, n long", "update", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, key: str = "user_id", limit: int = 3) -> DataFrame:
    """A row when a key reaches ``limit`` failures in a row; a success resets it."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for r in _ordered(frames).itertuples():
            n = n + 1 if r.event_type == "error" else 0
            if n == limit:
                out.append((k[0], r.event_id, n))
        state.update((n,))
        yield pd.DataFrame(out, columns=["source", "event_id", "failures"])

    return events.groupBy(key).applyInPandasWithState(step, "source long, event_id long, failures int", "failures int", "append", GroupStateTimeout.NoTimeout)


def budget_notices(events: DataFrame, key: str = "user_id", limits: tuple[int, ...] = (50, 25, 10)) -> DataFrame:
    """One notice per limit, at the first event whose remaining share (value, in per cent) falls below it."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = list(state.get[0]) if state.exists else []
        out = []
        for r in _ordered(frames).itertuples():
            for x in limits:
                if r.value < x and x not in told:
                    told.append(x)
                    out.append((k[0], r.event_id, x))
        state.update((told,))
        yield pd.DataFrame(out, columns=["run", "event_id", "below"])

    return events.groupBy(key).applyInPandasWithState(step, "run long, event_id long, below int", "told array<int>", "append", GroupStateTimeout.NoTimeout)


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """A foreachBatch sink that appends rows whose key is not in the table yet."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates(keys)
    try:
        known = spark.read.schema(batch.schema).parquet(path).select(*keys)
        rows = rows.join(known, keys, "left_anti")
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)
