"""Streaming operators run to the end of what is there (availableNow), so that their result is a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..streaming import logs
from .registry import Tables, query


def fresh_folder(t: Tables) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_folder(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", top: str | None = None) -> DataFrame:
    """What a stream has written once its input is used up.  The sink and the stream's own checkpoint lie in the shared folder; a second run on the same one goes on where the first ended."""
    spark = stream.sparkSession
    top = top or f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{top}/out")

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/out")


def _events(t: Tables) -> DataFrame:
    # A glob: the stream source wants a folder or a pattern, and the table may be one file.
    return logs.read_events(t.spark, f"{t.folder}/events.parq*", t.events.schema)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly(t: Tables) -> DataFrame:
    """Hourly counts of the event stream; of each window the last update counts."""
    rows = drained(logs.hourly(_events(t), "60 days"), "update")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


@query("SELECT user_id, event_type, 1 AS n FROM events GROUP BY 1, 2")
def stream_dedupe(t: Tables) -> DataFrame:
    """One event per user and type."""
    rows = drained(logs.deduped(_events(t), ["user_id", "event_type"], "60 days"))
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
s AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak, event_type FROM i)
SELECT user_id AS source, event_id FROM s WHERE streak = 2 AND event_type = 'error'""")
def stream_breaker(t: Tables) -> DataFrame:
    """Events at which a user's errors in a row reach two."""
    return drained(logs.breaker(_events(t), limit=2)).select("source", "event_id")


@query("SELECT user_id AS run, CASE WHEN b = 1 THEN 50 WHEN b = 2 THEN 25 ELSE 10 END AS below FROM (SELECT user_id, unnest([1, 2, 3]) AS b, min(value) AS lo FROM events GROUP BY user_id) WHERE (b = 1 AND lo < 50) OR (b = 2 AND lo < 25) OR (b = 3 AND lo < 10)")
def stream_notices(t: Tables) -> DataFrame:
    """Which limits each user's values fall below."""
    return drained(logs.budget_notices(_events(t))).select("run", "below")


@query("""SELECT l.sale_id, s.sold_at AS started, l.shipped_at AS ended, (epoch_us(l.shipped_at) - epoch_us(s.sold_at))::DOUBLE / 1000000 AS seconds
FROM sales s JOIN sale_lines l ON s.sale_id = l.sale_id AND l.shipped_at >= s.sold_at AND l.shipped_at <= s.sold_at + INTERVAL 20 DAY""")
def stream_durations(t: Tables) -> DataFrame:
    """Every sale with the shipping of its lines, 20 days later at most: a join of two streams, whose state the watermarks bound."""
    sales = t.spark.readStream.schema(t.sales.schema).parquet(f"{t.folder}/sales.parq*").withColumn("ts", F.col("sold_at").cast("timestamp"))
    lines = t.spark.readStream.schema(t.sale_lines.schema).parquet(f"{t.folder}/sale_lines.parq*").withColumn("ts", F.col("shipped_at").cast("timestamp"))
    rows = drained(logs.durations(sales, lines, "sale_id", "20 days"))
    return rows.select("sale_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "seconds")


#: What an event asks for, as a state.
WANTED = {"view": "running", "click": "tool_executing", "signup": "paused", "error": "error", "purchase": "done"}


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS run, event_id, map_extract(MAP {WANTED}, event_type)[1] AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT run, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, NULL::VARCHAR AS wanted, false AS accepted, 'idle' AS now FROM (SELECT DISTINCT run FROM e)
UNION ALL SELECT e.run, e.k, e.event_id, s.now, e.wanted, list_contains(map_extract(MAP {logs.TRANSITIONS}, s.now)[1], e.wanted), CASE WHEN list_contains(map_extract(MAP {logs.TRANSITIONS}, s.now)[1], e.wanted) THEN e.wanted ELSE s.now END
FROM s JOIN e ON e.run = s.run AND e.k = s.k + 1)
SELECT run, event_id, before, wanted, accepted FROM s WHERE k > 0""")
def stream_states(t: Tables) -> DataFrame:
    """Every event as a wish for a state; wishes that the state they find does not allow are rejected."""
    kind = F.col("event_type")
    wanted = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in WANTED.items()])
    return drained(logs.state_machine(_events(t).withColumn("wanted", wanted), target="wanted")).select("run", "event_id", "before", "wanted", "accepted")


@query("""SELECT user_id AS run, sum(CASE WHEN gap <= 21600000000 THEN gap ELSE 0 END)::BIGINT AS active, count(*) AS n
FROM (SELECT user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS gap FROM events WHERE ts IS NOT NULL) GROUP BY 1""")
def stream_resumed(t: Tables) -> DataFrame:
    """Activity per user; the stream sees the earlier part of the log, ends, and a second one goes on from its checkpoint with the rest."""
    source = f"{fresh_folder(t)}/in"
    middle = t.events.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).cast("timestamp_ntz").alias("at")).first()["at"]
    rows, top = None, fresh_folder(t)
    for early in (True, False):
        part = t.events.where((F.col("ts") < F.lit(middle)) == early) if middle is not None else t.events.where(F.lit(early))
        part.write.mode("append").parquet(source)
        rows = drained(logs.accrued(logs.read_events(t.spark, source, t.events.schema), pause=6 * 3600), "update", top)
    last = rows.groupBy("run").agg(F.max_by(F.struct("active", "n"), "_batch").alias("r"))
    return last.select("run", "r.active", "r.n")
