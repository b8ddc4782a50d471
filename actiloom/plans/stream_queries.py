"""Streams over the given tables: written batch by batch, followed, stopped, followed on.

Each query writes its tables in two batches, and the first of them again as a
crash would, follows them with the stream's own checkpoint between, and returns
what the stream has put out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import shape2
from ..sources.store import Store
from ..streaming import live, stateful
from . import mapping as M
from .catalog import query

c = M.with_ctes
NOW = dt.datetime(2024, 6, 1)


class _Sink:
    """Where a stream's rows go; ``follow`` takes what has come since and stops."""

    def __init__(self, stream: DataFrame, name: str) -> None:
        spark = stream.sparkSession
        self.stream, self.path, self.checkpoint = stream, scratch_path(spark, name), scratch_path(spark, f"{name}-positions")

    def follow(self) -> None:
        writer = self.stream.writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", self.path).option("checkpointLocation", self.checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def rows(self) -> DataFrame:
        return self.stream.sparkSession.read.schema(self.stream.schema).parquet(self.path)


def _stored(spark: SparkSession, name: str) -> Store:
    return Store(spark, scratch_path(spark, name))


def _as_table(store: Store, table: str, rows: DataFrame) -> DataFrame:
    """``rows`` in the types of a stored table; absent columns are null."""
    fields = store.schema(table).fields
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def _twice(sink: _Sink, store: Store, table: str, rows: DataFrame, first) -> DataFrame:
    """Follows the rows that are ``first``, then the rest beside the first ones written again."""
    store.append(table, rows.where(first), "b-0")
    sink.follow()
    store.append(table, rows.where(first), "b-0")
    store.append(table, rows.where(~first), "b-1")
    sink.follow()
    return sink.rows()


def _middle(rows: DataFrame, time: str = "valid_from"):
    """Rows up to the middle of the table's time; batches of a live table follow time."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    return F.col(time) <= F.lit(low + (high - low) / 2) if low is not None else F.lit(True)


@query("stream_event_tail", c("ev", "SELECT id, lifecycle_event, valid_from FROM ev WHERE agent = 1"))
def stream_event_tail(spark, sf):
    store = _stored(spark, "tail")
    store.create("telemetry_stream")
    rows = _as_table(store, "telemetry_stream", M.events(spark, sf))
    sink = _Sink(live.event_tail(store.stream("telemetry_stream"), "1"), "tail-rows")
    found = _twice(sink, store, "telemetry_stream", rows, _middle(rows))
    return found.select(F.col("id").cast("bigint").alias("id"), "lifecycle_event", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"))


@query("stream_conversation_tail", c("msg", "SELECT id, role, content FROM msg WHERE session = 7"))
def stream_conversation_tail(spark, sf):
    store = _stored(spark, "talk")
    store.create("message")
    rows = _as_table(store, "message", M.messages(spark, sf))
    sink = _Sink(live.conversation_tail(store.stream("message"), "7"), "talk-rows")
    found = _twice(sink, store, "message", rows, _middle(rows))
    return found.select(F.col("id").cast("bigint").alias("id"), "role", "content")


@query(
    "stream_merged_feed",
    c("msg ev", "SELECT 'message' AS kind, CAST(id AS VARCHAR) AS id FROM msg UNION ALL SELECT 'action', CAST(id AS VARCHAR) FROM ev"),
)
def stream_merged_feed(spark, sf):
    """Both tables with different times: the slower watermark keeps the rows of both."""
    store = _stored(spark, "feed")
    for table in ("message", "telemetry_stream"):
        store.create(table)
    messages = _as_table(store, "message", M.messages(spark, sf))
    events = _as_table(store, "telemetry_stream", M.events(spark, sf))
    sink = _Sink(live.merged_feed(store.stream("message"), store.stream("telemetry_stream")), "feed-rows")
    store.append("message", messages, "b-0")
    return _twice(sink, store, "telemetry_stream", events, _middle(events)).select("kind", "id")


@query(
    "stream_windows",
    c("ev", """, e AS (SELECT id, date_trunc('minute', valid_from) AS m, valid_from AS t FROM ev),
      p AS (SELECT min(t) + (max(t) - min(t)) / 2 AS half, max(t) FILTER (WHERE id % 10 <> 0) - INTERVAL 10 MINUTE AS mark FROM e)
      SELECT m AS start, count(*) AS value FROM e, p WHERE id % 10 <> 0 AND m + INTERVAL 1 MINUTE <= mark GROUP BY 1"""),
)
def stream_windows(spark, sf):
    """Every tenth event comes a batch late, behind the watermark: its window is final and stays as it was."""
    store = _stored(spark, "windows")
    store.create("telemetry_stream")
    rows = _as_table(store, "telemetry_stream", M.events(spark, sf))
    counts = live.windowed_counts(store.stream("telemetry_stream")).select("start", "value")
    sink = _Sink(counts, "window-rows")
    on_time = F.col("id").cast("bigint") % 10 != 0
    newest = rows.where(on_time).agg(F.max("valid_from")).first()[0]
    store.append("telemetry_stream", rows.where(on_time), "b-0")
    sink.follow()
    # The newest late events would still be in time, and move the watermark.
    late = F.col("valid_from") < F.lit(newest) - F.expr("interval 11 minutes")
    store.append("telemetry_stream", rows.where(~on_time & late), "b-1")
    sink.follow()
    return sink.rows().select(F.col("start").cast("timestamp_ntz").alias("start"), "value")


@query(
    "stream_grown_records",
    """WITH e AS (SELECT user_id % 20 AS file, event_id AS pos, value, length(event_type) AS chars, event_id % 2 AS odd FROM events),
      l AS (SELECT file, value, odd, max(pos) AS pos, arg_max(chars, pos) AS chars, max(chars) AS most FROM e GROUP BY file, value, odd)
      SELECT file, pos AS "offset" FROM l WHERE odd = 0
      UNION ALL SELECT b.file, b.pos FROM l AS b LEFT JOIN l AS a ON a.file = b.file AND a.value = b.value AND a.odd = 0
        WHERE b.odd = 1 AND b.chars > coalesce(a.most, -1)""",
)
def stream_grown_records(spark, sf):
    """Odd events are re-emissions of even ones in a later batch; a copy goes on when it is longer."""
    # A record's text is its content: the event type stands for it.
    record = F.expr("to_json(named_struct('id', string(value), 'type', 'user', 'content', event_type))")
    rows = M.table(spark, sf, "events").select(
        F.expr("string(user_id % 20)").alias("file"), F.col("event_id").cast("bigint").alias("offset"), record.alias("line")
    )
    path = scratch_path(spark, "records")
    even = F.col("offset") % 2 == 0
    rows.where(even).write.parquet(f"{path}/batch=0")
    lines = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
    parsed = shape2.read_records(lines).select("file", "offset", "record_id", "text")
    sink = _Sink(stateful.grown_records(parsed), "grown-rows")
    sink.follow()
    rows.where(~even).write.parquet(f"{path}/batch=1")
    sink.follow()
    return sink.rows().select(F.col("file").cast("bigint").alias("file"), "offset")


@query(
    "stream_recurrence",
    c("cur_sch", """SELECT uid, entity, recurrence, 'scheduled' AS status, TIMESTAMP '2024-06-01' + CASE recurrence
      WHEN 'every:90s' THEN INTERVAL 90 SECOND ELSE INTERVAL 2 HOUR END AS run_at
      FROM cur_sch WHERE status = 'fired' AND recurrence IN ('every:90s', 'every:2h')"""),
)
def stream_recurrence(spark, sf):
    """What has fired is scheduled again once, also when the stream is stopped and goes on."""
    store, positions = _stored(spark, "schedules"), scratch_path(spark, "schedule-positions")
    # Seven years of one row a second here and there: their order in fewer day folders.
    sooner = F.timestamp_micros(F.expr("unix_micros(cast(valid_from as timestamp)) div 1000"))
    given = M.schedules(spark, sf).withColumn("id", F.lpad(F.col("id").cast("string"), 14, "0")).withColumn("valid_from", sooner)
    store.append("schedule", _as_table(store, "schedule", given), "b-0")
    for _ in range(2):
        live.follow_recurrence(store, positions, lambda: NOW).awaitTermination()
    added = store.read("schedule").where(F.endswith("id", F.lit("-next")))
    number = [F.col(n).cast("bigint").alias(n) for n in ("uid", "entity")]
    return added.select(*number, "recurrence", "status", F.col("run_at").cast("timestamp_ntz").alias("run_at"))
