"""Live views as streaming reads of the append tables.

Each table has its own position in the stream checkpoint: a slow table is
never skipped, and a reader that lags misses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feed
from ..operators import schedule as scheduling
from ..sources.store import Store

#: How far a row's time may lie behind the newest one for the row to be taken.
WATERMARK = "10 minutes"


def event_tail(events: DataFrame, agent: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """New events, of one agent if asked, each id once; the filter runs before the state and the sink."""
    return _each_once(events if agent is None else events.where(F.col("agent") == agent), watermark)


def conversation_tail(messages: DataFrame, session: str, watermark: str = WATERMARK) -> DataFrame:
    """New messages of one session, each id once."""
    return _each_once(messages.where(F.col("session") == session), watermark)


def _each_once(rows: DataFrame, watermark: str) -> DataFrame:
    """A batch written again after a crash shows up as new files; its rows are known by their ids.

    Ids are forgotten once the watermark has passed them, and rows as old as
    that are not taken any more, so a repeated batch of any age adds nothing.
    """
    return rows.withWatermark("valid_from", watermark).dropDuplicatesWithinWatermark(["id"])


def merged_feed(messages: DataFrame, events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """New messages and events in the feed's row shape, each id once.

    A batch written again after a crash shows up as new files; within the
    watermark its rows are recognised by their ids. Each table has its own
    watermark and the slower one counts, so rows of a table that lags are kept;
    while one table is silent, the ids of the other stay remembered.
    """
    policy = messages.sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    if policy != "min":
        raise ValueError(f"spark.sql.streaming.multipleWatermarkPolicy is {policy}: rows of the slower table would be lost")
    sides = feed.message_rows(messages), feed.event_rows(events)
    slow, fast = (side.withWatermark("valid_from", watermark) for side in sides)
    return slow.unionByName(fast).dropDuplicatesWithinWatermark(["kind", "id"])


def windowed_counts(
    rows: DataFrame, time: str = "valid_from", width: str = "1 minute", watermark: str = WATERMARK
) -> DataFrame:
    """Rows per tumbling window; a window is final once the watermark passes it.

    Backfilled rows carry old times and come late by design, so results over
    all history are batch queries; this counts what arrives now.
    """
    return (
        rows.withWatermark(time, watermark)
        .groupBy(F.window(time, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")
    )


def follow_recurrence(store: Store, checkpoint: str, clock, once: bool = True):
    """Append the next ``scheduled`` row for chains that have just fired.

    ``clock`` gives the current time; the new row's id follows from the fired
    row, and the batch is written under its number, so a repeat changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = f"recurrence-{number}"
        chains = batch.where("status = 'fired'").select("uid").distinct()
        all_rows = store.read("schedule", without_batch=name)
        touched = all_rows.join(chains, "uid", "left_semi")
        store.append("schedule", scheduling.recurrence(touched, clock()), name)

    writer = (
        store.stream("schedule")
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
