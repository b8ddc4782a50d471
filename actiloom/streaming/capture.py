"""Capture as Structured Streaming: growing files to tables, exactly once.

One query per adapter, so a failing one leaves the others running. The stream
checkpoint holds the read positions; a batch writes each table under its own
batch number, so repeating it after a crash replaces instead of doubling.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import jsonval as J
from ..operators import lookup, versioned
from ..sources import capture, shape2, tail
from ..sources.adapters import Adapter
from ..sources.store import Store

INTERVAL = "2 seconds"


def write_batch(batch: DataFrame, number: int, adapter: Adapter, store: Store) -> None:
    """Write everything one micro-batch of lines adds."""
    name = f"{adapter.name}-{number}"
    now = F.lit(dt.datetime.now(dt.timezone.utc))
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        # Spills to disk; a lost block is computed again from its byte range.
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    try:
        if batch.isEmpty():
            return
        ledger = store.read("state_ledger", without_batch=name)
        headers = seen = None
        if adapter.has_headers:
            headers = versioned.latest_by(
                store.read("chat_header", without_batch=name), ["file"], ("valid_from", "session")
            )
        if adapter.grow_only:
            seen = store.read("chat_seen", without_batch=name)
        added = capture.capture(batch, adapter, ledger, now, str(number), headers, seen, hold)
        for table, rows in added.items():
            store.append(table, rows, name)
        if adapter.grow_only:
            store.append("chat_seen", _records_seen(batch, now), name)
    finally:
        for df in held:
            df.unpersist()


def _records_seen(lines: DataFrame, now) -> DataFrame:
    records = shape2.read_records(lines).select(
        "file", "record_id", F.char_length("text").cast("bigint").alias("chars")
    )
    return records.where("record_id is not null").groupBy("file", "record_id").agg(
        F.max("chars").alias("chars")
    ).withColumn("valid_from", now)


def start(
    adapter: Adapter, store: Store, checkpoint: str, interval: str | None = INTERVAL, **options
) -> StreamingQuery:
    """Follow an adapter's files. Without an interval, catch up once and stop.

    New files are found by every batch; pausing is stopping the query.
    """
    if adapter.max_backfill_bytes is not None:
        options["maxBackfillBytes"] = str(adapter.max_backfill_bytes)
    found = tail.stream_lines(store.spark, adapter.glob(), **options)
    writer = (
        found.writeStream.queryName(f"capture-{adapter.name}")
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{adapter.name}")
        .foreachBatch(lambda batch, number: write_batch(batch, number, adapter, store))
    )
    once = interval is None
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def enabled(adapters: list[Adapter], store: Store) -> list[Adapter]:
    """Adapters the operator has not disabled; a status never written means enabled.

    Only the adapters' own names are asked for, so the answer is as short as the list.
    """
    ledger = store.read("state_ledger")
    named = lookup.named_state(ledger, "attr_module_descriptor").select("target", "name")
    status = versioned.current_state(ledger.where("type = 'attr_module_status'")).select(
        "target", J.str_field(F.col("payload"), "status").alias("status")
    )
    asked = named.where(F.col("name").isin([a.name for a in adapters]))
    off = asked.join(status, "target").where("status = 'disabled'").select("name").distinct()
    disabled = {row["name"] for row in off.collect()}
    return [a for a in adapters if a.name not in disabled]


def run_once(adapters: list[Adapter], store: Store, checkpoint: str, **options) -> dict[str, str]:
    """One capture pass over all enabled adapters; returns the error of each that failed.

    A failure becomes a ``discovery_error`` (the files could not be looked for)
    or ``capture_error`` event and does not stop the others. The failed adapter's
    read position stays, so the next pass tries the same lines again.
    """
    lost: dict[str, str] = {}
    failed: dict[str, str] = {}
    running: dict[str, StreamingQuery] = {}
    for adapter in enabled(adapters, store):
        try:
            running[adapter.name] = start(adapter, store, checkpoint, None, **options)
        except Exception as error:  # noqa: BLE001
            lost[adapter.name] = str(error)
    for name, query in running.items():
        try:
            query.awaitTermination()
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error)
    _log_errors(store, lost, "discovery_error", "adapter")
    _log_errors(store, failed, "capture_error", "source")
    return lost | failed


def _log_errors(store: Store, errors: dict[str, str], event: str, field: str) -> None:
    if not errors:
        return
    now = dt.datetime.now(dt.timezone.utc)
    stamp = now.strftime("%Y%m%d%H%M%S%f")
    rows = store.spark.createDataFrame(
        [(f"x-{stamp}-{name}", name, error, now) for name, error in errors.items()],
        f"id string, {field} string, error string, valid_from timestamp",
    )
    none = F.lit(None).cast("string")
    store.append(
        "telemetry_stream",
        rows.select(
            "id",
            F.lit(event).alias("lifecycle_event"),
            F.to_json(F.struct(field, "error")).alias("payload"),
            none.alias("subject"),
            none.alias("agent"),
            "valid_from",
        ),
        f"{event}-{stamp}",
    )
