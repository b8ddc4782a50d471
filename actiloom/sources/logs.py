"""Multi-line application logs: fold records, keep the ones that say something."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators import ordered
from . import lines as L

RECORD_START = "^[0-9]{4}-..-.. "


def is_source(file_name: Column) -> Column:
    """Active logs: ``*.log``, no duplicate window log, no rotated generation."""
    stem = F.regexp_replace(file_name, r"(\.log)+$", "")
    return (
        F.endswith(file_name, F.lit(".log"))
        & ~F.startswith(file_name, F.lit("unknown-window"))
        & ~F.endswith(stem, F.lit("1"))
    )


def has_signal(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in model.LOG_SIGNALS])


def number_records(
    lines: DataFrame, order: str = "offset", chunk: int = L.CHUNK_BYTES
) -> DataFrame:
    """Lines with the number of the record they belong to.

    A record begins at a date-prefixed line; lines above the first one form
    record 0. The running count is split by position, so one huge log is many
    tasks.
    """
    flagged = lines.withColumn("_start", F.col("line").rlike(RECORD_START).cast("bigint"))
    return ordered.with_running_in_buckets(
        flagged,
        ["file"],
        [order],
        F.expr(f"{order} div {int(chunk)}"),
        {"record": ordered.sum_of(F.col("_start"))},
    ).drop("_start")


def fold(numbered: DataFrame, order: str = "offset") -> DataFrame:
    """One row per record: (file, record, offset of its first line, text)."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line")))
    return numbered.groupBy("file", "record").agg(
        F.min(order).alias(order),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
    )


def signals(lines: DataFrame, order: str = "offset", chunk: int = L.CHUNK_BYTES) -> DataFrame:
    """Folded records that contain a signal marker.

    No marker spans lines, so records are chosen by their lines first and only
    those few are put together.
    """
    numbered = number_records(lines.where("line is not null"), order, chunk)
    wanted = numbered.where(has_signal(F.col("line"))).select("file", "record").distinct()
    return fold(numbered.join(wanted, ["file", "record"], "left_semi"), order)


def route(lines: DataFrame, agent: str) -> DataFrame:
    """Routed log records, events only; the file is named ``<agent>/<file name>``."""
    name = F.concat(F.lit(f"{agent}/"), F.substring_index("file", "/", -1))
    kept = signals(lines).withColumn(
        "events",
        F.array(L.event("desktop_event", L.payload(line=F.col("text"), file=name), "source")),
    )
    none = F.lit(None).cast("string")
    return kept.withColumns(
        {
            "session_key": none,
            "is_message": F.lit(False),
            "role": none,
            "content": none,
            "raw": none,
            "emitted_at": F.lit(None).cast("timestamp"),
        }
    ).select(*L.ROUTED_COLUMNS)
