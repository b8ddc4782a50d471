"""Transcript shape 1: one JSON object per line, content in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from . import lines as L


def blocks(json: Column) -> Column:
    return J.array_at(json, "$.message.content")


def classify_role(json: Column, line_type: Column) -> Column:
    """assistant; a human prompt is user; tool results are tool; the rest is system."""
    human = J.str_at(json, "$.origin.kind") == "human"
    has_result = F.exists(blocks(json), lambda b: J.str_at(b, "$.type") == "tool_result")
    return (
        F.when(line_type == "assistant", "assistant")
        .when(human, "user")
        .when(has_result, "tool")
        .otherwise("system")
    )


def extract_text(json: Column) -> Column:
    """String content as it is; text blocks and string results joined by newlines."""

    def piece(b: Column) -> Column:
        kind = J.str_at(b, "$.type")
        return F.when(kind == "text", J.str_at(b, "$.text")).when(
            kind == "tool_result", J.str_at(b, "$.content")
        )

    pieces = F.filter(F.transform(blocks(json), piece), lambda t: t.isNotNull())
    return F.coalesce(
        J.str_at(json, "$.message.content"), F.array_join(pieces, "\n"), F.lit("")
    )


def route(lines: DataFrame) -> DataFrame:
    """Routed transcript lines.

    user and assistant lines are messages, each with a light event; lines that
    are not JSON and lines of other types are kept as events. Every line is
    parsed once and gives exactly one event.
    """
    json = F.col("json")
    line_type = F.coalesce(J.str_at(json, "$.type"), F.lit(""))
    typed = L.parsed(lines).select(
        "file",
        "offset",
        "text",
        "json",
        line_type.alias("type"),
        F.coalesce(J.str_at(json, "$.sessionId"), L.file_stem(F.col("file"))).alias("session_key"),
        (json.isNotNull() & line_type.isin("user", "assistant")).alias("is_message"),
    )
    is_message = F.col("is_message")
    filled = typed.withColumns(
        {
            "role": F.when(is_message, classify_role(json, F.col("type"))),
            "content": F.when(is_message, extract_text(json)),
            "raw": F.when(is_message, F.col("text")),
            "emitted_at": F.when(is_message, clock.parse_rfc3339(J.str_at(json, "$.timestamp"))),
        }
    )
    raw = L.event(
        "transcript_raw",
        L.payload(
            file=F.col("file"),
            session=F.col("session_key"),
            snippet=F.left("text", F.lit(model.SNIPPET_CHARS)),
        ),
        "source",
    )
    other = L.event(
        "transcript_event",
        L.payload(kind=F.col("type"), session=F.col("session_key"), file=F.col("file")),
        "source",
    )
    given = F.when(is_message, L.captured()).when(json.isNull(), raw).otherwise(other)
    return filled.withColumn("events", F.array(given)).select(*L.ROUTED_COLUMNS)
