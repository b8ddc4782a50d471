"""Column helpers shared by the line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonval as J

# One chunk of a file in order-dependent steps, in bytes.
CHUNK_BYTES = 64 * 1024 * 1024

# What routing makes of one line: a message or not, and the events it gives.
ROUTED_COLUMNS = [
    "file", "offset", "session_key", "is_message", "role", "content", "raw", "emitted_at", "events",
]


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n\u000b\f"))


def file_stem(file: Column) -> Column:
    """File name without its last extension."""
    name = F.substring_index(file, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parsed(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their text and whole-line JSON value (null if not JSON)."""
    text = lines.where("line is not null").select("file", "offset", trimmed(F.col("line")).alias("text"))
    return text.where("text <> ''").withColumn("json", J.parse_whole(F.col("text")))


def payload(**fields: Column) -> Column:
    """A JSON object of the fields that are not null."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def event(name: Column | str, body: Column, about: str, nth: Column | int = 0) -> Column:
    """One event of a line; ``about`` says whether its subject is the session or the source."""
    return F.struct(
        (nth if isinstance(nth, Column) else F.lit(nth)).cast("int").alias("nth"),
        (name if isinstance(name, Column) else F.lit(name)).alias("lifecycle_event"),
        body.alias("payload"),
        F.lit(about).alias("about"),
    )


def captured() -> Column:
    """The light event that goes with each message."""
    body = payload(
        role=F.col("role"), session=F.col("session_key"), chars=F.char_length("content")
    )
    return event("message_captured", body, "session")


def messages(routed: DataFrame) -> DataFrame:
    return routed.where("is_message").select(
        "file", "offset", F.lit(0).alias("nth"), "session_key", "role", "content", "raw", "emitted_at"
    )


def events(routed: DataFrame) -> DataFrame:
    return routed.select("file", "offset", "session_key", F.inline("events")).select(
        "file", "offset", "nth", "lifecycle_event", "payload", "session_key", "about"
    )
