"""Time and duration expressions. The current time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DURATION = "^([0-9]+)([smhd])$"


def instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def mark(df: DataFrame, value, column: str = "valid_from") -> Column:
    """A moment as a literal of the column's own type, so comparisons reach the scan."""
    if isinstance(value, Column):
        return value
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text to TIMESTAMP; text without a zone or malformed is null."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.try_to_timestamp(F.upper(text)))


def event_time(emitted: str = "emitted_at", ingested: str = "valid_from") -> Column:
    """When a message happened, falling back to when it was captured."""
    return F.coalesce(F.col(emitted), F.col(ingested))


def iso_weekday(ts: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(ts) + 1


def minus_seconds(ts: Column, seconds: int) -> Column:
    return ts - F.expr(f"make_dt_interval(0, 0, 0, {int(seconds)})")


def duration_seconds(token: Column) -> Column:
    """``<n><s|m|h|d>`` in seconds; null for anything else."""
    unit = F.regexp_extract(token, DURATION, 2)
    factor = (
        F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    )
    number = F.regexp_extract(token, DURATION, 1)
    return F.when(token.rlike(DURATION), number.try_cast("bigint") * factor)


def duration_token(token: Column) -> Column:
    """The normal form: no leading zeros, unit kept."""
    number = F.regexp_extract(token, DURATION, 1).try_cast("bigint").cast("string")
    return F.when(token.rlike(DURATION), F.concat(number, F.regexp_extract(token, DURATION, 2)))


def add_duration(ts: Column, token: Column) -> Column:
    """``ts`` moved forward by a duration token; null for a bad token."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), duration_seconds(token).cast("decimal(18,6)"))
    return ts + step
