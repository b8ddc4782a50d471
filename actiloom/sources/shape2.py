"""Transcript shape 2: a header line, re-emitted records, calls with inline verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from ..operators import ordered
from . import lines as L

# The record types of this format.
USER, ASSISTANT = "user", "gemini"
NOTICES = ["info", "error", "warning"]


def has_key(json: Column, path: str) -> Column:
    """The key is there, even with the value null."""
    return J.at(json, path).isNotNull()


def dedupe(records: DataFrame) -> DataFrame:
    """Of records with one ``record_id``, the last in the file stays, where it stood.

    Records without one always stay. The last position per id is an aggregate
    with map-side combine; it is matched by position, which no two records
    share, so neither a hot file nor a hot id ends up in one task.
    """
    last = (
        records.where("record_id is not null")
        .groupBy(F.col("file").alias("_file"), "record_id")
        .agg(F.max("offset").alias("_offset"))
        .drop("record_id")
    )
    same = (F.col("file") == F.col("_file")) & (F.col("offset") == F.col("_offset"))
    return (
        records.join(last, same, "left")
        .where(F.col("record_id").isNull() | F.col("_offset").isNotNull())
        .drop("_file", "_offset")
    )


def keep_grown(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Across batches: a record whose id was captured before stays only when longer.

    ``seen`` has (file, record_id, chars) of what was captured.
    """
    known = seen.groupBy("file", "record_id").agg(F.max("chars").alias("_chars"))
    joined = records.join(known, ["file", "record_id"], "left")
    fresh = F.col("_chars").isNull() | (F.char_length("text") > F.col("_chars"))
    return joined.where(fresh).select(*records.columns)


def record_id(json: Column) -> Column:
    """The id of a record with a type; only such records are ever re-emitted."""
    return F.when(has_key(json, "$.type"), J.str_at(json, "$.id"))


def with_sessions(records: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Adds ``session_key``: the newest header above, own session id, or file name.

    ``records`` have ``own_session`` and ``is_header``; ``headers`` (file,
    session) holds what earlier batches found. The running header is computed
    in chunks of the file, so one huge file is many tasks.
    """
    flagged = records.withColumn("_header", F.when(F.col("is_header"), F.col("own_session")))
    filled = ordered.with_running_in_buckets(
        flagged,
        ["file"],
        ["offset"],
        F.expr(f"offset div {L.CHUNK_BYTES}"),
        {"_above": ordered.last_of(F.col("_header"))},
    )
    if headers is not None:
        before = headers.select("file", F.col("session").alias("_before"))
        filled = filled.join(before, "file", "left")
    else:
        filled = filled.withColumn("_before", F.lit(None).cast("string"))
    stem = F.coalesce(F.nullif(L.file_stem(F.col("file")), F.lit("")), F.lit("unknown-session"))
    key = F.coalesce("_above", "_before", "own_session", stem)
    return filled.withColumn("session_key", key).drop("_header", "_above", "_before")


def extract_text(json: Column) -> Column:
    parts = J.array_at(json, "$.content")
    texts = F.filter(F.transform(parts, lambda p: J.str_at(p, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(J.str_at(json, "$.content"), F.array_join(texts, "\n"), F.lit(""))


def _as_map(value: Column) -> Column:
    return F.from_json(F.to_json(value), "map<string, variant>")


def _rebuild(entries: Column) -> Column:
    return F.try_parse_json(F.to_json(entries))


def sanitize(text: Column) -> Column:
    """The record without display results and with long inline data cut.

    Every other field is kept. Records without either field skip the work.
    """

    def cut(data: Column) -> Column:
        plain = J.as_str(data)
        short = F.concat(
            F.left(plain, F.lit(model.INLINE_DATA_MAX)),
            F.lit("…[truncated "),
            F.octet_length(plain).cast("string"),
            F.lit(" bytes]"),
        )
        return F.when(
            F.octet_length(plain) > model.INLINE_DATA_MAX,
            F.get(F.from_json(F.to_json(F.array(short)), "array<variant>"), F.lit(0)),
        ).otherwise(data)

    def clean_call(call: Column) -> Column:
        kept = F.map_filter(_as_map(call), lambda k, _: k != "resultDisplay")
        return F.when(J.is_object(call), _rebuild(kept)).otherwise(call)

    def clean_inline(inline: Column) -> Column:
        done = F.transform_values(
            _as_map(inline), lambda k, v: F.when(k == "data", cut(v)).otherwise(v)
        )
        return F.when(J.is_object(inline), _rebuild(done)).otherwise(inline)

    def clean_part(part: Column) -> Column:
        done = F.transform_values(
            _as_map(part), lambda k, v: F.when(k == "inlineData", clean_inline(v)).otherwise(v)
        )
        return F.when(J.is_object(part), _rebuild(done)).otherwise(part)

    def clean(key: Column, value: Column) -> Column:
        items = J.as_array(value)
        return (
            F.when((key == "toolCalls") & items.isNotNull(), _rebuild(F.transform(items, clean_call)))
            .when((key == "content") & items.isNotNull(), _rebuild(F.transform(items, clean_part)))
            .otherwise(value)
        )

    cleaned = F.to_json(F.transform_values(F.from_json(text, "map<string, variant>"), clean))
    touched = F.contains(text, F.lit('"resultDisplay"')) | F.contains(text, F.lit('"inlineData"'))
    return F.when(touched, cleaned).otherwise(text)


def read_records(lines: DataFrame) -> DataFrame:
    """Everything a chat line says, read out in one pass over its JSON."""
    json = F.col("json")
    own = J.str_at(json, "$.sessionId")
    is_set = F.coalesce(has_key(json, "$.$set"), F.lit(False))
    is_header = F.coalesce(
        own.isNotNull() & ~has_key(json, "$.type") & ~is_set, F.lit(False)
    )
    kind = (
        F.when(is_header | is_set, "header")
        .when(json.isNull(), "unparseable")
        .otherwise(F.coalesce(J.str_at(json, "$.type"), F.lit("")))
    )
    calls = F.transform(
        J.array_at(json, "$.toolCalls"),
        lambda c: F.struct(
            J.str_at(c, "$.name").alias("tool"), J.str_at(c, "$.status").alias("status")
        ),
    )
    typed = L.parsed(lines).select(
        "file", "offset", "text", "json", own.alias("own_session"), is_header.alias("is_header"), kind.alias("type")
    )
    is_message = F.col("type").isin(USER, ASSISTANT)
    rest = ~is_message & ~F.col("type").isin("header", *NOTICES)
    shown = F.coalesce(
        F.to_json("json"),
        F.to_json(F.struct(F.col("text").alias("line"), F.lit("unparseable").alias("type"))),
    )
    return typed.select(
        "file",
        "offset",
        "text",
        "own_session",
        "is_header",
        "type",
        is_message.alias("is_message"),
        record_id(json).alias("record_id"),
        F.when(is_message, extract_text(json)).alias("content"),
        F.when(is_message, clock.parse_rfc3339(J.str_at(json, "$.timestamp"))).alias("emitted_at"),
        F.when(is_message, calls).alias("calls"),
        F.when(F.col("type").isin(NOTICES), J.str_at(json, "$.content")).alias("notice"),
        F.when(rest, F.left(shown, F.lit(model.SNIPPET_CHARS))).alias("snippet"),
    )


def route(
    lines: DataFrame,
    headers: DataFrame | None = None,
    seen: DataFrame | None = None,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Routed chat lines.

    Header lines set the session and emit nothing, nor do ``$set`` lines. user
    and assistant records are messages with a light event and one event per
    tool call; notices are events; everything else is kept raw. ``hold`` may
    cache the parsed records, which the steps after read more than once.
    """
    records = dedupe(hold(read_records(lines)))
    if seen is not None:
        records = keep_grown(records, seen)
    is_message = F.col("is_message")
    filled = with_sessions(records, headers).withColumns(
        {
            "role": F.when(is_message, F.when(F.col("type") == USER, "user").otherwise("assistant")),
            "raw": F.when(is_message, sanitize(F.col("text"))),
        }
    )
    session = F.col("session_key")
    calls = F.transform(
        "calls",
        lambda c, i: L.event(
            "tool_call", L.payload(tool=c["tool"], status=c["status"], session=session), "source", i + 1
        ),
    )
    notice = L.event(
        "transcript_event",
        L.payload(kind=F.col("type"), session=session, content=F.col("notice")),
        "source",
    )
    rest = L.event(
        "transcript_raw",
        L.payload(file=F.col("file"), session=session, snippet=F.col("snippet")),
        "source",
    )
    light = F.array(L.captured())
    given = (
        F.when(is_message, F.when(F.col("calls").isNull(), light).otherwise(F.concat(light, calls)))
        .when(F.col("type") == "header", F.slice(F.array(rest), 1, 0))
        .when(F.col("type").isin(NOTICES), F.array(notice))
        .otherwise(F.array(rest))
    )
    return filled.withColumn("events", given).select(*L.ROUTED_COLUMNS, "is_header")


def headers_of(routed: DataFrame) -> DataFrame:
    """The last header of each file, for batches to come."""
    return (
        routed.where("is_header")
        .groupBy("file")
        .agg(F.max_by("session_key", "offset").alias("session"))
    )
