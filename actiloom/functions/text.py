"""Rendering and naming expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model
from . import jsonval as J


def elide(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, marking the cut."""
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def first_line(text: Column, limit: int = 60) -> Column:
    return elide(F.rtrim(F.split(text, "\n", 2)[0], F.lit("\r")), limit)


def agent_of(name: Column) -> Column:
    return F.split(name, "/", 2)[0]


def source_key_of(name: Column) -> Column:
    return F.coalesce(F.get(F.split(name, "/", 2), F.lit(1)), F.lit(""))


def short_id(identity: Column, size: int = 8) -> Column:
    return F.substring(identity.cast("string"), 1, size)


def line_count(text: Column) -> Column:
    """Newline-separated parts; the empty string has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("bigint")


def plain(value: Column) -> Column:
    """One payload value as text: strings bare, null empty, the rest as JSON."""
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(""))
        .when(J.kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
        .otherwise(F.to_json(value))
    )


def payload_summary(payload: Column, limit: int = 80) -> Column:
    """``k=v`` pairs in key order, long values cut; non-objects shown bare."""

    def pair(entry: Column) -> Column:
        return F.concat(entry["key"], F.lit("="), elide(plain(entry["value"]), limit))

    # Pairs are ordered by key before they are rendered: keys are unique.
    def pairs(fields: Column) -> Column:
        by_key = F.transform(
            F.array_sort(F.map_keys(fields)),
            lambda k: F.struct(k.alias("key"), F.element_at(fields, k).alias("value")),
        )
        return F.array_join(F.transform(by_key, pair), " ")

    return J.let(
        J.parse(payload),
        lambda value: F.when(
            J.is_object(value), J.let(F.from_json(payload, "map<string, variant>"), pairs)
        ).otherwise(elide(plain(value), limit)),
    )


def _filled(value: Column, path: str) -> Column:
    return F.nullif(J.str_at(value, path), F.lit(""))


def tool_summary(raw: Column) -> Column:
    """What a record's tool blocks and calls did, on one line; null for none.

    ``raw`` is parsed with :data:`jsonval.TOOLS_SCHEMA`.
    """

    def block(b: Column) -> Column:
        kind = J.str_at(b, "$.type")
        name = F.coalesce(_filled(b, "$.name"), F.lit("tool"))
        hint = F.coalesce(*[_filled(b, f"$.input.{f}") for f in model.HINT_FIELDS])
        return (
            F.when(
                kind == "tool_use",
                F.concat(
                    F.lit("⚙ "),
                    name,
                    F.coalesce(F.concat(F.lit(" — "), elide(hint, 60)), F.lit("")),
                ),
            )
            .when(kind == "thinking", F.lit("… thinking"))
            .when(kind == "tool_result", F.lit("⚙ result"))
        )

    def call(c: Column) -> Column:
        name = F.coalesce(_filled(c, "$.name"), F.lit("tool"))
        status = F.concat(F.lit(" ["), _filled(c, "$.status"), F.lit("]"))
        return F.when(J.is_object(c), F.concat(F.lit("⚙ "), name, F.coalesce(status, F.lit(""))))

    none = F.expr("array()").cast("array<string>")

    def line(record: Column) -> Column:
        blocks = F.transform(J.as_array(record["message"]["content"]), block)
        calls = F.transform(J.as_array(record["toolCalls"]), call)
        # array_join leaves nulls out.
        return F.array_join(F.concat(F.coalesce(blocks, none), F.coalesce(calls, none)), "; ")

    return J.let(J.let(raw, line), lambda joined: F.when(joined != "", elide(joined, 160)))


def render_message(ts: Column, role: Column, content: Column, summary: Column) -> Column:
    """``[time] role: content``, the role right-aligned, later lines indented."""
    body = F.when(content != "", content).otherwise(
        F.coalesce(summary, F.lit("(no text — see raw)"))
    )
    return F.concat(
        F.lit("["),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.lit("] "),
        F.when(F.char_length(role) < 9, F.lpad(role, 9, " ")).otherwise(role),
        F.lit(": "),
        F.replace(body, F.lit("\n"), F.lit("\n    ")),
    )


def render_event(ts: Column, name: Column, summary: Column) -> Column:
    """``[HH:MM:SS] name summary`` with the name padded to 20 characters."""
    padded = F.when(F.char_length(name) < 20, F.rpad(name, 20, " ")).otherwise(name)
    return F.concat(
        F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), padded, F.lit(" "), summary
    )


def mime_of(file_name: Column) -> Column:
    """MIME type by the lower-cased last dot segment."""
    table = F.create_map(*[F.lit(x) for pair in model.MIME_TYPES.items() for x in pair])
    extension = F.lower(F.substring_index(file_name, ".", -1))
    return F.coalesce(F.try_element_at(table, extension), F.lit(model.OTHER_MIME))


def liveness(last_active: Column, now: Column) -> Column:
    """active under 5 minutes, paused under a day, else ended; unknown without a time."""
    age = F.timestamp_diff("SECOND", last_active, now)
    return (
        F.when(last_active.isNull(), "unknown")
        .when(age < 300, "active")
        .when(age < 86_400, "paused")
        .otherwise("ended")
    )


def liveness_rank(state: Column) -> Column:
    return F.when(state == "active", 0).when(state == "paused", 1).when(state == "ended", 2).otherwise(3)


def context_band(percent: Column) -> Column:
    return (
        F.when(percent >= 90, "red").when(percent >= 70, "yellow").when(percent.isNotNull(), "green")
    )


def context_percent(context: Column, window: Column) -> Column:
    """Share of the context window as a whole number from 0 to 100."""
    percent = (context * 100 / window).cast("bigint")
    # greatest and least skip nulls, so an unknown size is kept out first.
    return F.when(percent.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), percent)))
