"""Tool calls read out of raw message records: usage, outcomes, lines written.

Everything starts from the newest-N window of messages (ties by id), which is
the feature's own bound: the limit comes before any JSON is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import jsonval as J
from ..functions import text as X
from ..session import materialize
from . import lookup


def recent_window(messages: DataFrame, window: int = model.STATS_WINDOW) -> DataFrame:
    """The newest messages, fixed: what follows reads them more than once."""
    return materialize(lookup.newest(lookup.cut_to_newest(messages, window), window))


def _parsed(messages: DataFrame) -> DataFrame:
    return messages.withColumn("_raw", J.typed(F.col("raw"), J.TOOLS_SCHEMA))


def blocks(messages: DataFrame) -> DataFrame:
    """Shape 1 content blocks that are objects, with their position in the record."""
    parsed = _parsed(messages).select(
        "id", "session", "valid_from", J.as_array(F.col("_raw.message.content")).alias("_b")
    )
    exploded = parsed.select("id", "session", "valid_from", F.posexplode("_b").alias("pos", "block"))
    return exploded.where(J.is_object(F.col("block")))


def inline_calls(messages: DataFrame) -> DataFrame:
    """Shape 2 calls that are objects; the verdict is on the call itself."""
    parsed = _parsed(messages).select(
        "id", "session", "valid_from", J.as_array(F.col("_raw.toolCalls")).alias("_c")
    )
    exploded = parsed.select("id", "session", "valid_from", F.posexplode("_c").alias("pos", "call"))
    call = F.col("call")
    return exploded.where(J.is_object(call)).select(
        "id",
        "session",
        "valid_from",
        "pos",
        F.coalesce(J.str_at(call, "$.name"), F.lit("tool")).alias("name"),
        J.str_at(call, "$.status").alias("status"),
    )


def tool_uses(messages: DataFrame) -> DataFrame:
    """Shape 1 calls with the lines their input writes."""
    block = F.col("block")
    return (
        blocks(messages)
        .where(J.str_at(block, "$.type") == "tool_use")
        .select(
            "id",
            "session",
            "valid_from",
            "pos",
            F.coalesce(J.str_at(block, "$.name"), F.lit("tool")).alias("name"),
            J.str_at(block, "$.id").alias("call_id"),
            written_lines(block).alias("lines"),
        )
    )


def written_lines(block: Column) -> Column:
    """Lines a call writes: content, else new_string, else every edit's new_string."""
    text = F.coalesce(J.str_at(block, "$.input.content"), J.str_at(block, "$.input.new_string"))
    edits = F.aggregate(
        F.transform(
            J.array_at(block, "$.input.edits"),
            lambda e: F.coalesce(X.line_count(J.str_at(e, "$.new_string")), F.lit(0).cast("bigint")),
        ),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    lines = F.coalesce(X.line_count(text), edits, F.lit(0).cast("bigint"))
    writes = J.str_at(block, "$.name").isin(model.WRITE_TOOLS)
    return F.when(writes, lines).otherwise(F.lit(0).cast("bigint"))


def verdicts(window: DataFrame) -> DataFrame:
    """Each shape 1 call of the window with ``failed``: true, false, or null for unknown.

    Calls and results with one id pair off in walk order (newest message
    first, blocks in order): a row pairs with the row before it when that one
    is of the other kind and still free; of two equal rows in a row the later
    replaces the earlier. An id that occurs once on each side simply joins.
    The window bounds the rows, so it also bounds what one id can hold.
    """
    block = F.col("block")
    kind = J.str_at(block, "$.type")
    is_call = kind == "tool_use"
    call_id = F.when(is_call, J.str_at(block, "$.id")).otherwise(J.str_at(block, "$.tool_use_id"))
    rows = (
        blocks(window)
        .where(kind.isin("tool_use", "tool_result"))
        .select(
            "id",
            "session",
            "valid_from",
            "pos",
            is_call.alias("is_call"),
            call_id.alias("call_id"),
            F.when(is_call, F.coalesce(J.str_at(block, "$.name"), F.lit("tool"))).alias("name"),
            F.when(~is_call, F.coalesce(J.bool_at(block, "$.is_error"), F.lit(False))).alias("failed"),
        )
        # Calls without an id stay among themselves and never pair.
        .where("is_call or call_id is not null")
    )
    walk = Window.partitionBy("call_id").orderBy(
        F.desc("valid_from"), F.desc("id"), F.asc("pos")
    )
    # A run is a stretch in which calls and results alternate.
    breaks = rows.withColumn(
        "_new",
        F.when(F.col("is_call") == F.lag("is_call").over(walk), 1).otherwise(0),
    ).withColumn("_run", F.sum("_new").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("call_id", "_run").orderBy(
        F.desc("valid_from"), F.desc("id"), F.asc("pos")
    )
    paired = breaks.withColumns(
        {
            "_nth": F.row_number().over(run),
            "_before": F.lag("failed").over(run),
            "_after": F.lead("failed").over(run),
        }
    ).where("is_call")
    scored = paired.withColumn(
        "failed", F.when(F.col("_nth") % 2 == 0, F.col("_before")).otherwise(F.col("_after"))
    )
    return scored.select("id", "session", "valid_from", "pos", "name", "call_id", "failed")


def tool_usage(messages: DataFrame, window: int = model.STATS_WINDOW) -> DataFrame:
    """Calls per tool in the window, both shapes, most used first."""
    recent = recent_window(messages, window)
    names = tool_uses(recent).select("name").unionByName(inline_calls(recent).select("name"))
    return (
        names.groupBy("name")
        .agg(F.count(F.lit(1)).alias("value"))
        .orderBy(F.desc("value"), "name")
    )


def tool_outcomes(messages: DataFrame, window: int = model.STATS_WINDOW) -> DataFrame:
    """ok, failed, cancelled and unknown calls per tool."""
    recent = recent_window(messages, window)
    first = verdicts(recent).select(
        "name",
        (F.col("failed") == F.lit(False)).alias("ok"),
        F.col("failed").alias("bad"),
        F.lit(False).alias("stopped"),
    )
    status = F.col("status")
    bad, stopped = status.isin("error", "failed"), status.isin("cancelled", "canceled")
    second = inline_calls(recent).select(
        "name", (~bad & ~stopped).alias("ok"), bad.alias("bad"), stopped.alias("stopped")
    )
    counted = (
        first.unionByName(second)
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if("ok").alias("ok"),
            F.count_if("bad").alias("failed"),
            F.count_if("stopped").alias("cancelled"),
        )
    )
    rest = F.col("calls") - F.col("ok") - F.col("failed") - F.col("cancelled")
    return counted.select(
        "name", "ok", "failed", "cancelled", F.greatest(F.lit(0), rest).alias("unknown")
    ).orderBy(F.desc(F.expr("ok + failed + cancelled + unknown")), "name")


def lines_written(messages: DataFrame, window: int = model.STATS_WINDOW) -> DataFrame:
    lines = tool_uses(recent_window(messages, window))
    return lines.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_written"))


def top_sessions(
    messages: DataFrame,
    sessions: DataFrame,
    window: int = model.STATS_WINDOW,
    top: int = 6,
) -> DataFrame:
    """Messages, written lines and output tokens per session of the window."""
    recent = _parsed(recent_window(messages, window))
    content = J.as_array(F.col("_raw.message.content"))
    used = F.filter(content, lambda b: J.str_at(b, "$.type") == "tool_use")
    lines = F.aggregate(
        F.transform(used, written_lines), F.lit(0).cast("bigint"), lambda total, n: total + n
    )
    totals = (
        recent.select(
            "session",
            F.coalesce(lines, F.lit(0)).alias("lines"),
            J.output_tokens_both(F.col("_raw")).alias("tokens"),
        )
        .groupBy("session")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.sum("lines").alias("lines_written"),
            F.sum("tokens").alias("output_tokens"),
        )
        .orderBy(F.desc("messages"), "session")
        .limit(top)
    )
    return with_identity(totals, sessions).orderBy(F.desc("messages"), "session")


def with_identity(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``identity``: ``<agent>/<id8>``, or the first 8 characters of the id."""
    names = sessions.select(
        F.col("id").alias("session"), F.col("agent_name").alias("_agent")
    )
    short = X.short_id(F.col("session"))
    return (
        rows.join(names, "session", "left")
        .withColumn("identity", F.concat_ws("/", F.col("_agent"), short))
        .drop("_agent")
    )
