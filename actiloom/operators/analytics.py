"""Dashboard numbers: totals, tokens, calendars, sessions and agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from ..functions import text as X
from ..session import materialize
from . import lookup, versioned

_STAMP = ("valid_from", "id")


def _count(name: str = "value") -> Column:
    return F.count(F.lit(1)).alias(name)


def row_totals(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of both tables; an empty table counts 0."""
    m = messages.select(F.lit("messages_total").alias("name"), F.lit(1).alias("n"))
    e = events.select(F.lit("events_total").alias("name"), F.lit(1).alias("n"))
    is_message = F.col("name") == "messages_total"
    return m.unionAll(e).agg(
        F.count_if(~is_message).alias("events_total"), F.count_if(is_message).alias("messages_total")
    )


def output_token_total(messages: DataFrame) -> DataFrame:
    raw = J.typed(F.col("raw"), J.USAGE_SCHEMA)
    tokens = messages.select(raw.alias("_raw")).select(J.output_tokens(F.col("_raw")).alias("t"))
    return tokens.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("output_tokens"))


def token_totals(messages: DataFrame) -> DataFrame:
    """Input, output, cache read and cache write over both shapes, one parse per row."""
    raw = F.col("_raw")
    usage, tokens = raw["message"]["usage"], raw["tokens"]
    sources = {
        "input": (usage["input_tokens"], tokens["input"]),
        "output": (usage["output_tokens"], tokens["output"]),
        "cache_read": (usage["cache_read_input_tokens"], tokens["cached"]),
        "cache_write": (usage["cache_creation_input_tokens"],),
    }
    return messages.select(J.typed(F.col("raw"), J.USAGE_SCHEMA).alias("_raw")).agg(
        *[
            F.coalesce(F.sum(F.coalesce(*parts, F.lit(0))), F.lit(0)).alias(name)
            for name, parts in sources.items()
        ]
    )


def active_sessions(messages: DataFrame, now, seconds: int = model.ACTIVE_SECONDS) -> DataFrame:
    """Distinct sessions with a message newer than ``now`` minus ``seconds``."""
    recent = messages.where(F.col("valid_from") > clock.minus_seconds(clock.instant(now), seconds))
    return recent.agg(F.count_distinct("session").alias("active_sessions"))


def identity_totals(
    agents: DataFrame, sessions: DataFrame, module_states: DataFrame
) -> DataFrame:
    """Named agents, sessions and modules, and modules whose lifecycle is active."""
    tagged = [
        agents.select(F.lit("agent").alias("k"), F.lit(None).cast("string").alias("lifecycle")),
        sessions.select(F.lit("session").alias("k"), F.lit(None).cast("string").alias("lifecycle")),
        module_states.select(F.lit("module").alias("k"), "lifecycle"),
    ]
    rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2])
    return rows.agg(
        F.count_if(F.col("k") == "agent").alias("agents"),
        F.count_if(F.col("k") == "session").alias("sessions"),
        F.count_if(F.col("k") == "module").alias("modules"),
        F.count_if(F.col("lifecycle") == "active").alias("modules_active"),
    )


def status_health(module_states: DataFrame) -> DataFrame:
    """Unhealthy when modules exist and none of them is active."""
    counts = module_states.agg(
        F.count(F.lit(1)).alias("modules"),
        F.count_if(F.col("lifecycle") == "active").alias("active"),
    )
    return counts.withColumn("healthy", (F.col("modules") == 0) | (F.col("active") > 0))


def events_per_minute(events: DataFrame, window: int = model.EVENT_WINDOW) -> DataFrame:
    """Newest events by full minute in time order, labelled HH:MM."""
    recent = lookup.newest(events.select("id", "valid_from"), window)
    return (
        recent.groupBy(F.date_trunc("minute", "valid_from").alias("minute"))
        .agg(_count())
        .withColumn("label", F.date_format("minute", "HH:mm"))
        .orderBy("minute")
    )


def chart_minutes(events: DataFrame, window: int = model.EVENT_WINDOW) -> DataFrame:
    """Newest events by HH:MM label; the same minute of different days is one bar."""
    recent = lookup.newest(events.select("id", "valid_from"), window)
    return (
        recent.groupBy(F.date_format("valid_from", "HH:mm").alias("label"))
        .agg(_count())
        .orderBy("label")
    )


def chart_agents(
    events: DataFrame, agents: DataFrame, window: int = model.EVENT_WINDOW
) -> DataFrame:
    """Newest events per named agent."""
    recent = lookup.newest(events.select("id", "valid_from", "agent"), window)
    counts = recent.where("agent is not null").groupBy("agent").agg(_count())
    names = agents.select(F.col("id").alias("agent"), "name")
    return counts.join(names, "agent").select("name", "value").orderBy(F.desc("value"), "name")


def boot_durations(
    events: DataFrame,
    window: int = model.EVENT_WINDOW,
    event: str = "boot_complete",
    field: str = "duration_ms",
    newest_first: bool = False,
) -> DataFrame:
    """Boot events of the newest window with their duration, labelled MM-DD HH:MM."""
    recent = lookup.newest(events, window).where(F.col("lifecycle_event") == event)
    value = J.int_field(F.col("payload"), field)
    order = [F.desc(c) if newest_first else F.asc(c) for c in _STAMP]
    return recent.orderBy(*order).select(
        "id",
        "valid_from",
        F.date_format("valid_from", "MM-dd HH:mm").alias("label"),
        F.coalesce(value, F.lit(0)).alias("value"),
    )


def message_roles(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(_count()).orderBy(F.desc("value"), "role")


def messages_per_day(messages: DataFrame) -> DataFrame:
    day = F.date_format(clock.event_time(), "yyyy-MM-dd").alias("day")
    return messages.groupBy(day).agg(_count()).orderBy("day")


def hour_weekday(messages: DataFrame) -> DataFrame:
    """Hour 0 to 23 by weekday 1 (Monday) to 7; empty cells are absent."""
    ts = clock.event_time()
    return messages.groupBy(
        F.hour(ts).alias("hour"), clock.iso_weekday(ts).alias("weekday")
    ).agg(_count())


def models(messages: DataFrame) -> DataFrame:
    named = messages.select(J.typed(F.col("raw"), J.MODEL_SCHEMA).alias("_raw")).select(
        J.model_name(F.col("_raw")).alias("model")
    )
    return (
        named.where("model is not null")
        .groupBy("model")
        .agg(_count())
        .orderBy(F.desc("value"), "model")
    )


def per_agent(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """Messages and output tokens per agent name; unknown agents are ``unattributed``.

    The names join after the aggregation, so only one row per agent is joined.
    """
    totals = (
        messages.select("agent", J.typed(F.col("raw"), J.USAGE_SCHEMA).alias("_raw"))
        .groupBy("agent")
        .agg(_count("messages"), F.sum(J.output_tokens(F.col("_raw"))).alias("output_tokens"))
    )
    names = agents.select(F.col("id").alias("agent"), "name")
    return (
        totals.join(names, "agent", "left")
        .groupBy(F.coalesce("name", F.lit("unattributed")).alias("name"))
        .agg(F.sum("messages").alias("messages"), F.sum("output_tokens").alias("output_tokens"))
        .orderBy(F.desc("messages"), "name")
    )


def event_kinds(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("lifecycle_event").agg(_count()).orderBy(F.desc("value"), "lifecycle_event")
    )


def module_startup(
    events: DataFrame,
    scan: int = model.STARTUP_SCAN,
    event: str = "module_active",
    name_field: str = "name",
    value_field: str = "startup_duration_ms",
) -> DataFrame:
    """Newest start-up reading per module over the newest ``scan`` readings."""
    readings = lookup.newest(events.where(F.col("lifecycle_event") == event), scan)
    payload = F.col("payload")
    named = readings.select(
        J.str_field(payload, name_field).alias("name"),
        F.coalesce(J.int_field(payload, value_field), F.lit(0)).alias("value"),
        *_STAMP,
    ).where("name is not null")
    return (
        named.groupBy("name")
        .agg(F.max_by("value", F.struct(*_STAMP)).alias("value"))
        .orderBy(F.desc("value"), "name")
    )


def capture_lag(events: DataFrame, now, recent: int = model.RECENT_SECONDS) -> DataFrame:
    """Whole seconds since the newest event, never negative, null when there is none."""
    at = clock.instant(now)
    newest = F.max("valid_from")
    cutoff = clock.minus_seconds(at, recent)
    return events.agg(
        newest.alias("_newest"), F.count_if(F.col("valid_from") > cutoff).alias("events_recent")
    ).select(
        F.when(
            F.col("_newest").isNotNull(),
            F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("_newest"), at)),
        ).alias("lag_seconds"),
        "events_recent",
    )


def session_message_stats(messages: DataFrame) -> DataFrame:
    """One row per session: count, last activity, tokens, context and model.

    All of it is one wide aggregation with map-side combine, so one session
    with very many messages is reduced where its messages lie.
    """
    raw, stamp = F.col("_raw"), F.struct(*_STAMP)
    parsed = messages.select(
        "session", "id", "valid_from", J.typed(F.col("raw"), J.USAGE_MODEL_SCHEMA).alias("_raw")
    ).select(
        "session",
        *_STAMP,
        J.output_tokens(raw).alias("_out"),
        J.context_tokens(raw).alias("_context"),
        J.bears_usage(raw).alias("_usage"),
        J.model_name(raw).alias("_model"),
    )
    return parsed.groupBy("session").agg(
        _count("messages"),
        F.max("valid_from").alias("last_active"),
        F.nullif(F.sum("_out"), F.lit(0)).alias("output_tokens"),
        F.max_by("_context", F.when(F.col("_usage"), stamp)).alias("context_tokens"),
        F.nullif(
            F.max_by("_model", F.when(F.col("_model").isNotNull(), stamp)), F.lit("")
        ).alias("model"),
    )


def session_tokens(messages: DataFrame) -> DataFrame:
    return session_message_stats(messages).select("session", "context_tokens", "output_tokens")


def session_model(messages: DataFrame) -> DataFrame:
    return session_message_stats(messages).select("session", "model").where("model is not null")


def session_key(payload: Column) -> Column:
    """``session`` of an event payload when it is a string."""
    return J.str_field(payload, "session")


def attributed_events(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(event id, session id) for every session an event belongs to, each pair once.

    An event belongs to the session that is its subject, and to the session
    with its agent and source key. Both arms are equi-joins; the second leaves
    out pairs the first has already given, so nothing needs de-duplicating.
    """
    e = events.select(
        "id", "subject", F.col("agent").alias("e_agent"), session_key(F.col("payload")).alias("key")
    )
    s = sessions.select(
        F.col("id").alias("session"), F.col("agent").alias("s_agent"), "source_key"
    )
    by_subject = e.join(s, e["subject"] == s["session"]).select("id", "session")
    by_key = (
        e.join(s, (e["e_agent"] == s["s_agent"]) & (e["key"] == s["source_key"]))
        .where(~F.col("subject").eqNullSafe(F.col("session")))
        .select("id", "session")
    )
    return by_subject.unionByName(by_key)


def session_action_counts(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events per session by the same rule, counted before joining.

    Events shrink to one row per (subject, agent, key) with map-side combine.
    An event matching both ways is counted once by leaving it out of the
    second arm, exactly as in :func:`attributed_events`.
    """
    grouped = (
        events.select(
            "subject",
            F.col("agent").alias("e_agent"),
            session_key(F.col("payload")).alias("key"),
        )
        .where("subject is not null or (e_agent is not null and key is not null)")
        .groupBy("subject", "e_agent", "key")
        .agg(_count("n"))
    )
    # Both arms read the counts; the events are scanned and parsed once.
    grouped = materialize(grouped)
    s = sessions.select(
        F.col("id").alias("session"), F.col("agent").alias("s_agent"), "source_key"
    )
    by_subject = grouped.groupBy("subject").agg(F.sum("n").alias("n"))
    first = by_subject.join(s, F.col("subject") == F.col("session")).select("session", "n")
    second = (
        grouped.join(
            s, (F.col("e_agent") == F.col("s_agent")) & (F.col("key") == F.col("source_key"))
        )
        .where(~F.col("subject").eqNullSafe(F.col("session")))
        .select("session", "n")
    )
    return first.unionAll(second).groupBy("session").agg(F.sum("n").alias("actions"))


def session_counters(messages: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages, actions and last activity of every named session."""
    m = messages.groupBy("session").agg(
        _count("messages"), F.max("valid_from").alias("last_active")
    )
    a = session_action_counts(events, sessions)
    return (
        sessions.select(F.col("id").alias("session"))
        .join(m, "session", "left")
        .join(a, "session", "left")
        .select(
            "session",
            F.coalesce("messages", F.lit(0)).alias("messages"),
            F.coalesce("actions", F.lit(0)).alias("actions"),
            "last_active",
        )
    )


def sessions_view(
    messages: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    context_window: int | DataFrame = model.CONTEXT_WINDOW,
    agent_name: str | None = None,
) -> DataFrame:
    """The sessions page: two aggregations joined to the named sessions.

    ``actions`` counts messages and events together. ``context_window`` is a
    number or the one-row frame of :func:`lookup.positive_parameter`.
    """
    chosen = sessions if agent_name is None else sessions.where(F.col("agent_name") == agent_name)
    stats = session_message_stats(messages)
    actions = session_action_counts(events, chosen)
    if isinstance(context_window, DataFrame):
        window = context_window.select(F.col("value")).scalar()
    else:
        window = F.lit(context_window)
    rows = (
        chosen.select(F.col("id").alias("session"), "agent_name", "source_key")
        .join(stats, "session", "left")
        .join(actions, "session", "left")
    )
    counted = F.coalesce("messages", F.lit(0)) + F.coalesce("actions", F.lit(0))
    return rows.select(
        "session",
        F.concat_ws("/", F.col("agent_name"), X.short_id(F.col("session"))).alias("identity"),
        F.col("agent_name").alias("agent"),
        "source_key",
        counted.alias("actions"),
        "context_tokens",
        X.context_percent(F.col("context_tokens"), window).alias("context_pct"),
        "output_tokens",
        "last_active",
        "model",
    )


def session_listing(
    messages: DataFrame, sessions: DataFrame, agent_name: str | None = None
) -> DataFrame:
    chosen = sessions if agent_name is None else sessions.where(F.col("agent_name") == agent_name)
    counts = messages.groupBy("session").agg(_count("messages"))
    return chosen.join(counts, chosen["id"] == counts["session"], "left").select(
        F.concat_ws("/", F.col("agent_name"), F.col("id").cast("string")).alias("identity"),
        "source_key",
        F.coalesce("messages", F.lit(0)).alias("messages"),
    )


def session_order(view: DataFrame, now) -> DataFrame:
    """Sessions by liveness, then newest, then busiest."""
    live = X.liveness(F.col("last_active"), clock.instant(now))
    return (
        view.withColumn("liveness", live)
        .withColumn("rank", X.liveness_rank(F.col("liveness")))
        .orderBy("rank", F.desc("last_active"), F.desc("actions"), "session")
    )


def agent_directory(agents: DataFrame, sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sources and sessions per agent, read from ``<agent>/...`` names; zeros show."""

    def per_agent_count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(X.agent_of(F.col("name")).alias("name")).agg(_count(name))

    return (
        agents.select("id", "name")
        .join(per_agent_count(sources, "sources"), "name", "left")
        .join(per_agent_count(sessions, "sessions"), "name", "left")
        .select(
            "id",
            "name",
            F.coalesce("sources", F.lit(0)).alias("sources"),
            F.coalesce("sessions", F.lit(0)).alias("sessions"),
        )
    )


def health_ratios(tokens: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Cache hit and failure percent; null when there is nothing to divide by.

    Takes the one-row token totals and the per-tool outcomes. Each side is an
    aggregate of one row; the two are lined up by a union, not a join.
    """
    none = F.lit(None).cast("bigint")
    t = tokens.select(
        F.col("cache_read").alias("read"),
        F.expr("input + cache_read + cache_write").alias("asked"),
        none.alias("failed"),
        none.alias("scored"),
    )
    o = outcomes.agg(
        F.sum("failed").alias("failed"), F.sum(F.expr("ok + failed + cancelled")).alias("scored")
    ).select(none.alias("read"), none.alias("asked"), "failed", "scored")
    both = t.unionAll(o).agg(*[F.max(c).alias(c) for c in ("read", "asked", "failed", "scored")])
    # Halves round up for positive numbers, as in round().
    return both.select(
        F.round(100 * F.col("read") / F.nullif("asked", F.lit(0))).cast("bigint").alias("cache_hit"),
        (F.round(1000 * F.col("failed") / F.nullif("scored", F.lit(0))) / 10).alias("fail_rate"),
    )


def firing_summary(runs: DataFrame, order=versioned.ORDER) -> DataFrame:
    """done, failed, tasks seen and a cancelled flag per firing, from current runs."""
    current = versioned.latest_by(runs, ["uid"], order, ("firing", "task", "status"))
    status = F.col("status")
    return current.groupBy("firing").agg(
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "failed").alias("failed"),
        F.count_distinct("task").alias("tasks_seen"),
        F.coalesce(F.bool_or(status == "cancelled"), F.lit(False)).alias("cancelled"),
    )


def top(rows: DataFrame, limit: int, value: str = "value", name: str = "name") -> DataFrame:
    """The first rows for display; ties by name."""
    return rows.orderBy(F.desc(value), name).limit(limit)
