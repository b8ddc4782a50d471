"""From routed lines to table rows: identities, discovery, messages, events, cursors.

Identities are named ``<agent>``, ``<agent>/<source>`` and ``<agent>/<session>``.
A name that already resolves keeps its entity; a new one gets an id computed
from the name, and rows get ids computed from their position, so running the
same batch twice writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonval as J
from ..operators import lookup
from . import lines as L
from . import shape2
from .adapters import Adapter, announcements

KINDS = {
    "agent": ("node_agent", "attr_agent_descriptor"),
    "source": ("node_source", "attr_source_descriptor"),
    "session": ("node_session", "attr_session_descriptor"),
}


def identity(kind: str, name: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit(f"{kind}:"), name), 256), F.lit(32))


def row_id(prefix: str) -> Column:
    """Sorts by file and position, so rows of one instant keep their order."""
    return F.concat_ws(
        "-",
        F.lit(prefix),
        F.left(F.sha2("file", 256), F.lit(16)),
        _padded("offset", 16),
        _padded("nth", 6),
    )


def _padded(column: str, width: int) -> Column:
    """A number with leading zeros; a longer one stays whole."""
    text = F.col(column).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def current_names(ledger: DataFrame) -> DataFrame:
    """(kind, name, id) of every name that resolves, by the rule of ``lookup.find_by_current_name``."""
    attrs = {attr: kind for kind, (_, attr) in KINDS.items()}
    kinds = F.create_map(*[F.lit(x) for pair in attrs.items() for x in pair])
    found = lookup.resolving_names(ledger.where(F.col("type").isin(list(attrs))))
    return found.select(kinds[F.col("type")].alias("kind"), "name", F.col("target").alias("id"))


def file_summary(lines: DataFrame) -> DataFrame:
    """One row per file of a batch: where its reading ends and what a cap skipped."""
    return lines.groupBy("file").agg(
        F.max("next").alias("next"),
        F.max("skipped").alias("skipped"),
        F.min("offset").alias("offset"),
    )


def candidates(files: DataFrame, messages: DataFrame, adapter: Adapter) -> DataFrame:
    """Agent, sources and sessions a batch names: (kind, name, details as JSON)."""
    file = F.col("file")
    scoped = lambda key: F.concat(F.lit(f"{adapter.agent}/"), key)
    sources = files.groupBy(adapter.source_name(file).alias("key")).agg(
        F.min(adapter.locator(file)).alias("locator")
    )
    sessions = messages.groupBy(F.col("session_key").alias("key")).agg(
        F.min("file").alias("locator")
    )
    about = {"adapter": F.lit(adapter.name)}
    agent = sources.select(
        F.lit("agent").alias("kind"),
        F.lit(adapter.agent).alias("name"),
        F.to_json(F.struct(F.lit(adapter.agent).alias("name"), about["adapter"].alias("adapter"))).alias("descriptor"),
        F.to_json(F.struct(F.lit(adapter.agent).alias("agent"))).alias("announcement"),
    ).distinct()
    source = sources.select(
        F.lit("source").alias("kind"),
        scoped(F.col("key")).alias("name"),
        F.to_json(
            F.struct(
                scoped(F.col("key")).alias("name"),
                "locator",
                about["adapter"].alias("adapter"),
            )
        ).alias("descriptor"),
        F.to_json(F.struct(scoped(F.col("key")).alias("source"), "locator")).alias("announcement"),
    )
    session = sessions.select(
        F.lit("session").alias("kind"),
        scoped(F.col("key")).alias("name"),
        F.to_json(
            F.struct(scoped(F.col("key")).alias("name"), F.col("key").alias("session"), "locator")
        ).alias("descriptor"),
        F.to_json(
            F.struct(F.col("key").alias("session"), scoped(F.col("key")).alias("name"))
        ).alias("announcement"),
    )
    return agent.unionByName(source).unionByName(session)


def resolve(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``id`` and ``created``: an existing name keeps its entity."""
    known = current_names(ledger).withColumnRenamed("id", "_known")
    new_id = (
        F.when(F.col("kind") == "agent", identity("agent", F.col("name")))
        .when(F.col("kind") == "source", identity("source", F.col("name")))
        .otherwise(identity("session", F.col("name")))
    )
    return wanted.join(known, ["kind", "name"], "left").select(
        *wanted.columns,
        F.coalesce("_known", new_id).alias("id"),
        F.col("_known").isNull().alias("created"),
    )


def agent_id(resolved: DataFrame) -> Column:
    """The id of the one agent that a batch's identities belong to."""
    return resolved.where("kind = 'agent'").agg(F.max("id").alias("id")).scalar()


def _by_kind(place: int) -> Column:
    pairs = [F.lit(x) for kind, names in KINDS.items() for x in (kind, names[place])]
    return F.create_map(*pairs)[F.col("kind")]


def discovery_rows(
    resolved: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity, state_ledger, telemetry) rows for identities met for the first time."""
    fresh = resolved.where("created")
    entities = fresh.select("id", _by_kind(0).alias("type"), now.alias("valid_from"))
    ledger = fresh.select(
        F.concat(F.lit("st-"), "id").alias("id"),
        F.col("id").alias("target"),
        _by_kind(1).alias("type"),
        F.col("descriptor").alias("payload"),
        now.alias("valid_from"),
    )
    telemetry = fresh.select(
        F.concat(F.lit("dc-"), "id").alias("id"),
        F.concat("kind", F.lit("_discovered")).alias("lifecycle_event"),
        F.col("announcement").alias("payload"),
        F.col("id").alias("subject"),
        agent_id(resolved).alias("agent"),
        now.alias("valid_from"),
    )
    return entities, ledger, telemetry


def message_rows(
    messages: DataFrame, resolved: DataFrame, adapter: Adapter, now: Column
) -> DataFrame:
    """Rows of the message table."""
    sessions = resolved.where("kind = 'session'").select(
        F.col("name").alias("_name"), F.col("id").alias("_session")
    )
    name = F.concat(F.lit(f"{adapter.agent}/"), "session_key")
    return (
        messages.withColumn("_name", name)
        .join(sessions, "_name", "left")
        .select(
            row_id("m").alias("id"),
            F.coalesce("_session", identity("session", F.col("_name"))).alias("session"),
            agent_id(resolved).alias("agent"),
            "role",
            "content",
            "raw",
            F.lit(None).cast("bigint").alias("seq"),
            "emitted_at",
            now.alias("valid_from"),
        )
    )


def event_rows(
    events: DataFrame, resolved: DataFrame, adapter: Adapter, now: Column
) -> DataFrame:
    """Rows of the telemetry table; the subject is the session or the source."""
    ids = resolved.where("kind <> 'agent'").select(
        F.col("kind").alias("about"), F.col("name").alias("_name"), F.col("id").alias("subject")
    )
    key = F.when(F.col("about") == "session", F.col("session_key")).otherwise(
        adapter.source_name(F.col("file"))
    )
    return (
        events.withColumn("_name", F.concat(F.lit(f"{adapter.agent}/"), key))
        .join(ids, ["about", "_name"], "left")
        .select(
            row_id("e").alias("id"),
            "lifecycle_event",
            "payload",
            "subject",
            agent_id(resolved).alias("agent"),
            now.alias("valid_from"),
        )
    )


def cursor_rows(
    files: DataFrame, events: DataFrame, resolved: DataFrame, adapter: Adapter, batch: str, now: Column
) -> DataFrame:
    """One cursor row per file that moved: its new offset and the events it gave."""
    counts = events.groupBy("file").agg(F.count(F.lit(1)).alias("_events"))
    sources = resolved.where("kind = 'source'").select(
        F.col("name").alias("_name"), F.col("id").alias("subject")
    )
    name = F.concat(F.lit(f"{adapter.agent}/"), adapter.source_name(F.col("file")))
    return (
        files.join(counts, "file", "left")
        .withColumn("_name", name)
        .join(sources, "_name", "left")
        .select(
            F.concat_ws("-", F.lit("c"), F.left(F.sha2("file", 256), F.lit(16)), F.lit(batch)).alias("id"),
            "subject",
            F.lit(adapter.name).alias("cursor_type"),
            F.coalesce("_events", F.lit(0)).cast("string").alias("last_processed"),
            F.create_map("file", "next").alias("metadata"),
            now.alias("valid_from"),
        )
    )


def latest_offsets(cursors: DataFrame) -> DataFrame:
    """Newest offset per (subject, cursor type, file); an unknown type has no rows."""
    each = cursors.select(
        "subject", "cursor_type", F.explode("metadata").alias("file", "offset"), "valid_from", "id", "last_processed"
    )
    return each.groupBy("subject", "cursor_type", "file").agg(
        F.max_by(F.struct("offset", "last_processed", "valid_from"), F.struct("valid_from", "id")).alias("_n")
    ).select("subject", "cursor_type", "file", "_n.*")


def latest_cursor(cursors: DataFrame) -> DataFrame:
    """Newest cursor row per (subject, cursor type)."""
    from ..operators import versioned

    return versioned.latest_by(cursors, ["subject", "cursor_type"])


def enabled_sources(
    sources: DataFrame, modules: DataFrame, ledger: DataFrame
) -> DataFrame:
    """Sources (with ``adapter``) whose adapter is not disabled; never set means enabled.

    ``modules`` maps an adapter name to its entity (name, id).
    """
    status = lookup.versioned.current_state(ledger.where("type = 'attr_module_status'")).select(
        F.col("target").alias("_target"),
        J.str_field(F.col("payload"), "status").alias("_status"),
    )
    named = modules.select(F.col("name").alias("adapter"), F.col("id").alias("_module"))
    return (
        sources.join(named, "adapter", "left")
        .join(status, F.col("_module") == F.col("_target"), "left")
        .where(F.coalesce("_status", F.lit("enabled")) != "disabled")
        .select(*sources.columns)
    )


def capture(
    lines: DataFrame,
    adapter: Adapter,
    ledger: DataFrame,
    now: Column,
    batch: str = "0",
    headers: DataFrame | None = None,
    seen: DataFrame | None = None,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """All rows one batch of lines adds, by table.

    ``hold`` may cache frames that several tables are made from, so a stream
    parses every line once. The lines themselves are never cached: they are
    read for their files' summary and for what they become.
    """
    mine = lines.where(adapter.accepts(F.col("file")))
    files = hold(file_summary(mine))
    routed = hold(adapter.route(mine, headers, seen, hold))
    messages = L.messages(routed)
    events = L.events(routed).unionByName(announcements(files))
    resolved = hold(resolve(candidates(files, messages, adapter), ledger))
    entities, states, discovered = discovery_rows(resolved, now)
    out = {
        "message": message_rows(messages, resolved, adapter, now),
        "telemetry_stream": event_rows(events, resolved, adapter, now).unionByName(discovered),
        "entity": entities,
        "state_ledger": states,
        "cursor": cursor_rows(files, events, resolved, adapter, batch, now),
    }
    if "is_header" in routed.columns:
        out["chat_header"] = shape2.headers_of(routed).withColumn("valid_from", now)
    return out


def report(telemetry: DataFrame, ledger: DataFrame) -> DataFrame:
    """Captured and failed counts per subject with its name."""
    names = current_names(ledger).select(F.col("id").alias("subject"), "name")
    failed = F.col("lifecycle_event") == "capture_error"
    return (
        telemetry.groupBy("subject")
        .agg(F.count_if(~failed).alias("captured"), F.count_if(failed).alias("errors"))
        .join(names, "subject", "left")
        .select("name", "captured", "errors")
    )
