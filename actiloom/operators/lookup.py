"""Filters, point lookups, fragment resolution, keyword search and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from ..functions import text as X
from . import ordered, versioned


def find_type(types: DataFrame, uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Types of the wanted uids: (found, missing). The strict form refuses ``missing``."""
    return uids.join(types, "uid"), uids.join(types, "uid", "left_anti")


def named_state(ledger: DataFrame, attr_type: str | None = None) -> DataFrame:
    """Current descriptors with their ``name`` read out."""
    rows = ledger if attr_type is None else ledger.where(F.col("type") == attr_type)
    return versioned.current_state(rows).withColumn(
        "name", J.str_field(F.col("payload"), "name")
    )


def find_by_current_name(
    entities: DataFrame, ledger: DataFrame, attr_type: str, entity_type: str | None = None
) -> DataFrame:
    """name -> entity for every name ever used.

    The newest ledger row carrying a name decides its target; the name only
    resolves if the target's current descriptor still carries it, also when an
    older target would have matched.
    """
    chosen = entities if entity_type is None else entities.where(F.col("type") == entity_type)
    ids = chosen.select(F.col("id").alias("target"))
    rows = ledger.where(F.col("type") == attr_type).join(ids, "target", "left_semi")
    return resolving_names(rows).select("name", "target")


def resolving_names(ledger: DataFrame) -> DataFrame:
    """(type, name, target) of the names of each descriptor type that still resolve."""
    named = ledger.withColumn("name", J.str_field(F.col("payload"), "name"))
    newest_row = F.struct("valid_from", "id")
    claims = (
        named.where("name is not null")
        .groupBy("type", "name")
        .agg(F.max_by("target", newest_row).alias("target"))
    )
    current = named.groupBy("type", "target").agg(
        F.max_by(F.struct("name"), newest_row).alias("now")
    )
    return claims.join(current, ["type", "target"]).where("name = now.name").select("type", "name", "target")


def list_named(entities: DataFrame, ledger: DataFrame, attr_type: str) -> DataFrame:
    """Entities with their current descriptor; those without one are left out."""
    state = named_state(ledger, attr_type).select("target", "name", "payload")
    return entities.join(state, entities["id"] == state["target"]).select(
        "id", entities["type"], "name", "payload"
    )


def resolve_fragments(
    df: DataFrame, id_column: str, texts: Sequence[Column], fragments: Sequence[str]
) -> DataFrame:
    """What each typed fragment matches: ``found`` (with its id), ``ambiguous`` or ``unknown``.

    A row matches when any text contains the fragment; an exact match does not
    outrank a substring. The fragments are the caller's few arguments, so one
    scan tests them all; no pair of tables is joined on ``contains``.
    """
    wanted = list(dict.fromkeys(fragments))
    hit = lambda q: reduce(lambda a, b: a | b, [F.contains(t, q) for t in texts])
    queries = F.array(*[F.lit(q) for q in wanted])
    hits = df.select(
        F.col(id_column).alias("_id"), F.explode(F.filter(queries, hit)).alias("fragment")
    )
    counted = hits.groupBy("fragment").agg(
        F.count(F.lit(1)).alias("matches"), F.min("_id").alias("_only")
    )
    asked = df.sparkSession.createDataFrame([(q,) for q in wanted], "fragment string")
    matches = F.coalesce("matches", F.lit(0))
    return asked.join(counted, "fragment", "left").select(
        "fragment",
        matches.alias("matches"),
        F.when(matches == 0, "unknown")
        .when(matches == 1, "found")
        .otherwise("ambiguous")
        .alias("outcome"),
        F.when(matches == 1, F.col("_only")).alias("id"),
    )


def resolve_sessions(sessions: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Sessions (id, agent, name) by name or by ``<agent>/<id>``."""
    identity = F.concat_ws("/", F.col("agent"), F.col("id").cast("string"))
    return resolve_fragments(sessions, "id", [F.col("name"), identity], fragments)


def resolve_module(modules: DataFrame, query: str) -> DataFrame:
    """A module by exact name first, else by the first id containing the text."""
    exact = F.col("name") == query
    hits = modules.where(exact | F.contains(F.col("uid").cast("string"), F.lit(query)))
    return hits.orderBy(F.when(exact, 0).otherwise(1), "uid").limit(1)


def keyword(raw: str | None) -> str | None:
    """A lower-cased keyword, None for a blank one."""
    text = (raw or "").strip()
    return text.lower() or None


def message_match(q: str) -> Column:
    return F.contains(F.lower("content"), F.lit(q))


def event_match(q: str) -> Column:
    """The event name or one of the searched payload fields contains ``q``.

    One typed parse reads just the searched fields; a payload that is no
    object yields none of them.
    """
    schema = ", ".join(f"`{f}` variant" for f in model.SEARCHED_FIELDS)

    def any_field(payload: Column) -> Column:
        texts = [F.lower(F.coalesce(J.as_str(payload[f]), F.lit(""))) for f in model.SEARCHED_FIELDS]
        return reduce(lambda a, b: a | b, [F.contains(t, F.lit(q)) for t in texts])

    # A field can only contain the keyword if the JSON text does, or if it may
    # hide it behind an escape; other payloads are not parsed at all.
    text = F.col("payload")
    possible = F.contains(F.lower(text), F.lit(q)) | F.contains(text, F.lit("\\"))
    return (
        F.when(F.contains(F.lower("lifecycle_event"), F.lit(q)), True)
        .when(possible, F.coalesce(J.let(J.typed(text, schema), any_field), F.lit(False)))
        .otherwise(False)
    )


def search_messages(messages: DataFrame, raw_keyword: str | None) -> DataFrame:
    q = keyword(raw_keyword)
    return messages if q is None else messages.where(message_match(q))


def search_events(events: DataFrame, raw_keyword: str | None) -> DataFrame:
    q = keyword(raw_keyword)
    return events if q is None else events.where(event_match(q))


def page_limit(limit: int | None) -> int:
    """The rows asked for; without a number the usual page."""
    return max(0, model.FEED_DEFAULT if limit is None else int(limit))


def request_limit(limit: int | None) -> int:
    """``page_limit`` for a number that a remote caller sent: larger ones mean the largest page."""
    return min(page_limit(limit), model.FEED_MAX)


def before_mark(df: DataFrame, before=None, before_id=None) -> DataFrame:
    """Rows older than a mark. With an id, rows sharing the mark's instant are not skipped."""
    if before is None:
        return df
    ts, mark = F.col("valid_from"), clock.mark(df, before)
    if before_id is None:
        return df.where(ts < mark)
    return df.where((ts <= mark) & ((ts < mark) | (F.col("id") < F.lit(before_id))))


def newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("valid_from"), F.desc("id")).limit(limit)


def cut_to_newest(df: DataFrame, limit: int) -> DataFrame:
    """Only rows that can be among the newest ``limit``, ties included.

    A first pass over the time column alone finds the oldest time of the
    newest rows; with it as a filter, the wide columns are read from the few
    files and row groups that reach it instead of from the whole table.
    """
    times = df.select("valid_from").orderBy(F.desc("valid_from")).limit(limit)
    oldest = times.agg(F.min("valid_from")).first()[0]
    if oldest is None:
        return df
    return df.where(F.col("valid_from") >= clock.mark(df, oldest))


def page(
    df: DataFrame,
    scope: Column | None = None,
    before=None,
    match: Column | None = None,
    limit: int | None = None,
    before_id=None,
) -> DataFrame:
    """One page, newest first; absent clauses are left out of the plan."""
    rows = before_mark(df, before, before_id)
    if scope is not None:
        rows = rows.where(scope)
    if match is not None:
        rows = rows.where(match)
    return newest(rows, page_limit(limit))


def since(df: DataFrame, after, limit: int, scope: Column | None = None) -> DataFrame:
    """Rows strictly newer than a mark, oldest first."""
    rows = df.where(F.col("valid_from") > clock.mark(df, after))
    if scope is not None:
        rows = rows.where(scope)
    return rows.orderBy("valid_from", "id").limit(limit)


def agent_newest(df: DataFrame, limit: int, agent=None) -> DataFrame:
    """The newest rows of one agent, or of every agent at once."""
    if agent is not None:
        return newest(df.where(F.col("agent") == F.lit(agent)), limit)
    return ordered.newest_per_key(df, ["agent"], versioned.ORDER, limit)


def transcript(messages: DataFrame, session, limit: int | None = None) -> DataFrame:
    """One session's messages, oldest first; all of them or the first ``limit``."""
    rows = messages.where(F.col("session") == F.lit(session)).orderBy("valid_from", "id")
    return rows if limit is None else rows.limit(limit)


def high_water(df: DataFrame) -> DataFrame:
    return df.agg(F.max("valid_from").alias("high_water"))


def recent(events: DataFrame, limit: int, agent=None) -> DataFrame:
    """The newest events, shown oldest first."""
    rows = events if agent is None else events.where(F.col("agent") == F.lit(agent))
    return newest(rows, limit).orderBy("valid_from", "id")


def entity_list(
    anchors: DataFrame,
    states: DataFrame,
    entity_type: str | None = None,
    hide_text: bool = False,
) -> DataFrame:
    """Anchors with current labels, newest created first."""
    rows = anchors
    if entity_type is not None:
        rows = rows.where(F.col("entity_type") == entity_type)
    elif hide_text:
        rows = rows.where(F.col("entity_type") != "text")
    now = versioned.latest_by(states, ["entity"], columns=("name", "valid_from")).select(
        F.col("entity").alias("id"), "name", F.col("valid_from").alias("version")
    )
    return (
        rows.join(now, "id", "left")
        .select("id", "entity_type", F.coalesce("name", F.lit("")).alias("name"), "created_at", "version")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def list_search(rows: DataFrame, q: str, name: str = "name", id_column: str = "id") -> DataFrame:
    """Case-insensitive on the name, case-sensitive on the id."""
    in_name = F.contains(F.lower(name), F.lit(q.lower()))
    return rows.where(in_name | F.contains(F.col(id_column).cast("string"), F.lit(q)))


def type_list(types: DataFrame) -> DataFrame:
    return types.orderBy("category", "name")


def entity_kinds(types: DataFrame) -> DataFrame:
    """Entity kinds; ``text`` is a system kind."""
    return (
        types.where("category = 'entity'")
        .select("name", "description", (F.col("name") == "text").alias("system"))
        .orderBy("name")
    )


def relation_names(types: DataFrame) -> DataFrame:
    return types.where("category = 'relation'").select("name").orderBy("name")


def anchor_info(anchors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type and creation time of wanted anchors: (found, missing)."""
    wanted = ids.select("id").distinct()
    return wanted.join(anchors, "id"), wanted.join(anchors, "id", "left_anti")


def parameter(ledger: DataFrame, target, param: str) -> DataFrame:
    """Current ``{value}`` of one parameter; ``corrupt`` when the value is missing.

    No row means the parameter was never set.
    """
    rows = ledger.where((F.col("target") == F.lit(target)) & (F.col("type") == param))
    current = versioned.current_state(rows).withColumn("value", J.field(F.col("payload"), "value"))
    return current.select("target", "type", "value", F.col("value").isNull().alias("corrupt"))


def positive_parameter(ledger: DataFrame, param: str, default: int) -> DataFrame:
    """One row: the current positive number of a parameter, else its default."""
    rows = ledger.where(F.col("type") == param)
    newest_payload = F.max_by("payload", F.struct("valid_from", "id"))
    number = rows.agg(newest_payload.alias("payload")).select(
        J.int_field(F.col("payload"), "value").alias("value")
    )
    return number.select(F.when(F.col("value") > 0, F.col("value")).otherwise(default).alias("value"))


def parameter_rows(requests: DataFrame, now: Column) -> DataFrame:
    """Ledger rows for (target, type, value) requests; ``value`` is JSON text."""
    payload = F.concat(F.lit('{"value":'), F.col("value"), F.lit("}"))
    return versioned.supersede(requests.select("target", "type", payload.alias("payload")), now)


def feed_label() -> Column:
    """Role for messages, ``action`` for events."""
    return F.when(F.col("kind") == "message", F.coalesce("role", F.lit("message"))).otherwise(
        "action"
    )


def filter_by_label(feed: DataFrame, label: str | None) -> DataFrame:
    """Rows of one label; a label no row has falls back to all rows."""
    if label is None:
        return feed
    labelled = feed.withColumn("_label", feed_label())
    present = not labelled.where(F.col("_label") == label).isEmpty()
    return (labelled.where(F.col("_label") == label) if present else labelled).drop("_label")


def feed_labels(feed: DataFrame) -> DataFrame:
    return feed.select(feed_label().alias("label")).distinct().orderBy("label")


def session_names(sessions: DataFrame) -> DataFrame:
    """Agent and source key read from ``<agent>/<key>`` names."""
    return sessions.withColumns(
        {"agent_name": X.agent_of(F.col("name")), "source_key": X.source_key_of(F.col("name"))}
    )
