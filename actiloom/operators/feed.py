"""The merged activity feed: one row shape for messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from ..functions import text as X
from ..session import written
from . import analytics, lookup, skew

# Feed order. Times can tie across and inside the two tables.
NEWEST = ("valid_from", "kind", "id")


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in NEWEST]).limit(limit)


def message_rows(messages: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return messages.select(
        F.lit("message").alias("kind"),
        F.col("id").cast("string").alias("id"),
        "valid_from",
        F.col("session").cast("string").alias("session_id"),
        none.alias("session_src"),
        F.col("agent").cast("string").alias("agent_id"),
        "role",
        none.alias("event"),
        F.col("content").alias("body"),
        "raw",
        none.alias("payload"),
    )


def event_rows(events: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return events.select(
        F.lit("action").alias("kind"),
        F.col("id").cast("string").alias("id"),
        "valid_from",
        none.alias("session_id"),
        analytics.session_key(F.col("payload")).alias("session_src"),
        F.col("agent").cast("string").alias("agent_id"),
        none.alias("role"),
        F.col("lifecycle_event").alias("event"),
        none.alias("body"),
        none.alias("raw"),
        "payload",
    )


def merge_newest(message_side: DataFrame, event_side: DataFrame, limit: int) -> DataFrame:
    """The newest rows of both sides. Each side is limited before the union,
    so at most twice ``limit`` rows meet in the final sort."""
    n = lookup.page_limit(limit)
    merged = _newest(message_side, n).unionByName(_newest(event_side, n))
    return _newest(merged, n)


def rendered(rows: DataFrame) -> DataFrame:
    """Feed rows with their text line, oldest first. Apply after the limit:
    only surviving rows are parsed and rendered."""
    summary = X.tool_summary(J.typed(F.col("raw"), J.TOOLS_SCHEMA))
    line = F.when(
        F.col("kind") == "message",
        X.render_message(F.col("valid_from"), F.col("role"), F.col("body"), summary),
    ).otherwise(
        X.render_event(F.col("valid_from"), F.col("event"), X.payload_summary(F.col("payload")))
    )
    return rows.select(
        "kind", "id", "valid_from", "session_id", "session_src", "agent_id", "role", "event",
        line.alias("text"),
    ).orderBy(*NEWEST)


def _sides(
    messages: DataFrame, events: DataFrame, before, q: str | None, limit: int
) -> tuple[DataFrame, DataFrame]:
    m, e = lookup.before_mark(messages, before), lookup.before_mark(events, before)
    if lookup.keyword(q) is None:
        n = lookup.page_limit(limit)
        m, e = lookup.cut_to_newest(m, n), lookup.cut_to_newest(e, n)
    else:
        m, e = lookup.search_messages(m, q), lookup.search_events(e, q)
    return message_rows(m), event_rows(e)


def global_feed(
    messages: DataFrame,
    events: DataFrame,
    limit: int = model.FEED_DEFAULT,
    before=None,
    q: str | None = None,
) -> DataFrame:
    """Everything, newest kept: optional time mark and keyword reach the scans."""
    return merge_newest(*_sides(messages, events, before, q, limit), limit)


def session_scope(events: DataFrame, sessions: DataFrame, session) -> DataFrame:
    """Events of one session: its subject, or its agent together with its source key.

    ``sessions`` is reduced to the one row asked for, so joining its agent and
    key is a one-row lookup. Without that row only the subject arm applies.
    """
    target = F.lit(session)
    one = sessions.where(F.col("id") == target).select(
        F.col("agent").alias("_agent"), F.col("source_key").alias("_key")
    ).limit(1)
    keyed = events.withColumn("_session_key", analytics.session_key(F.col("payload")))
    by_subject = events.where(F.col("subject") == target)
    by_key = keyed.join(
        F.broadcast(one),
        (F.col("agent") == F.col("_agent")) & (F.col("_session_key") == F.col("_key")),
        "left_semi",
    ).where(~F.col("subject").eqNullSafe(target))
    return by_subject.unionByName(by_key.select(*events.columns))


def session_feed(
    messages: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    session,
    limit: int = model.FEED_DEFAULT,
    before=None,
    q: str | None = None,
) -> DataFrame:
    """One session's messages and events; global events never appear."""
    m = messages.where(F.col("session") == F.lit(session))
    return merge_newest(*_sides(m, session_scope(events, sessions, session), before, q, limit), limit)


def next_page(
    messages: DataFrame,
    events: DataFrame,
    limit: int = model.HISTORY_PAGE,
    mark: tuple | None = None,
) -> DataFrame:
    """A page strictly older than (valid_from, kind, id), so ties are never lost."""

    def older(rows: DataFrame) -> DataFrame:
        if mark is None:
            return rows
        ts = clock.mark(rows, mark[0])
        kind, key = F.lit(mark[1]), F.lit(mark[2])
        # The plain comparison on the time alone is what the scan can skip by.
        return rows.where(
            (F.col("valid_from") <= ts)
            & (F.struct(*NEWEST) < F.struct(ts.alias("valid_from"), kind.alias("kind"), key.alias("id")))
        )

    n = lookup.page_limit(limit)
    return merge_newest(
        lookup.cut_to_newest(older(message_rows(messages)), n),
        lookup.cut_to_newest(older(event_rows(events)), n),
        n,
    )


def merge_live(backlog: DataFrame, live: DataFrame, cap: int | None = model.LIVE_CAP) -> DataFrame:
    """Backlog and live rows by id, the backlog copy winning; the newest ``cap`` (None: all), oldest first.

    The winner per id is an aggregate with map-side combine.
    """
    ranked = backlog.withColumn("_from", F.lit(0)).unionByName(live.withColumn("_from", F.lit(1)))
    rest = [c for c in backlog.columns if c != "id"]
    kept = (
        ranked.groupBy("id")
        .agg(F.min_by(F.struct(*rest), F.struct("_from", "valid_from")).alias("_row"))
        .select("id", "_row.*")
        .select(*backlog.columns)
    )
    order = [c for c in ("valid_from", "id") if c in backlog.columns]
    if cap is not None:
        kept = kept.orderBy(*[F.desc(c) for c in order]).limit(cap)
    return kept.orderBy(*order)


def directory(sessions_view: DataFrame) -> DataFrame:
    """Two lookup keys per session: the source key and the older ``<agent>/<key>`` form."""
    both = F.array("source_key", F.concat_ws("/", F.col("agent"), F.col("source_key")))
    return sessions_view.select(
        F.col("session").cast("string").alias("d_session"),
        F.col("agent").alias("d_agent"),
        F.col("model").alias("d_model"),
        F.explode(both).alias("d_key"),
    )


#: What a feed row's session depends on.
WHO = ("kind", "session_id", "session_src", "agent_id")


def attribute(feed: DataFrame, sessions_view: DataFrame, agents: DataFrame) -> DataFrame:
    """Feed rows with the session they belong to and its label.

    Sessions are found for the distinct senders, which tasks combine before
    anything moves, and joined back to the rows. A sender of very many rows gets
    its answer by broadcast, so these rows and their contents stay where they are.
    """
    senders = feed.select(*WHO).distinct()
    return skew.join_apart(feed, written(attribute_senders(senders, sessions_view, agents), "senders"), WHO)


def attribute_senders(senders: DataFrame, sessions_view: DataFrame, agents: DataFrame) -> DataFrame:
    """Per sender (the columns ``WHO``) the ``label`` and ``key`` of its session.

    Messages go by session id, events by source key. Of several sessions with
    one key the one whose agent the event names wins, else the first.
    Candidates are reduced to one per key and one per (key, agent) before the
    join, so no event is ever multiplied.
    """
    view = sessions_view.select(
        F.col("session").cast("string").alias("d_session"),
        F.col("agent").alias("d_agent"),
        F.col("model").alias("d_model"),
    )
    keys = directory(sessions_view)
    candidate = F.struct("d_session", "d_agent", "d_model")
    first = keys.groupBy("d_key").agg(
        F.min_by(candidate, "d_session").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    named = keys.groupBy(F.col("d_key").alias("n_key"), F.col("d_agent").alias("n_agent")).agg(
        F.min_by(candidate, "d_session").alias("_named")
    )
    names = agents.select(F.col("id").cast("string").alias("a_id"), F.col("name").alias("a_name"))

    m = senders.where("kind = 'message'")
    m = m.join(view, m["session_id"] == view["d_session"], "left").select(
        *WHO, F.when(F.col("d_session").isNotNull(), candidate).alias("_match")
    )
    e = (
        senders.where("kind <> 'message'")
        .join(names, F.col("agent_id") == F.col("a_id"), "left")
        .join(first, F.col("session_src") == F.col("d_key"), "left")
        .join(
            named,
            (F.col("session_src") == F.col("n_key")) & (F.col("a_name") == F.col("n_agent")),
            "left",
        )
        .select(
            *WHO,
            F.when(F.col("_n") > 1, F.coalesce("_named", "_first"))
            .otherwise(F.col("_first"))
            .alias("_match"),
        )
    )
    match = F.col("_match")
    suffix = F.when(
        F.coalesce(match["d_model"], F.lit("")) != "", F.concat(F.lit(" · "), match["d_model"])
    ).otherwise("")
    label = (
        F.when(
            match.isNotNull(),
            F.concat(match["d_agent"], F.lit("/"), X.short_id(match["d_session"]), suffix),
        )
        .when(F.col("kind") == "message", X.short_id(F.col("session_id")))
        .when(F.col("session_src") == "unknown-session", "unattributed")
        .otherwise(X.short_id(F.col("session_src")))
    )
    key = F.coalesce(match["d_session"], F.when(F.col("kind") == "message", F.col("session_id")), F.col("session_src"))
    return m.unionByName(e).select(*WHO, label.alias("label"), key.alias("key"))


