"""The merged activity feed, its pages, scoping, attribution and rendering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import jsonval as J
from ..functions import text as X
from ..operators import analytics as A
from ..operators import feed as D
from ..operators import lookup as L
from . import mapping as M
from .activity_queries import _SESSION_STATS
from .catalog import query

c = M.with_ctes

# Feed rows of both tables in the oracle; ids are compared as text, as in the feed.
_FEED = """fd AS (
  SELECT 'message' AS kind, CAST(id AS VARCHAR) AS id, valid_from, CAST(session AS VARCHAR) AS session_id,
    CAST(NULL AS VARCHAR) AS session_src, CAST(agent AS VARCHAR) AS agent_id, role, CAST(NULL AS VARCHAR) AS event,
    content, session, CAST(NULL AS BIGINT) AS subject, CAST(NULL AS BIGINT) AS agent, CAST(NULL AS VARCHAR) AS name FROM msg
  UNION ALL SELECT 'action', CAST(id AS VARCHAR), valid_from, NULL, key, CAST(agent AS VARCHAR), NULL, lifecycle_event,
    NULL, NULL, subject, agent, name FROM ev)"""
_SHOWN = "kind, id, valid_from, session_id, session_src, agent_id, role, event"
_COLUMNS = _SHOWN.split(", ")
_ORDER = "ORDER BY valid_from DESC, kind DESC, id DESC"


def _frames(spark, sf):
    return M.messages(spark, sf), M.events(spark, sf)


@query(
    "merge_newest",
    c("msg ev", f", {_FEED} SELECT {_SHOWN} FROM fd {_ORDER} LIMIT 700"),
)
def merge_newest(spark, sf):
    messages, events = _frames(spark, sf)
    rows = D.merge_newest(D.message_rows(messages), D.event_rows(events), 700)
    return rows.select(*_COLUMNS)


@query(
    "global_feed",
    c("msg ev", f""", {_FEED} SELECT {_SHOWN} FROM fd WHERE valid_from < TIMESTAMP '2024-01-03 12:00:00'
      AND (contains(lower(content), 'er') OR contains(lower(event), 'er') OR contains(name, 'er') OR contains(session_src, 'er'))
      {_ORDER} LIMIT 500"""),
)
def global_feed(spark, sf):
    messages, events = _frames(spark, sf)
    rows = D.global_feed(messages, events, before=dt.datetime(2024, 1, 3, 12, 0, 0), q="ER")
    return rows.select(*_COLUMNS)


@query(
    "feed_rows",
    c("msg ev", f", {_FEED} SELECT {_SHOWN} FROM fd"),
)
def feed_rows(spark, sf):
    """Both tables in the one row shape, all rows."""
    messages, events = _frames(spark, sf)
    return D.message_rows(messages).unionByName(D.event_rows(events)).select(*_COLUMNS)


@query(
    "session_feed",
    c("msg ev sess", f""", {_FEED} SELECT {_SHOWN} FROM fd WHERE session = 49 OR subject = 49
      OR (kind = 'action' AND EXISTS (SELECT 1 FROM sess WHERE sess.id = 49 AND sess.agent = fd.agent AND sess.source_key = fd.session_src))
      {_ORDER} LIMIT 500"""),
)
def session_feed(spark, sf):
    messages, events = _frames(spark, sf)
    return D.session_feed(messages, events, M.sessions(spark, sf), 49).select(*_COLUMNS)


@query(
    "next_page",
    c("msg ev", f""", {_FEED} SELECT {_SHOWN} FROM fd
      WHERE (valid_from, kind, id) < (TIMESTAMP '2024-01-20 00:00:00', 'message', '5') {_ORDER} LIMIT 300"""),
)
def next_page(spark, sf):
    messages, events = _frames(spark, sf)
    mark = (dt.datetime(2024, 1, 20), "message", "5")
    return D.next_page(messages, events, mark=mark).select(*_COLUMNS)


@query(
    "feed_merge",
    c("ev", """, back AS (SELECT id, valid_from, 'backlog' AS source FROM ev WHERE id % 3 <> 0),
      live AS (SELECT id, valid_from, 'live' AS source FROM ev WHERE id % 2 = 0)
      SELECT * FROM (SELECT * FROM back UNION ALL SELECT * FROM live WHERE id NOT IN (SELECT id FROM back))
      ORDER BY valid_from DESC, id DESC LIMIT 500"""),
)
def feed_merge(spark, sf):
    rows = M.events(spark, sf).select("id", "valid_from")
    backlog = rows.where("id % 3 <> 0").withColumn("source", F.lit("backlog"))
    live = rows.where("id % 2 = 0").withColumn("source", F.lit("live"))
    return D.merge_live(backlog, live)


@query(
    "feed_labels",
    c("msg ev", f", {_FEED} SELECT DISTINCT CASE WHEN kind = 'message' THEN coalesce(role, 'message') ELSE 'action' END AS label FROM fd"),
)
def feed_labels(spark, sf):
    messages, events = _frames(spark, sf)
    return L.feed_labels(D.message_rows(messages).unionByName(D.event_rows(events)))


@query(
    "feed_label_filter",
    c("msg ev", f", {_FEED} SELECT {_SHOWN} FROM fd WHERE role = 'system'"),
)
def feed_label_filter(spark, sf):
    messages, events = _frames(spark, sf)
    rows = D.message_rows(messages).unionByName(D.event_rows(events))
    return L.filter_by_label(rows, "system").select(*_COLUMNS)


# Sessions whose keys collide: the key of session s is s // 2, shared by two agents.
_PAIRED = """pv AS (SELECT CAST(sess.id AS VARCHAR) AS sid, sess.id AS num, agent_name AS agent, CAST(sess.id // 2 AS VARCHAR) AS src, model
    FROM sess LEFT JOIN stats ON stats.session = sess.id),
  keyed AS (SELECT src AS k, * FROM pv UNION ALL SELECT agent || '/' || src, * FROM pv),
  cand AS (SELECT k, count(*) AS n, min(sid) AS first FROM keyed GROUP BY 1),
  named AS (SELECT k, agent AS a, min(sid) AS sid FROM keyed GROUP BY 1, 2)"""


@query(
    "feed_attribution",
    c("msg ev sess ag", f""", {_SESSION_STATS}, {_FEED}, {_PAIRED},
      m AS (SELECT fd.kind, fd.id, CASE WHEN fd.kind = 'message' THEN fd.session_id
          WHEN cand.n > 1 THEN coalesce(named.sid, cand.first) ELSE cand.first END AS sid, fd.session_id, fd.session_src
        FROM fd LEFT JOIN ag ON CAST(ag.id AS VARCHAR) = fd.agent_id LEFT JOIN cand ON cand.k = fd.session_src
        LEFT JOIN named ON named.k = fd.session_src AND named.a = ag.name)
      SELECT kind, m.id AS id, CASE WHEN pv.sid IS NOT NULL THEN pv.agent || '/' || pv.sid || CASE WHEN model IS NULL THEN '' ELSE ' · ' || model END
        WHEN kind = 'message' THEN session_id ELSE left(session_src, 8) END AS label,
        coalesce(pv.sid, CASE WHEN kind = 'message' THEN session_id END, session_src) AS key
      FROM m LEFT JOIN pv ON pv.sid = m.sid"""),
)
def feed_attribution(spark, sf):
    messages, events = _frames(spark, sf)
    rows = D.message_rows(messages).unionByName(D.event_rows(events))
    models = A.session_model(messages)
    view = M.sessions(spark, sf).join(
        models, F.col("id") == F.col("session"), "left"
    ).select(
        F.col("id").alias("session"),
        F.col("agent_name").alias("agent"),
        F.expr("string(id div 2)").alias("source_key"),
        "model",
    )
    found = D.attribute(rows, view, M.agents(spark, sf))
    return found.select("kind", "id", "label", "key")


@query(
    "rendered_events",
    c("ev", """SELECT id, '[' || strftime(valid_from, '%H:%M:%S') || '] ' || rpad(lifecycle_event, 20, ' ') || ' '
      || 'duration_ms=' || k || ' k=' || k || ' name=' || name || ' session=' || key AS text FROM ev"""),
)
def rendered_events(spark, sf):
    summary = X.payload_summary(F.col("payload"))
    line = X.render_event(F.col("valid_from"), F.col("lifecycle_event"), summary)
    return M.events(spark, sf).select("id", line.alias("text"))


@query(
    "rendered_messages",
    c("msg", """SELECT id, '[' || strftime(emitted_at, '%Y-%m-%d %H:%M:%S') || '] ' || lpad(role, 9, ' ') || ': '
      || CASE WHEN seq % 3 > 0 THEN replace(content, chr(10), chr(10) || '    ')
         WHEN a1 AND k % 4 = 2 THEN '⚙ Bash — ' || CASE WHEN n > 60 THEN left(content, 60) || '…' ELSE content END
         WHEN a1 THEN '⚙ ' || ['Write','Edit','Bash','MultiEdit'][k % 4 + 1]
         WHEN a2 THEN '⚙ shell' || [' [success]',' [error]',' [cancelled]',''][k % 4 + 1] || '; ⚙ tool'
         WHEN role = 'user' AND seq > 0 AND agent < 2 THEN '⚙ result'
         ELSE '(no text — see raw)' END AS text FROM msg"""),
)
def rendered_messages(spark, sf):
    """Every third message is shown without its text, so the summary takes over."""
    summary = X.tool_summary(J.typed(F.col("raw"), J.TOOLS_SCHEMA))
    content = F.when(F.col("seq") % 3 > 0, F.col("content")).otherwise("")
    line = X.render_message(F.col("emitted_at"), F.col("role"), content, summary)
    return M.messages(spark, sf).select("id", line.alias("text"))


@query(
    "tool_summaries",
    c("msg", """SELECT id, CASE WHEN a1 AND k % 4 = 2 THEN '⚙ Bash — ' || CASE WHEN n > 60 THEN left(content, 60) || '…' ELSE content END
         WHEN a1 THEN '⚙ ' || ['Write','Edit','Bash','MultiEdit'][k % 4 + 1]
         WHEN a2 THEN '⚙ shell' || [' [success]',' [error]',' [cancelled]',''][k % 4 + 1] || '; ⚙ tool'
         WHEN role = 'user' AND seq > 0 AND agent < 2 THEN '⚙ result' END AS summary FROM msg"""),
)
def tool_summaries(spark, sf):
    summary = X.tool_summary(J.typed(F.col("raw"), J.TOOLS_SCHEMA))
    return M.messages(spark, sf).select("id", summary.alias("summary"))


@query(
    "elided_documents",
    """SELECT doc_id AS id, CASE WHEN length(text) > 160 THEN left(text, 160) || '…' ELSE text END AS cut,
      CASE WHEN length(string_split(text, chr(10))[1]) > 60 THEN left(string_split(text, chr(10))[1], 60) || '…'
        ELSE string_split(text, chr(10))[1] END AS headline,
      CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines FROM documents""",
)
def elided_documents(spark, sf):
    text = F.col("text")
    return M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        X.elide(text, 160).alias("cut"),
        X.first_line(text).alias("headline"),
        X.line_count(text).alias("lines"),
    )
