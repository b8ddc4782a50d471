"""Dashboard aggregates and joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import clock
from ..functions import jsonval as J
from ..functions import text as X
from ..operators import analytics as A
from ..operators import tools as T
from ..operators import versioned as V
from . import mapping as M
from .catalog import query

c = M.with_ctes
NOW = dt.datetime(2024, 1, 4, 12, 0, 0)
EVENTS_NOW = dt.datetime(2024, 1, 30, 23, 0, 0)
TOOLS = "['Write','Edit','Bash','MultiEdit'][k % 4 + 1]"
WINDOW = "win AS (SELECT * FROM msg ORDER BY valid_from DESC, id DESC LIMIT 500)"


@query(
    "row_totals",
    "SELECT (SELECT count(*) FROM events) AS events_total, (SELECT count(*) FROM conversations) AS messages_total",
)
def row_totals(spark, sf):
    return A.row_totals(M.messages(spark, sf), M.events(spark, sf))


@query("output_tokens", c("msg", "SELECT CAST(sum(n) AS BIGINT) AS output_tokens FROM msg WHERE a1 OR a2"))
def output_tokens(spark, sf):
    return A.output_token_total(M.messages(spark, sf))


@query(
    "token_totals",
    c("msg", """SELECT CAST(sum(CASE WHEN a1 THEN seq*10 ELSE seq END) AS BIGINT) AS input, CAST(sum(n) AS BIGINT) AS output,
      CAST(sum(CASE WHEN a1 THEN n*2 ELSE seq*3 END) AS BIGINT) AS cache_read,
      CAST(sum(CASE WHEN a1 THEN seq ELSE 0 END) AS BIGINT) AS cache_write FROM msg WHERE a1 OR a2"""),
)
def token_totals(spark, sf):
    return A.token_totals(M.messages(spark, sf))


@query(
    "active_sessions",
    c("msg", "SELECT count(DISTINCT session) AS active_sessions FROM msg WHERE valid_from > TIMESTAMP '2024-01-03 12:00:00'"),
)
def active_sessions(spark, sf):
    return A.active_sessions(M.messages(spark, sf), NOW, 86_400)


@query(
    "identity_totals",
    c("ag sess cur_led", """SELECT (SELECT count(*) FROM ag) AS agents, (SELECT count(*) FROM sess) AS sessions,
      (SELECT count(*) FROM cur_led WHERE type = '1-URGENT') AS modules,
      (SELECT count(*) FROM cur_led WHERE type = '1-URGENT' AND tag = 'active') AS modules_active"""),
)
def identity_totals(spark, sf):
    return A.identity_totals(M.agents(spark, sf), M.sessions(spark, sf), _module_states(spark, sf))


def _module_states(spark, sf):
    state = V.current_state(M.ledger(spark, sf).where("type = '1-URGENT'"))
    return state.select("target", J.str_field(F.col("payload"), "tag").alias("lifecycle"))


@query(
    "status_health",
    c("cur_led", """SELECT count(*) AS modules, count(*) FILTER (tag = 'active') AS active,
      NOT (count(*) > 0 AND count(*) FILTER (tag = 'active') = 0) AS healthy FROM cur_led WHERE type = '1-URGENT'"""),
)
def status_health(spark, sf):
    return A.status_health(_module_states(spark, sf))


@query(
    "lines_written",
    c("msg", f""", {WINDOW}
      SELECT CAST(sum(CASE k % 4 WHEN 2 THEN 0 WHEN 3 THEN l + 2 ELSE l END) AS BIGINT) AS lines_written FROM (
        SELECT *, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS l FROM win WHERE a1)"""),
)
def lines_written(spark, sf):
    return T.lines_written(M.messages(spark, sf))


@query(
    "tool_usage",
    c("msg", f""", {WINDOW}
      SELECT name, count(*) AS value FROM (SELECT {TOOLS} AS name FROM win WHERE a1
        UNION ALL SELECT 'shell' FROM win WHERE a2 UNION ALL SELECT 'tool' FROM win WHERE a2) GROUP BY 1"""),
)
def tool_usage(spark, sf):
    return T.tool_usage(M.messages(spark, sf))


_VERDICTS = f"""calls AS (SELECT w.id, w.session, {TOOLS.replace('k %', 'w.k %')} AS name, r.n % 5 = 0 AS failed FROM win w
    LEFT JOIN win r ON r.session = w.session AND r.seq = w.seq + 1 AND r.role = 'user' WHERE w.a1)"""


@query("tool_verdicts", c("msg", f", {WINDOW}, {_VERDICTS} SELECT id, session, name, failed FROM calls"))
def tool_verdicts(spark, sf):
    window = T.recent_window(M.messages(spark, sf))
    return T.verdicts(window).select("id", "session", "name", "failed")


@query(
    "tool_outcomes",
    c("msg", f""", {WINDOW}, {_VERDICTS},
      scored AS (SELECT name, CASE WHEN failed THEN 'failed' WHEN NOT failed THEN 'ok' ELSE 'unknown' END AS o FROM calls
        UNION ALL SELECT 'shell', ['ok','failed','cancelled','unknown'][k % 4 + 1] FROM win WHERE a2
        UNION ALL SELECT 'tool', 'unknown' FROM win WHERE a2)
      SELECT name, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'failed') AS failed,
        count(*) FILTER (o = 'cancelled') AS cancelled, count(*) FILTER (o = 'unknown') AS unknown FROM scored GROUP BY 1"""),
)
def tool_outcomes(spark, sf):
    return T.tool_outcomes(M.messages(spark, sf))


@query(
    "top_sessions",
    c("msg ag sess", f""", {WINDOW},
      agg AS (SELECT session, count(*) AS messages,
        CAST(sum(CASE WHEN NOT a1 OR k % 4 = 2 THEN 0 WHEN k % 4 = 3 THEN len(string_split(content, chr(10))) + 2
          ELSE len(string_split(content, chr(10))) END) AS BIGINT) AS lines_written,
        CAST(sum(CASE WHEN a1 OR a2 THEN n ELSE 0 END) AS BIGINT) AS output_tokens
        FROM win GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
      SELECT agg.*, agent_name || '/' || CAST(session AS VARCHAR) AS identity FROM agg JOIN sess ON sess.id = session"""),
)
def top_sessions(spark, sf):
    return T.top_sessions(M.messages(spark, sf), M.sessions(spark, sf))


@query(
    "events_per_minute",
    c("ev", """, w AS (SELECT * FROM ev ORDER BY valid_from DESC, id DESC LIMIT 2000)
      SELECT date_trunc('minute', valid_from) AS minute, count(*) AS value,
        strftime(date_trunc('minute', valid_from), '%H:%M') AS label FROM w GROUP BY 1, 3"""),
)
def events_per_minute(spark, sf):
    return A.events_per_minute(M.events(spark, sf))


@query(
    "events_per_minute_all",
    c("ev", "SELECT date_trunc('minute', valid_from) AS minute, count(*) AS value FROM ev GROUP BY 1"),
)
def events_per_minute_all(spark, sf):
    """Tumbling one-minute windows over all history."""
    return (
        M.events(spark, sf)
        .groupBy(F.window("valid_from", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.col("w.start").alias("minute"), "value")
    )


@query(
    "chart_minutes",
    c("ev", """, w AS (SELECT * FROM ev ORDER BY valid_from DESC, id DESC LIMIT 2000)
      SELECT strftime(valid_from, '%H:%M') AS label, count(*) AS value FROM w GROUP BY 1"""),
)
def chart_minutes(spark, sf):
    return A.chart_minutes(M.events(spark, sf))


@query(
    "chart_agents",
    c("ev ag", """, w AS (SELECT * FROM ev ORDER BY valid_from DESC, id DESC LIMIT 2000)
      SELECT ag.name AS name, count(*) AS value FROM w JOIN ag ON ag.id = w.agent GROUP BY 1"""),
)
def chart_agents(spark, sf):
    return A.chart_agents(M.events(spark, sf), M.agents(spark, sf))


@query(
    "boot_durations",
    c("ev", """, w AS (SELECT * FROM ev ORDER BY valid_from DESC, id DESC LIMIT 2000)
      SELECT id, valid_from, strftime(valid_from, '%m-%d %H:%M') AS label, k AS value FROM w WHERE lifecycle_event = 'signup'"""),
)
def boot_durations(spark, sf):
    return A.boot_durations(M.events(spark, sf), event="signup")


@query("message_roles", c("msg", "SELECT role, count(*) AS value FROM msg GROUP BY 1"))
def message_roles(spark, sf):
    return A.message_roles(M.messages(spark, sf))


@query(
    "messages_per_day",
    c("msg", "SELECT strftime(emitted_at, '%Y-%m-%d') AS day, count(*) AS value FROM msg GROUP BY 1"),
)
def messages_per_day(spark, sf):
    return A.messages_per_day(M.messages(spark, sf))


@query(
    "hour_weekday",
    c("msg", "SELECT hour(emitted_at) AS hour, isodow(emitted_at) AS weekday, count(*) AS value FROM msg GROUP BY 1, 2"),
)
def hour_weekday(spark, sf):
    return A.hour_weekday(M.messages(spark, sf)).select(
        F.col("hour").cast("bigint").alias("hour"), F.col("weekday").cast("bigint").alias("weekday"), "value"
    )


@query(
    "models",
    c("msg", "SELECT CASE WHEN a1 THEN 'm' || agent || '-' || (k % 2) ELSE 'g1' END AS model, count(*) AS value FROM msg WHERE a1 OR a2 GROUP BY 1"),
)
def models(spark, sf):
    return A.models(M.messages(spark, sf))


@query(
    "per_agent",
    c("msg ag", """SELECT coalesce(ag.name, 'unattributed') AS name, count(*) AS messages,
      CAST(sum(CASE WHEN a1 OR a2 THEN n ELSE 0 END) AS BIGINT) AS output_tokens
      FROM msg LEFT JOIN ag ON ag.id = agent GROUP BY 1"""),
)
def per_agent(spark, sf):
    return A.per_agent(M.messages(spark, sf), M.agents(spark, sf))


@query("event_kinds", c("ev", "SELECT lifecycle_event, count(*) AS value FROM ev GROUP BY 1"))
def event_kinds(spark, sf):
    return A.event_kinds(M.events(spark, sf))


@query(
    "module_startup",
    c("ev", """, w AS (SELECT * FROM ev WHERE lifecycle_event = 'click' ORDER BY valid_from DESC, id DESC LIMIT 400)
      SELECT name, k AS value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY valid_from DESC, id DESC) AS nth FROM w)
      WHERE nth = 1"""),
)
def module_startup(spark, sf):
    return A.module_startup(M.events(spark, sf), event="click", value_field="k")


@query(
    "capture_lag",
    c("ev", """SELECT greatest(0, CAST(trunc(epoch(TIMESTAMP '2024-01-30 23:00:00' - max(valid_from))) AS BIGINT)) AS lag_seconds,
      count(*) FILTER (valid_from > TIMESTAMP '2024-01-30 22:00:00') AS events_recent FROM ev"""),
)
def capture_lag(spark, sf):
    return A.capture_lag(M.events(spark, sf), EVENTS_NOW)


_SESSION_STATS = """stats AS (
  SELECT session, count(*) AS messages, max(valid_from) AS last_active,
    CAST(sum(CASE WHEN a1 OR a2 THEN n END) AS BIGINT) AS output_tokens,
    arg_max(CASE WHEN a1 THEN seq*10 + n*2 + seq ELSE n + seq*4 END, valid_from) FILTER (a1 OR a2) AS context_tokens,
    arg_max(CASE WHEN a1 THEN 'm' || agent || '-' || (k % 2) ELSE 'g1' END, valid_from) FILTER (a1 OR a2) AS model
  FROM msg GROUP BY 1)"""
_ACTIONS = """pairs AS (
  SELECT ev.id AS event, sess.id AS session FROM ev JOIN sess ON ev.subject = sess.id
  UNION SELECT ev.id, sess.id FROM ev JOIN sess ON ev.agent = sess.agent AND ev.key = sess.source_key),
  acts AS (SELECT session, count(*) AS actions FROM pairs GROUP BY 1)"""


@query("session_tokens", c("msg", f", {_SESSION_STATS} SELECT session, context_tokens, output_tokens FROM stats"))
def session_tokens(spark, sf):
    return A.session_tokens(M.messages(spark, sf))


@query("session_model", c("msg", f", {_SESSION_STATS} SELECT session, model FROM stats WHERE model IS NOT NULL"))
def session_model(spark, sf):
    return A.session_model(M.messages(spark, sf))


@query("event_session", c("ev sess", f", {_ACTIONS} SELECT event AS id, session FROM pairs"))
def event_session(spark, sf):
    return A.attributed_events(M.events(spark, sf), M.sessions(spark, sf))


@query(
    "session_counters",
    c("msg ev sess", f""", {_SESSION_STATS}, {_ACTIONS}
      SELECT sess.id AS session, coalesce(messages, 0) AS messages, coalesce(actions, 0) AS actions, last_active
      FROM sess LEFT JOIN stats ON stats.session = sess.id LEFT JOIN acts ON acts.session = sess.id"""),
)
def session_counters(spark, sf):
    return A.session_counters(M.messages(spark, sf), M.events(spark, sf), M.sessions(spark, sf))


_VIEW = f"""{_SESSION_STATS}, {_ACTIONS}, view AS (
  SELECT sess.id AS session, agent_name || '/' || CAST(sess.id AS VARCHAR) AS identity, agent_name AS agent, source_key,
    coalesce(messages, 0) + coalesce(actions, 0) AS actions, context_tokens,
    CASE WHEN context_tokens IS NOT NULL THEN CAST(greatest(0, least(100, context_tokens * 100 // 5000)) AS BIGINT) END AS context_pct, output_tokens, last_active, model
  FROM sess LEFT JOIN stats ON stats.session = sess.id LEFT JOIN acts ON acts.session = sess.id)"""


def view(spark, sf):
    return A.sessions_view(
        M.messages(spark, sf), M.events(spark, sf), M.sessions(spark, sf), context_window=5000
    )


@query("sessions_view", c("msg ev sess", f", {_VIEW} SELECT * FROM view"))
def sessions_view(spark, sf):
    return view(spark, sf)


@query(
    "session_order",
    c("msg ev sess", f""", {_VIEW}, live AS (SELECT *, CASE
        WHEN last_active > TIMESTAMP '2024-01-04 12:00:00' - INTERVAL 5 MINUTE THEN 'active'
        WHEN last_active > TIMESTAMP '2024-01-04 12:00:00' - INTERVAL 24 HOUR THEN 'paused' ELSE 'ended' END AS liveness FROM view)
      SELECT row_number() OVER (ORDER BY CASE liveness WHEN 'active' THEN 0 WHEN 'paused' THEN 1 ELSE 2 END,
        last_active DESC, actions DESC, session) AS place, session, liveness,
        CASE WHEN context_pct >= 90 THEN 'red' WHEN context_pct >= 70 THEN 'yellow' WHEN context_pct IS NOT NULL THEN 'green' END AS band
      FROM live"""),
)
def session_order(spark, sf):
    """The order itself is checked: each session with the number ranked above it."""
    from ..operators import ordered

    live = A.session_order(view(spark, sf), NOW)
    ranked = live.select(
        F.lit(0).alias("all"),
        "session",
        "liveness",
        X.context_band(F.col("context_pct")).alias("band"),
        "rank",
        (-F.unix_micros(F.col("last_active").cast("timestamp"))).alias("age"),
        (-F.col("actions")).alias("quiet"),
    )
    # One chain of all rows: the scan runs over ranges of it.
    placed = ordered.with_running(
        ranked, ["all"], ["rank", "age", "quiet", "session"], {"place": ordered.count_rows()}
    )
    return placed.select("place", "session", "liveness", "band")


@query(
    "session_listing",
    c("msg sess", """SELECT agent_name || '/' || sess.id AS identity, source_key, count(msg.id) AS messages
      FROM sess LEFT JOIN msg ON msg.session = sess.id WHERE agent_name = 'agent_1' GROUP BY 1, 2"""),
)
def session_listing(spark, sf):
    return A.session_listing(M.messages(spark, sf), M.sessions(spark, sf), "agent_1")


@query(
    "agent_directory",
    c("ag sess", """SELECT ag.id AS id, ag.name AS name,
      (SELECT count(*) FROM supplier WHERE 'agent_' || (s_nationkey % 4) = ag.name) AS sources,
      (SELECT count(*) FROM sess WHERE sess.agent_name = ag.name) AS sessions FROM ag"""),
)
def agent_directory(spark, sf):
    return A.agent_directory(M.agents(spark, sf), M.sources(spark, sf), M.sessions(spark, sf))


@query(
    "health_ratios",
    c("msg", f""", {WINDOW}, {_VERDICTS},
      tok AS (SELECT sum(CASE WHEN a1 THEN n*2 ELSE seq*3 END) AS r,
        sum(CASE WHEN a1 THEN seq*10 + seq + n*2 ELSE seq + seq*3 END) AS a FROM msg WHERE a1 OR a2),
      sc AS (SELECT count(*) FILTER (failed) + (SELECT count(*) FROM win WHERE a2 AND k % 4 = 1) AS f,
        count(failed) + (SELECT count(*) FROM win WHERE a2 AND k % 4 < 3) AS s FROM calls)
      SELECT CAST(round(100.0 * r / a) AS BIGINT) AS cache_hit, round(1000.0 * f / s) / 10 AS fail_rate FROM tok, sc"""),
)
def health_ratios(spark, sf):
    messages = M.messages(spark, sf)
    return A.health_ratios(A.token_totals(messages), T.tool_outcomes(messages))


@query(
    "firing_summary",
    c("cur_rn", """SELECT firing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
      count(DISTINCT task) AS tasks_seen, bool_or(status = 'cancelled') AS cancelled FROM cur_rn GROUP BY 1"""),
)
def firing_summary(spark, sf):
    return A.firing_summary(M.runs(spark, sf), M.RUN_ORDER)


@query(
    "done_tasks",
    c("cur_rn", "SELECT DISTINCT firing, task FROM cur_rn WHERE status = 'done'"),
)
def done_tasks(spark, sf):
    from ..operators import schedule as S

    return S.done_tasks(M.runs(spark, sf), order=M.RUN_ORDER)


@query(
    "top_tools",
    c("ev", "SELECT name, count(*) AS value FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
)
def top_tools(spark, sf):
    name = J.as_str(J.typed(F.col("payload"), "name variant")["name"])
    counts = M.events(spark, sf).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return A.top(counts, 8)


@query(
    "durations_added",
    """SELECT p_partkey AS id, o + p_size * INTERVAL 1 HOUR AS next_at FROM
      (SELECT p_partkey, p_size, TIMESTAMP '2024-01-01' AS o FROM part)""",
)
def durations_added(spark, sf):
    part = M.table(spark, sf, "part")
    token = F.concat(F.col("p_size").cast("string"), F.lit("h"))
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return part.select(F.col("p_partkey").alias("id"), clock.add_duration(start, token).alias("next_at"))


@query(
    "mime_types",
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'image/jpeg'
      WHEN 2 THEN 'application/sql' WHEN 3 THEN 'application/octet-stream' WHEN 4 THEN 'text/html'
      ELSE 'application/octet-stream' END AS mime FROM part""",
)
def mime_types(spark, sf):
    name = F.expr(
        "concat(p_name, element_at(array('.MD', '.jpeg', '.v1.sql', '', '.htm', '.exe'), int(p_partkey % 6) + 1))"
    )
    return M.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), X.mime_of(name).alias("mime")
    )
