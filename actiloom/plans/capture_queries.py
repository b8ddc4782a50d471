"""Capture over lines that Spark makes from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import clock
from ..functions import jsonval as J
from ..functions import text as X
from ..operators import analytics, ordered
from ..session import scratch_path
from ..sources import adapters, capture, documents, logs, shape1, shape2, tail
from ..sources import lines as L
from . import mapping as M
from .catalog import query

c = M.with_ctes
NOW = dt.datetime(2024, 6, 1)


# -- lines ---------------------------------------------------------------------


def _shape1_lines(spark, sf):
    """Conversations of agents 0 and 1 as transcript files, system rows as side-cars,
    and every document's lines as text that is not JSON."""
    sidecar = "to_json(named_struct('type', 'side-note', 'sessionId', concat('own-', conv_id), 'text', text))"
    talk = M.table(spark, sf, "conversations").where("conv_id % 3 < 2").select(
        F.expr("concat('/p/proj', conv_id % 5, '/c', conv_id, '.jsonl')").alias("file"),
        F.expr("turn * 1000000").alias("offset"),
        F.expr(f"coalesce({M.RAW}, {sidecar})").alias("line"),
    )
    prose = M.table(spark, sf, "documents").select(
        F.expr("concat('/p/docs/d', doc_id, '.jsonl')").alias("file"),
        F.posexplode(F.split("text", "\n")).alias("offset", "line"),
    ).select("file", F.col("offset").cast("bigint").alias("offset"), "line")
    rows = talk.unionByName(prose)
    return rows.withColumns(
        {"next": F.col("offset") + F.octet_length("line") + 1, "skipped": F.lit(None).cast("bigint")}
    )


_DOC_LINES = r"""doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
_TRIM = r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _shape2_lines(spark, sf):
    """Conversations of agent 2 as chat files: a header, a ``$set`` line, and every
    assistant record first emitted without calls."""
    talk = M.table(spark, sf, "conversations").where("conv_id % 3 = 2")
    file = "concat('/g/tmp/proj', conv_id % 4, '/chats/c', conv_id, '.jsonl')"
    heads = talk.select("conv_id").distinct()
    head = heads.select(
        F.expr(file).alias("file"),
        F.lit(0).cast("bigint").alias("offset"),
        F.expr("to_json(named_struct('sessionId', concat('k', conv_id), 'kind', 'main'))").alias("line"),
    )
    mutation = heads.select(
        F.expr(file).alias("file"),
        F.lit(1).cast("bigint").alias("offset"),
        F.lit('{"$set":{"lastUpdated":"now"}}').alias("line"),
    )
    early = talk.where("role = 'assistant'").select(
        F.expr(file).alias("file"),
        F.expr("turn * 100 + 10").alias("offset"),
        F.expr(
            "to_json(named_struct('id', concat('g', conv_id, '-', turn), 'type', 'gemini', 'content', left(text, 9)))"
        ).alias("line"),
    )
    notice = "to_json(named_struct('type', 'warning', 'content', text))"
    full = talk.select(
        F.expr(file).alias("file"),
        F.expr("turn * 100 + 20").alias("offset"),
        F.expr(f"coalesce({M.RAW}, {notice})").alias("line"),
    )
    return head.unionByName(mutation).unionByName(early).unionByName(full)


# -- routing -------------------------------------------------------------------


@query(
    "shape1_messages",
    c("msg", """SELECT '/p/proj' || (session % 5) || '/c' || session || '.jsonl' AS file, seq * 1000000 AS "offset",
      CAST(session AS VARCHAR) AS session_key, CASE WHEN role = 'assistant' THEN role WHEN seq = 0 THEN 'user' ELSE 'tool' END AS role,
      content, emitted_at FROM msg WHERE agent < 2 AND role <> 'system'"""),
)
def shape1_messages(spark, sf):
    found = L.messages(shape1.route(_shape1_lines(spark, sf)))
    return found.select(
        "file", "offset", "session_key", "role", "content", F.col("emitted_at").cast("timestamp_ntz").alias("emitted_at")
    )


@query(
    "shape1_events",
    c("msg", f""", {_DOC_LINES}
      SELECT '/p/proj' || (session % 5) || '/c' || session || '.jsonl' AS file, seq * 1000000 AS "offset",
        CASE WHEN role = 'system' THEN 'transcript_event' ELSE 'message_captured' END AS lifecycle_event,
        CASE WHEN role = 'system' THEN 'own-' || session ELSE CAST(session AS VARCHAR) END AS session_key,
        CASE WHEN role <> 'system' THEN n END AS chars, CASE WHEN role = 'system' THEN 'side-note' END AS kind, NULL AS snippet
      FROM msg WHERE agent < 2
      UNION ALL SELECT '/p/docs/d' || doc_id || '.jsonl', pos, 'transcript_raw', 'd' || doc_id, NULL, NULL, left({_TRIM}, 500)
      FROM doc_lines WHERE {_TRIM} <> ''"""),
)
def shape1_events(spark, sf):
    found = L.events(shape1.route(_shape1_lines(spark, sf)))
    body = J.typed(F.col("payload"), "chars bigint, kind string, snippet string")
    return found.withColumn("_p", body).select(
        "file", "offset", "lifecycle_event", "session_key", "_p.chars", "_p.kind", "_p.snippet"
    )


@query(
    "shape2_messages",
    c("msg", """SELECT '/g/tmp/proj' || (session % 4) || '/chats/c' || session || '.jsonl' AS file, seq * 100 + 20 AS "offset",
      'k' || session AS session_key, role, content, emitted_at FROM msg WHERE agent = 2 AND role <> 'system'"""),
)
def shape2_messages(spark, sf):
    found = L.messages(shape2.route(_shape2_lines(spark, sf)))
    return found.select(
        "file", "offset", "session_key", "role", "content", F.col("emitted_at").cast("timestamp_ntz").alias("emitted_at")
    )


@query(
    "shape2_events",
    c("msg", """, m AS (SELECT *, '/g/tmp/proj' || (session % 4) || '/chats/c' || session || '.jsonl' AS file FROM msg WHERE agent = 2)
      SELECT file, seq * 100 + 20 AS "offset", 0 AS nth, 'message_captured' AS lifecycle_event, n AS chars, NULL AS tool, NULL AS status FROM m WHERE role <> 'system'
      UNION ALL SELECT file, seq * 100 + 20, 0, 'transcript_event', NULL, NULL, NULL FROM m WHERE role = 'system'
      UNION ALL SELECT file, seq * 100 + 20, 1, 'tool_call', NULL, 'shell', ['success','error','cancelled',NULL][k % 4 + 1] FROM m WHERE a2
      UNION ALL SELECT file, seq * 100 + 20, 2, 'tool_call', NULL, NULL, NULL FROM m WHERE a2"""),
)
def shape2_events(spark, sf):
    found = L.events(shape2.route(_shape2_lines(spark, sf)))
    body = J.typed(F.col("payload"), "chars bigint, tool string, status string")
    return found.withColumn("_p", body).select(
        "file", "offset", "nth", "lifecycle_event", "_p.chars", "_p.tool", "_p.status"
    )


@query(
    "reemission_dedupe",
    """SELECT file, CAST(max(pos) AS BIGINT) AS "offset" FROM (SELECT user_id % 20 AS file, event_id AS pos, CASE WHEN event_id % 4 > 0 THEN value END AS id FROM events)
        WHERE id IS NOT NULL GROUP BY file, id
      UNION ALL SELECT user_id % 20, event_id FROM events WHERE event_id % 4 = 0""",
)
def reemission_dedupe(spark, sf):
    """Events as records whose id is the value; every fourth has none."""
    record = F.expr(
        "to_json(named_struct('id', if(event_id % 4 > 0, string(value), null), 'type', event_type))"
    )
    rows = M.table(spark, sf, "events").select(
        F.expr("user_id % 20").alias("file"), F.col("event_id").alias("offset"), record.alias("line")
    )
    return shape2.dedupe(shape2.read_records(rows)).select("file", "offset")


@query(
    "header_session",
    """SELECT file, "offset", coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY file ORDER BY "offset"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), own, 'f' || file) AS session_key, h IS NOT NULL AS is_header
      FROM (SELECT user_id % 20 AS file, event_id AS "offset", CASE WHEN event_id % 50 = 1 THEN 'h' || event_id END AS h,
        CASE WHEN event_id % 3 = 0 THEN 'own' || event_id END AS own FROM events)""",
)
def header_session(spark, sf):
    """Events as chat records; every fiftieth is a header."""
    record = F.expr(
        "to_json(CASE WHEN event_id % 50 = 1 THEN named_struct('sessionId', concat('h', event_id), 'type', null)"
        " ELSE named_struct('sessionId', if(event_id % 3 = 0, concat('own', event_id), null), 'type', event_type) END)"
    )
    rows = M.table(spark, sf, "events").select(
        F.expr("concat('f', user_id % 20, '.jsonl')").alias("file"),
        F.col("event_id").alias("offset"),
        record.alias("line"),
    )
    keyed = shape2.with_sessions(shape2.read_records(rows))
    number = F.regexp_extract("file", "([0-9]+)", 1).cast("bigint")
    return keyed.select(number.alias("file"), "offset", "session_key", "is_header")


@query(
    "grown_records",
    """SELECT user_id % 20 AS file, event_id AS "offset" FROM events WHERE event_id % 2 = 1 AND length(event_type) > coalesce(
        (SELECT max(length(e.event_type)) FROM events e WHERE e.event_id % 2 = 0 AND e.user_id % 20 = events.user_id % 20
          AND e.value = events.value), 0)""",
)
def grown_records(spark, sf):
    """Odd events are re-emissions of even ones; a copy stays when it is longer."""
    record = F.expr("to_json(named_struct('id', string(value), 'type', event_type))")
    rows = M.table(spark, sf, "events").select(
        F.expr("user_id % 20").alias("file"), F.col("event_id").alias("offset"), record.alias("line")
    )
    parsed = shape2.read_records(rows)
    seen = parsed.where("offset % 2 = 0").select(
        "file", "record_id", F.char_length("text").alias("chars")
    )
    return shape2.keep_grown(parsed.where("offset % 2 = 1"), seen).select("file", "offset")


@query(
    "sanitized_records",
    c("msg", """SELECT id, true AS clean, 2 AS calls, n AS output_tokens, content FROM msg WHERE a2"""),
)
def sanitized_records(spark, sf):
    rows = M.messages(spark, sf).where("agent = 2 and role = 'assistant'")
    clean = shape2.sanitize(F.col("raw"))
    body = J.typed(
        clean, "content string, tokens struct<output: bigint>, toolCalls array<map<string, variant>>"
    )
    return rows.select("id", body.alias("_b")).select(
        "id",
        F.forall("_b.toolCalls", lambda m: ~F.map_contains_key(m, "resultDisplay")).alias("clean"),
        F.size("_b.toolCalls").alias("calls"),
        F.col("_b.tokens.output").alias("output_tokens"),
        F.col("_b.content").alias("content"),
    )


@query(
    "truncated_inline_data",
    """SELECT doc_id AS id, CASE WHEN strlen(text) > 256 THEN left(text, 256) || '…[truncated ' || strlen(text) || ' bytes]' ELSE text END AS data,
      lang AS mime, n_chars AS kept FROM documents""",
)
def truncated_inline_data(spark, sf):
    record = F.expr(
        "to_json(named_struct('n', n_chars, 'content', array(named_struct('inlineData',"
        " named_struct('data', text, 'mimeType', lang)))))"
    )
    body = J.typed(
        shape2.sanitize(record),
        "n bigint, content array<struct<inlineData: struct<data: string, mimeType: string>>>",
    )
    part = F.col("_b.content")[0]["inlineData"]
    return (
        M.table(spark, sf, "documents")
        .select(F.col("doc_id").alias("id"), body.alias("_b"))
        .select("id", part["data"].alias("data"), part["mimeType"].alias("mime"), F.col("_b.n").alias("kept"))
    )


# -- logs ----------------------------------------------------------------------

_LOG_LINE = (
    "concat(if(pos % 3 = 1, '2024-01-01 ', ''), if((doc_id + pos) % 7 = 0, '[MCP] ', ''), line)"
)
_LOG_SQL = f"""{_DOC_LINES}, log AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 1 THEN '2024-01-01 ' ELSE '' END
      || CASE WHEN (doc_id + pos) % 7 = 0 THEN '[MCP] ' ELSE '' END || line AS line FROM doc_lines),
    numbered AS (SELECT *, sum(CASE WHEN pos % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS record FROM log),
    folded AS (SELECT doc_id, CAST(record AS BIGINT) AS record, CAST(min(pos) AS BIGINT) AS "offset", string_agg(line, chr(10) ORDER BY pos) AS text
      FROM numbered GROUP BY 1, 2)"""


def _log_lines(spark, sf):
    """Every document as a log: each third line begins a record, some carry a marker."""
    lines = M.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return lines.select(
        F.col("doc_id").alias("file"), F.col("pos").cast("bigint").alias("offset"), F.expr(_LOG_LINE).alias("line")
    )


@query("log_folding", f"""WITH {_LOG_SQL} SELECT doc_id AS file, record, "offset", text FROM folded""")
def log_folding(spark, sf):
    return logs.fold(logs.number_records(_log_lines(spark, sf), chunk=1000))


@query(
    "log_signals",
    f"""WITH {_LOG_SQL} SELECT doc_id AS file, record, "offset", text FROM folded WHERE contains(text, '[MCP]')""",
)
def log_signals(spark, sf):
    return logs.signals(_log_lines(spark, sf), chunk=1000)


@query(
    "log_sources",
    """SELECT p_partkey AS id, p_partkey % 5 IN (0, 4) AS accepted FROM part""",
)
def log_sources(spark, sf):
    name = F.expr(
        "concat(element_at(array('app', 'app1', 'unknown-window', 'app', 'app2'), int(p_partkey % 5) + 1),"
        " if(p_partkey % 5 = 3, '.txt', '.log'))"
    )
    return M.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), logs.is_source(name).alias("accepted")
    )


# -- backfill cap --------------------------------------------------------------


def _sized_lines(spark, sf):
    """Document lines with their byte positions."""
    lines = M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    sized = ordered.with_running(
        lines, ["file"], ["pos"], {"next": ordered.sum_of(F.octet_length("line") + F.lit(1).cast("bigint"))}
    )
    return sized.withColumn("offset", F.col("next") - F.octet_length("line") - 1)


_CAP = f"""{_DOC_LINES}, sized AS (SELECT doc_id, pos, strlen(line) + 1 AS b, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt,
    sum(strlen(line) + 1) OVER (PARTITION BY doc_id) AS total FROM doc_lines)"""


@query(
    "backfill_cap",
    f"""WITH {_CAP} SELECT doc_id AS file, pos::INTEGER AS pos FROM sized WHERE total <= 500 OR nxt - b > total - 500""",
)
def backfill_cap(spark, sf):
    kept, _ = adapters.capped_lines(_sized_lines(spark, sf), 500)
    return kept.select("file", "pos")


@query(
    "backfill_skipped",
    f"""WITH {_CAP} SELECT doc_id AS file, CAST(max(nxt) AS BIGINT) AS skipped_bytes FROM sized
      WHERE total > 500 AND nxt - b <= total - 500 GROUP BY 1""",
)
def backfill_skipped(spark, sf):
    _, skipped = adapters.capped_lines(_sized_lines(spark, sf), 500)
    return skipped


# -- capture as a whole --------------------------------------------------------


def _captured(spark, sf):
    source = adapters.BlockTranscripts("/p", "agent_b")
    empty = spark.createDataFrame(
        [], "id string, target string, type string, payload string, valid_from timestamp"
    )
    return capture.capture(_shape1_lines(spark, sf), source, empty, F.lit(NOW))


@query(
    "captured_identities",
    """SELECT 'agent_b' AS name, 'node_agent' AS type UNION ALL SELECT DISTINCT 'agent_b/proj' || (conv_id % 5), 'node_source' FROM conversations WHERE conv_id % 3 < 2
      UNION ALL SELECT 'agent_b/docs', 'node_source'
      UNION ALL SELECT DISTINCT 'agent_b/' || conv_id, 'node_session' FROM conversations WHERE conv_id % 3 < 2 AND role <> 'system'""",
)
def captured_identities(spark, sf):
    rows = _captured(spark, sf)
    named = rows["state_ledger"].select(
        F.col("target").alias("id"), J.str_field(F.col("payload"), "name").alias("name")
    )
    return rows["entity"].join(named, "id").select("name", "type")


@query(
    "captured_messages",
    c("msg", """SELECT 'agent_b/' || session AS session, CASE WHEN role = 'assistant' THEN role WHEN seq = 0 THEN 'user' ELSE 'tool' END AS role,
      count(*) AS n, count(DISTINCT seq) AS ids FROM msg WHERE agent < 2 AND role <> 'system' GROUP BY 1, 2"""),
)
def captured_messages(spark, sf):
    rows = _captured(spark, sf)
    names = capture.current_names(rows["state_ledger"]).select(
        F.col("id").alias("session"), "name"
    )
    return (
        rows["message"]
        .join(names, "session")
        .groupBy(F.col("name").alias("session"), "role")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    )


@query(
    "captured_events",
    f"""WITH {_DOC_LINES}
      SELECT 'message_captured' AS lifecycle_event, count(*) AS n FROM conversations WHERE conv_id % 3 < 2 AND role <> 'system'
      UNION ALL SELECT 'transcript_event', count(*) FROM conversations WHERE conv_id % 3 < 2 AND role = 'system'
      UNION ALL SELECT 'transcript_raw', count(*) FROM doc_lines WHERE {_TRIM} <> ''
      UNION ALL SELECT 'agent_discovered', 1
      UNION ALL SELECT 'source_discovered', 1 + count(DISTINCT conv_id % 5) FROM conversations WHERE conv_id % 3 < 2
      UNION ALL SELECT 'session_discovered', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 3 < 2 AND role <> 'system'""",
)
def captured_events(spark, sf):
    events = _captured(spark, sf)["telemetry_stream"]
    return events.groupBy("lifecycle_event").agg(F.count_distinct("id").alias("n"))


@query(
    "capture_report",
    f"""WITH {_DOC_LINES}
      SELECT 'agent_b/' || conv_id AS name, count(*) + 1 AS captured, 0 AS errors FROM conversations WHERE conv_id % 3 < 2 AND role <> 'system' GROUP BY 1
      UNION ALL SELECT 'agent_b/docs', count(*) + 1, 0 FROM doc_lines WHERE {_TRIM} <> ''
      UNION ALL SELECT 'agent_b/proj' || (conv_id % 5), count(*) FILTER (role = 'system') + 1, 0 FROM conversations WHERE conv_id % 3 < 2 GROUP BY 1
      UNION ALL SELECT 'agent_b', 1, 0""",
)
def capture_report(spark, sf):
    rows = _captured(spark, sf)
    return capture.report(rows["telemetry_stream"], rows["state_ledger"])


@query(
    "cursor_offsets",
    f"""WITH {_DOC_LINES} SELECT '/p/docs/d' || doc_id || '.jsonl' AS file, CAST(max(pos + strlen(line) + 1) AS BIGINT) AS "offset",
      CAST(count(*) FILTER ({_TRIM} <> '') AS VARCHAR) AS events FROM doc_lines GROUP BY 1""",
)
def cursor_offsets(spark, sf):
    cursors = _captured(spark, sf)["cursor"]
    found = capture.latest_offsets(cursors).where("file like '/p/docs/%'")
    return found.select("file", "offset", F.col("last_processed").alias("events"))


@query(
    "latest_cursor",
    """SELECT subject, cursor_type, last_processed FROM (SELECT user_id AS subject, event_type AS cursor_type, CAST(event_id AS VARCHAR) AS last_processed,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def latest_cursor(spark, sf):
    cursors = M.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("cursor_type"),
        F.col("event_id").cast("string").alias("last_processed"),
        F.create_map(F.lit("f"), F.col("event_id")).alias("metadata"),
        F.col("ts").alias("valid_from"),
    )
    return capture.latest_cursor(cursors).select("subject", "cursor_type", "last_processed")


@query(
    "second_pass_identities",
    "SELECT DISTINCT 'agent_b/' || conv_id AS name, conv_id < 50 AS created FROM conversations WHERE conv_id % 3 < 2 AND role <> 'system'",
)
def second_pass_identities(spark, sf):
    """Sessions from number 50 on are known already, so only the others are created."""
    source = adapters.BlockTranscripts("/p", "agent_b")
    lines = _shape1_lines(spark, sf)
    messages = L.messages(shape1.route(lines))
    wanted = capture.candidates(capture.file_summary(lines), messages, source)
    known = M.table(spark, sf, "conversations").where("conv_id >= 50").select("conv_id").distinct().select(
        F.expr("concat('l', conv_id)").alias("id"),
        F.expr("concat('e', conv_id)").alias("target"),
        F.lit("attr_session_descriptor").alias("type"),
        F.expr("to_json(named_struct('name', concat('agent_b/', conv_id)))").alias("payload"),
        F.lit(NOW).alias("valid_from"),
    )
    found = capture.resolve(wanted, known).where("kind = 'session'")
    return found.select("name", "created")


@query(
    "enabled_sources",
    c("cur_led", """SELECT s_suppkey AS id FROM supplier LEFT JOIN cur_led l ON l.target = s_nationkey AND l.type = '2-HIGH'
      WHERE coalesce(l.status, 'enabled') <> 'disabled'"""),
)
def enabled_sources(spark, sf):
    sources = M.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("a"), "s_nationkey").alias("adapter")
    )
    modules = M.table(spark, sf, "nation").select(
        F.concat(F.lit("a"), "n_nationkey").alias("name"), F.col("n_nationkey").cast("bigint").alias("id")
    )
    ledger = M.ledger(spark, sf).where("type = '2-HIGH'").withColumn("type", F.lit("attr_module_status"))
    return capture.enabled_sources(sources, modules, ledger).select("id")


@query(
    "project_sources",
    """SELECT DISTINCT 'proj' || (conv_id % 4) AS name, '/g/tmp/proj' || (conv_id % 4) AS locator FROM conversations WHERE conv_id % 3 = 2""",
)
def project_sources(spark, sf):
    source = adapters.ChatTranscripts("/g", "agent_g")
    file = F.col("file")
    files = _shape2_lines(spark, sf).select("file").unionAll(
        M.table(spark, sf, "documents").select(
            F.expr("concat('/g/tmp/background-processes/chats/', doc_id, '.jsonl')")
        )
    )
    return (
        files.where(source.accepts(file))
        .select(source.source_name(file).alias("name"), source.locator(file).alias("locator"))
        .distinct()
    )


@query(
    "attached_documents",
    """SELECT lang AS owner, CASE doc_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime,
      count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1, 2""",
)
def attached_documents(spark, sf):
    name = F.expr("concat('d', doc_id, element_at(array('.md', '.PDF', '.bin'), int(doc_id % 3) + 1))")
    files = M.table(spark, sf, "documents").select(
        F.col("lang").alias("owner"),
        F.concat(F.lit("/files/"), name).alias("file"),
        name.alias("original_name"),
        X.mime_of(name).alias("mime"),
        F.col("n_chars").alias("size"),
    )
    from ..operators import graph as G

    _, states, edges = documents.attach(files, F.lit(NOW))
    listed, _ = G.attachments(edges, states)
    return listed.where("file is not null").groupBy(F.col("entity").alias("owner"), "mime").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    )


@query(
    "json_roots",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN k ELSE NULL END AS k, CASE event_id % 4 WHEN 1 THEN 'n' || k END AS text,
      CASE WHEN event_id % 4 = 2 THEN k END AS number FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
)
def json_roots(spark, sf):
    """Object roots stay; other JSON values become ``{"value": x}``; bad text is null."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    text = (
        F.when(F.expr("event_id % 4 = 0"), F.col("props"))
        .when(F.expr("event_id % 4 = 1"), F.concat(F.lit('"n'), k, F.lit('"')))
        .when(F.expr("event_id % 4 = 2"), k)
        .otherwise("{bad")
    )
    value = J.parse(J.wrap_root(text))
    return M.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        J.int_at(value, "$.k").alias("k"),
        J.str_at(value, "$.value").alias("text"),
        J.int_at(value, "$.value").alias("number"),
    )


@query(
    "timestamps_parsed",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR END AS parsed FROM
      (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""",
)
def timestamps_parsed(spark, sf):
    """RFC 3339 in UTC, with an offset, without a zone, and not a time at all."""
    text = F.expr(
        "CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        " WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")"
        " WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE event_type END"
    )
    return M.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        clock.parse_rfc3339(text).cast("timestamp_ntz").alias("parsed"),
    )


@query(
    "payload_session_keys",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS key,
      left(CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END, 8) AS short FROM events""",
)
def payload_session_keys(spark, sf):
    """A session key counts only when it is a string."""
    payload = F.expr(
        "CASE event_id % 3 WHEN 0 THEN to_json(named_struct('session', string(user_id)))"
        " WHEN 1 THEN to_json(named_struct('session', user_id)) ELSE concat('\"', user_id, '\"') END"
    )
    key = analytics.session_key(payload)
    return M.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), key.alias("key"), X.short_id(key).alias("short")
    )


@query(
    "tail_source",
    f"""WITH {_DOC_LINES} SELECT line, count(*) AS n FROM doc_lines GROUP BY 1""",
)
def tail_source(spark, sf):
    """Document lines written as text files and read back by the tail source in small ranges."""
    folder = scratch_path(spark, "lines")
    lines = M.table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.write.text(folder)
    found = tail.read_lines(spark, f"{folder}/*.txt", splitBytes="100000")
    return found.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
