"""Filters, lookups, search and pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import jsonval as J
from ..operators import lookup as L
from ..operators import ordered
from ..operators import schedule as S
from ..operators import versioned as V
from . import mapping as M
from .catalog import query

c = M.with_ctes
MARK = dt.datetime(2024, 1, 15, 12, 0, 0)
MSG_MARK = dt.datetime(2024, 1, 3, 0, 0, 0)


@query(
    "find_types",
    """SELECT c_mktsegment AS uid, CAST(NULL AS BIGINT) AS n, true AS missing FROM customer
      GROUP BY 1 HAVING c_mktsegment NOT IN (SELECT p_type FROM part)
    UNION ALL SELECT p_type, count(*), false FROM part GROUP BY 1""",
)
def find_types(spark, sf):
    types = M.types(spark, sf).groupBy(F.col("name").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    segments = M.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("uid"))
    wanted = types.select("uid").union(segments).distinct()
    found, missing = L.find_type(types, wanted)
    return found.select("uid", "n", F.lit(False).alias("missing")).unionAll(
        missing.select("uid", F.lit(None).cast("bigint"), F.lit(True))
    )


@query(
    "find_by_current_name",
    c("led", """, urgent AS (SELECT * FROM led WHERE type = '1-URGENT'),
      claims AS (SELECT name, target FROM (SELECT *, row_number() OVER (
        PARTITION BY name ORDER BY valid_from DESC, id DESC) AS n FROM urgent) WHERE n = 1),
      cur AS (SELECT target, name FROM (SELECT *, row_number() OVER (
        PARTITION BY target ORDER BY valid_from DESC, id DESC) AS n FROM urgent) WHERE n = 1)
      SELECT name, target FROM claims JOIN cur USING (target, name)"""),
)
def find_by_current_name(spark, sf):
    return L.find_by_current_name(M.customers_as_entities(spark, sf), M.ledger(spark, sf), "1-URGENT")


@query(
    "list_named",
    c("cur_led", """SELECT c_custkey AS id, c_mktsegment AS type, l.name AS name FROM customer
      JOIN cur_led l ON l.target = c_custkey AND l.type = '2-HIGH'"""),
)
def list_named(spark, sf):
    rows = L.list_named(M.customers_as_entities(spark, sf), M.ledger(spark, sf), "2-HIGH")
    return rows.select("id", "type", "name")


_FRAGMENTS = ["agent_1/7", "1/70", "0/9", "agent_2/5", "nothing", "agent_0/3"]


@query(
    "fragment_resolution",
    c("sess", """, q(fragment) AS (VALUES ('agent_1/7'),('1/70'),('0/9'),('agent_2/5'),('nothing'),('agent_0/3')),
      hits AS (SELECT fragment, count(id) AS matches, min(id) AS one FROM q LEFT JOIN sess
        ON contains(name, fragment) OR contains(agent || '/' || id, fragment) GROUP BY 1)
      SELECT fragment, matches, CASE WHEN matches = 0 THEN 'unknown' WHEN matches = 1 THEN 'found'
        ELSE 'ambiguous' END AS outcome, CASE WHEN matches = 1 THEN one END AS id FROM hits"""),
)
def fragment_resolution(spark, sf):
    return L.resolve_sessions(M.sessions(spark, sf), _FRAGMENTS)


@query(
    "entity_fragments",
    """WITH q(fragment) AS (VALUES ('99'),('1499'),('c0'),('12'))
      SELECT fragment, count(c_custkey) AS matches, CASE count(c_custkey) WHEN 0 THEN 'unknown'
        WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome,
        CASE WHEN count(c_custkey) = 1 THEN min(c_custkey) END AS id
      FROM q LEFT JOIN customer ON contains(CAST(c_custkey AS VARCHAR), fragment) GROUP BY 1""",
)
def entity_fragments(spark, sf):
    rows = M.table(spark, sf, "customer")
    text = F.col("c_custkey").cast("string")
    return L.resolve_fragments(rows, "c_custkey", [text], ["99", "1499", "c0", "12"])


@query(
    "resolve_module",
    """SELECT c_custkey AS uid, c_name AS name FROM customer
      WHERE c_name = 'Customer#000000012' OR contains(CAST(c_custkey AS VARCHAR), 'Customer#000000012')
      ORDER BY CASE WHEN c_name = 'Customer#000000012' THEN 0 ELSE 1 END, c_custkey LIMIT 1""",
)
def resolve_module(spark, sf):
    modules = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("uid"), F.col("c_name").alias("name")
    )
    return L.resolve_module(modules, "Customer#000000012")


@query("keyword_messages", c("msg", "SELECT id, session, role FROM msg WHERE contains(lower(content), 'ough')"))
def keyword_messages(spark, sf):
    found = L.search_messages(M.messages(spark, sf), " OUGH ")
    return found.select("id", "session", "role")


@query(
    "keyword_documents",
    "SELECT doc_id AS id, lang, n_chars FROM documents WHERE contains(lower(text), 'the')",
)
def keyword_documents(spark, sf):
    docs = M.table(spark, sf, "documents").withColumnRenamed("text", "content")
    return L.search_messages(docs, "The").select(F.col("doc_id").alias("id"), "lang", "n_chars")


@query(
    "keyword_events",
    c("ev", """SELECT id, lifecycle_event FROM ev WHERE contains(lower(lifecycle_event), '-1')
      OR contains(name, '-1') OR contains(key, '-1')"""),
)
def keyword_events(spark, sf):
    return L.search_events(M.events(spark, sf), "-1").select("id", "lifecycle_event")


@query(
    "keyword_events_number",
    c("ev", "SELECT id, lifecycle_event FROM ev WHERE contains(key, '14') OR contains(name, '14')"),
)
def keyword_events_number(spark, sf):
    """A number in an unsearched or non-string field does not match."""
    return L.search_events(M.events(spark, sf), "14").select("id", "lifecycle_event")


@query(
    "page_before",
    c("ev", """SELECT id, valid_from FROM ev WHERE valid_from < TIMESTAMP '2024-01-15 12:00:00' AND agent = 1
      AND contains(lower(lifecycle_event), 'e') ORDER BY valid_from DESC, id DESC LIMIT 500"""),
)
def page_before(spark, sf):
    rows = M.events(spark, sf)
    found = L.page(rows, F.col("agent") == 1, MARK, F.contains(F.lower("lifecycle_event"), F.lit("e")))
    return found.select("id", "valid_from")


@query(
    "telemetry_since",
    c("ev", """SELECT id, valid_from FROM ev WHERE valid_from > TIMESTAMP '2024-01-15 12:00:00'
      ORDER BY valid_from, id LIMIT 200"""),
)
def telemetry_since(spark, sf):
    return L.since(M.events(spark, sf), MARK, 200).select("id", "valid_from")


@query(
    "messages_since",
    c("msg", """SELECT id, valid_from FROM msg WHERE valid_from > TIMESTAMP '2024-01-03 00:00:00'
      ORDER BY valid_from, id LIMIT 200"""),
)
def messages_since(spark, sf):
    return L.since(M.messages(spark, sf), MSG_MARK, 200).select("id", "valid_from")


@query(
    "session_messages_since",
    c("msg", """SELECT id, valid_from FROM msg WHERE session = 39 AND valid_from > TIMESTAMP '2024-01-03 00:00:00'
      ORDER BY valid_from, id LIMIT 200"""),
)
def session_messages_since(spark, sf):
    scope = F.col("session") == 39
    return L.since(M.messages(spark, sf), MSG_MARK, 200, scope).select("id", "valid_from")


@query(
    "agent_newest",
    c("ev", """SELECT agent, id, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY agent
      ORDER BY valid_from DESC, id DESC) AS n FROM ev) WHERE n <= 100"""),
)
def agent_newest(spark, sf):
    rows = M.events(spark, sf).select("agent", "id", "valid_from")
    return L.agent_newest(rows, 100)


@query(
    "agent_newest_messages",
    c("msg", "SELECT id, valid_from FROM msg WHERE agent = 2 ORDER BY valid_from DESC, id DESC LIMIT 50"),
)
def agent_newest_messages(spark, sf):
    return L.agent_newest(M.messages(spark, sf), 50, agent=2).select("id", "valid_from")


@query(
    "session_transcript",
    c("msg", "SELECT id, role, content FROM msg WHERE session = 42 ORDER BY valid_from, id LIMIT 10000"),
)
def session_transcript(spark, sf):
    return L.transcript(M.messages(spark, sf), 42).select("id", "role", "content")


@query("high_water", c("msg", "SELECT max(valid_from) AS high_water FROM msg"))
def high_water(spark, sf):
    return L.high_water(M.messages(spark, sf))


@query(
    "recent_events",
    c("ev", "SELECT id, lifecycle_event, valid_from FROM ev ORDER BY valid_from DESC, id DESC LIMIT 300"),
)
def recent_events(spark, sf):
    return L.recent(M.events(spark, sf), 300).select("id", "lifecycle_event", "valid_from")


@query(
    "recent_events_of_agent",
    c("ev", "SELECT id, valid_from FROM ev WHERE agent = 0 ORDER BY valid_from DESC, id DESC LIMIT 300"),
)
def recent_events_of_agent(spark, sf):
    return L.recent(M.events(spark, sf), 300, agent=0).select("id", "valid_from")


@query(
    "entity_list",
    c("tan tst", """SELECT id, entity_type, coalesce(name, '') AS name, created_at FROM tan
      LEFT JOIN tst ON id = entity WHERE entity_type <> 'text'"""),
)
def entity_list(spark, sf):
    rows = L.entity_list(M.tree_anchors(spark, sf), M.tree_states(spark, sf), hide_text=True)
    return rows.select("id", "entity_type", "name", "created_at")


@query(
    "list_search",
    "SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '#00000012') OR contains(CAST(c_custkey AS VARCHAR), '#00000012')",
)
def list_search(spark, sf):
    rows = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return L.list_search(rows, "#00000012")


@query("type_list", c("typ", "SELECT DISTINCT category, name FROM typ"))
def type_list(spark, sf):
    return L.type_list(M.types(spark, sf).select("category", "name").distinct())


@query(
    "entity_kinds",
    c("typ", "SELECT name, min(description) AS description, name = 'text' AS system FROM typ WHERE category = 'entity' GROUP BY name"),
)
def entity_kinds(spark, sf):
    types = M.types(spark, sf).groupBy("name", "category").agg(F.min("description").alias("description"))
    return L.entity_kinds(types)


@query("relation_names", c("typ", "SELECT DISTINCT name FROM typ WHERE category = 'relation'"))
def relation_names(spark, sf):
    return L.relation_names(M.types(spark, sf).select("name", "category").distinct())


@query(
    "anchor_info",
    c("tan", """SELECT 'o' || (l_orderkey + 3) AS id, min(entity_type) AS entity_type, min(created_at) AS created_at
      FROM lineitem LEFT JOIN tan ON id = 'o' || (l_orderkey + 3) GROUP BY 1"""),
)
def anchor_info(spark, sf):
    asked = M.table(spark, sf, "lineitem").select(F.expr("concat('o', l_orderkey + 3)").alias("id"))
    found, missing = L.anchor_info(M.tree_anchors(spark, sf), asked)
    return found.select("id", "entity_type", "created_at").unionAll(
        missing.select("id", F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"))
    )


@query("due_schedules", c("cur_sch", "SELECT uid, run_at FROM cur_sch WHERE status = 'scheduled' AND run_at <= TIMESTAMP '1999-01-01'"))
def due_schedules(spark, sf):
    return S.due(M.schedules(spark, sf), dt.datetime(1999, 1, 1)).select("uid", "run_at")


@query(
    "queue_view",
    c("cur_sch", """SELECT uid, entity, coalesce(c_name, '(unresolved)') AS name, run_at, recurrence
      FROM cur_sch LEFT JOIN customer ON c_custkey = entity WHERE status = 'scheduled'"""),
)
def queue_view(spark, sf):
    names = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    return S.queue_view(M.schedules(spark, sf), names)


@query(
    "parameter_values",
    c("cur_led", "SELECT target, CASE WHEN value > 0 THEN value ELSE 500 END AS value FROM cur_led WHERE type = '5-LOW'"),
)
def parameter_values(spark, sf):
    """The parameter rule for every target at once: not positive means the default."""
    current = V.current_state(M.ledger(spark, sf).where("type = '5-LOW'"))
    value = J.int_field(F.col("payload"), "value")
    return current.select("target", F.when(value > 0, value).otherwise(500).alias("value"))


@query(
    "parameter_default",
    c("led", "SELECT CASE WHEN value > 0 THEN value ELSE 77 END AS value FROM led WHERE type = '5-LOW' ORDER BY valid_from DESC, id DESC LIMIT 1"),
)
def parameter_default(spark, sf):
    return L.positive_parameter(M.ledger(spark, sf), "5-LOW", 77)


@query(
    "parameter_write",
    c("led", """SELECT c_custkey AS target, c_nationkey::BIGINT AS value FROM customer"""),
)
def parameter_write(spark, sf):
    requests = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("target"),
        F.lit("attr_stats_window").alias("type"),
        F.col("c_nationkey").cast("string").alias("value"),
    )
    ledger = M.ledger(spark, sf)
    rows = L.parameter_rows(requests, F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    after = V.current_state(
        ledger.withColumn("id", F.col("id").cast("string")).unionByName(rows)
    ).where("type = 'attr_stats_window'")
    return after.select("target", J.int_field(F.col("payload"), "value").alias("value"))


@query(
    "session_key_parts",
    c("sess", "SELECT id, agent_name, source_key FROM sess"),
)
def session_key_parts(spark, sf):
    rows = M.sessions(spark, sf).select("id", "name")
    return L.session_names(rows).select("id", "agent_name", "source_key")


@query(
    "newest_per_session",
    c("msg", """SELECT session, id FROM (SELECT *, row_number() OVER (PARTITION BY session
      ORDER BY valid_from DESC, id DESC) AS nth FROM msg) WHERE nth <= 2"""),
)
def newest_per_session(spark, sf):
    rows = M.messages(spark, sf).select("session", "id", "valid_from")
    return ordered.newest_per_key(rows, ["session"], V.ORDER, 2).select("session", "id")
