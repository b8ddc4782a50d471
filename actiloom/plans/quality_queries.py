"""Integrity checks over whole tables: accepted and refused rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import model
from ..operators import quality as Q
from . import mapping as M
from .catalog import query

c = M.with_ctes


def _both(split, *columns):
    """Accepted and refused rows in one frame; accepted have no reason."""
    return split.judged.select(*columns, "reason")


@query(
    "ensure_types",
    "SELECT DISTINCT o_orderpriority AS uid FROM orders WHERE o_orderpriority NOT IN (SELECT p_type FROM part)",
)
def ensure_types(spark, sf):
    wanted = M.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("uid"))
    known = M.table(spark, sf, "part").select(F.col("p_type").alias("uid"))
    return Q.ensure_types(known, wanted)


@query(
    "seed_types",
    "SELECT 18 - count(DISTINCT p_type) FILTER (p_type IN ('product','task','rag','model','document','repo','credential','text')) AS created FROM part",
)
def seed_types(spark, sf):
    known = M.types(spark, sf).select("name").distinct()
    rows = Q.seed_graph_types(known, F.current_timestamp())
    return rows.agg(F.count(F.lit(1)).alias("created"))


@query(
    "register_types",
    """WITH req AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name
        ELSE 'kind_' || (p_partkey % 40) END AS name,
        CASE WHEN p_partkey % 5 = 0 THEN 'thing' ELSE 'entity' END AS category FROM part)
      SELECT id, name, CASE WHEN NOT regexp_full_match(name, '[a-z0-9_]+') THEN 'bad name'
        WHEN category <> 'entity' THEN 'bad category'
        WHEN name IN ('kind_1', 'kind_2') THEN 'already registered'
        WHEN id > min(id) OVER (PARTITION BY name) THEN 'asked for twice' END AS reason FROM req""",
)
def register_types(spark, sf):
    requests = M.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("if(p_partkey % 3 = 0, p_name, concat('kind_', p_partkey % 40))").alias("name"),
        F.expr("if(p_partkey % 5 = 0, 'thing', 'entity')").alias("category"),
    )
    known = spark.createDataFrame([("kind_1",), ("kind_2",)], "name string")
    return _both(Q.register_types(known, requests), "id", "name")


_CATEGORY = """WITH t AS (SELECT p_type AS uid, min(CASE WHEN p_type < 'M' THEN 'node' ELSE 'edge' END) AS category
    FROM part GROUP BY 1),
  e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE p_type END AS type FROM part)
  SELECT id, type, CASE WHEN t.uid IS NULL THEN 'unknown type'
    WHEN category <> 'node' THEN 'is of category edge, not node' END AS reason
  FROM e LEFT JOIN t ON type = uid"""


@query("type_rejects", _CATEGORY)
def type_rejects(spark, sf):
    part = M.table(spark, sf, "part")
    types = part.select(
        F.col("p_type").alias("uid"), F.expr("if(p_type < 'M', 'node', 'edge')").alias("category")
    ).distinct()
    rows = part.select(
        F.col("p_partkey").alias("id"),
        F.expr("if(p_partkey % 9 = 0, p_brand, p_type)").alias("type"),
    )
    return _both(Q.check_category(rows, types, "node"), "id", "type")


@query(
    "role_rejects",
    c("msg", """SELECT id, CASE WHEN session % 7 = 0 OR session >= 90 THEN 'session is not a session'
      WHEN agent = 2 THEN 'agent is not a agent' END AS reason FROM msg WHERE role <> 'system'
      UNION ALL SELECT id, CASE WHEN session % 7 = 0 OR session >= 90 THEN 'session is not a session' END
      FROM msg WHERE role = 'system'"""),
)
def role_rejects(spark, sf):
    conv = M.table(spark, sf, "conversations")
    rows = M.messages(spark, sf).select(
        "id",
        F.concat(F.lit("s"), "session").alias("session"),
        F.when(F.col("role") != "system", F.concat(F.lit("a"), "agent")).alias("agent"),
    )
    entities = (
        conv.where("conv_id < 90")
        .select(
            F.expr("concat('s', conv_id)").alias("id"),
            F.expr("if(conv_id % 7 = 0, 'source', 'session')").alias("type"),
        )
        .distinct()
        .unionAll(
            conv.select(
                F.expr("concat('a', conv_id % 3)"), F.expr("if(conv_id % 3 = 2, 'source', 'agent')")
            ).distinct()
        )
    )
    roles = {"session": ("session", False), "agent": ("agent", True)}
    return _both(Q.check_endpoint_roles(rows, entities, roles), "id")


@query(
    "enum_rejects",
    c("sch", """SELECT id, CASE WHEN status NOT IN ('scheduled', 'fired') THEN 'bad status'
      WHEN recurrence <> 'none' THEN 'bad recurrence' END AS reason FROM sch"""),
)
def enum_rejects(spark, sf):
    allowed = {"status": model.SCHEDULE_STATUSES[:2], "recurrence": ["none"]}
    return _both(Q.check_enums(M.schedules(spark, sf), allowed), "id")


_WORDS = {
    "type_definition": {"category": "node edge attribute thing", "memory_tier": "core working archival recall cold"},
    "cursor_type": {"category": "workload telemetry other"},
    "module": {"kind": "kernel_module adapter plugin"},
    "entity_type": {"category": "entity relation node"},
    "schedule": {"status": "scheduled fired cancelled done"},
    "run": {"status": "dispatched done failed cancelled scheduled"},
}


@query(
    "vocabulary_rejects",
    """SELECT 'type_definition' AS checked, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'bad category' ELSE 'bad memory_tier' END AS reason
        FROM orders WHERE o_orderkey % 4 = 3 OR o_orderkey % 5 = 4
      UNION ALL SELECT unnest(['cursor_type', 'entity_type', 'module']), o_orderkey, unnest(['bad category', 'bad category', 'bad kind']) FROM orders WHERE o_orderkey % 3 = 2
      UNION ALL SELECT 'schedule', o_orderkey, 'bad status' FROM orders WHERE o_orderkey % 4 = 3
      UNION ALL SELECT 'run', o_orderkey, 'bad status' FROM orders WHERE o_orderkey % 5 = 4""",
)
def vocabulary_rejects(spark, sf):
    """Orders as rows of every table with fixed words, the last word of each list being none of them."""
    orders, found = M.table(spark, sf, "orders"), []
    for name, columns in _WORDS.items():
        words = {c: F.array(*map(F.lit, w.split())) for c, w in columns.items()}
        held = [F.element_at(w, (F.col("o_orderkey") % F.size(w) + 1).cast("int")).alias(c) for c, w in words.items()]
        _, refused = Q.check_vocabulary(orders.select(F.col("o_orderkey").alias("id"), *held), name)
        found.append(refused.select(F.lit(name).alias("checked"), "id", "reason"))
    return reduce(lambda a, b: a.unionAll(b), found)


@query(
    "duplicate_keys",
    c("edg", "SELECT edge_uid, count(*) AS copies FROM edg GROUP BY 1 HAVING count(*) > 1"),
)
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(M.edges(spark, sf), ["edge_uid"])


@query(
    "endpoint_rejects",
    """SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS "in",
      CASE WHEN p_partkey IS NULL THEN 'unknown source' WHEN s_suppkey IS NULL THEN 'unknown target' END AS reason
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = l_partkey
    LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey""",
)
def endpoint_rejects(spark, sf):
    rows = M.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("a"),
        F.col("l_linenumber").alias("b"),
        F.col("l_partkey").alias("in"),
        F.concat(F.lit("s"), "l_suppkey").alias("out"),
        F.concat(F.lit("p"), "l_partkey").alias("_p"),
    ).withColumnsRenamed({"in": "part", "_p": "in"})
    anchors = (
        M.table(spark, sf, "part").where("p_size > 3").select(F.expr("concat('p', p_partkey)").alias("id"))
    ).unionAll(
        M.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.expr("concat('s', s_suppkey)"))
    )
    both = _both(Q.check_endpoints(rows, anchors), "a", "b", "part")
    return both.withColumnRenamed("part", "in")


_LINKED = """live AS (SELECT "in", "out", rel_type, min(edge_uid) AS edge_uid FROM cur_edg WHERE active GROUP BY ALL)"""


@query(
    "link_rejects",
    c("cur_edg", f""", {_LINKED},
      req AS (SELECT l_orderkey*10+l_linenumber AS id, l_suppkey AS "in", l_partkey % 120 AS "out", l_returnflag AS rel_type FROM lineitem
        UNION ALL SELECT -(l_orderkey*10+l_linenumber)-1, l_partkey, l_suppkey, l_returnflag FROM lineitem),
      f AS (SELECT *, min(id) OVER (PARTITION BY "in", "out", rel_type) AS first FROM req)
      SELECT id, f."in", f."out", CASE WHEN f.rel_type = 'N' THEN 'unknown relation' WHEN f."in" = f."out" THEN 'self link'
        WHEN live."in" IS NOT NULL THEN 'already linked' WHEN id <> first THEN 'asked for twice' END AS reason
      FROM f LEFT JOIN live ON f."in" = live."in" AND f."out" = live."out" AND f.rel_type = live.rel_type"""),
)
def link_rejects(spark, sf):
    lines = M.table(spark, sf, "lineitem")
    requests = lines.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("id"),
        F.col("l_suppkey").alias("in"),
        F.expr("l_partkey % 120").alias("out"),
        F.col("l_returnflag").alias("rel_type"),
    ).unionAll(
        lines.select(
            F.expr("-(l_orderkey * 10 + l_linenumber) - 1"), "l_partkey", "l_suppkey", "l_returnflag"
        )
    )
    types = spark.createDataFrame([("R", "relation"), ("A", "relation"), ("N", "entity")], "name string, category string")
    split = Q.check_links(requests, types, M.edges(spark, sf), M.EDGE_ORDER)
    return _both(split, "id", "in", "out")


@query(
    "unlink_rejects",
    c("cur_edg", f""", {_LINKED},
      req AS (SELECT DISTINCT l_partkey AS "in", l_suppkey AS "out", l_returnflag AS rel_type FROM lineitem)
      SELECT req.*, edge_uid, CASE WHEN edge_uid IS NULL THEN 'no active link' END AS reason
      FROM req LEFT JOIN live USING ("in", "out", rel_type)"""),
)
def unlink_rejects(spark, sf):
    edges = M.edges(spark, sf)
    rows, refused = Q.unlink(
        edges.select("in", "out", "rel_type"), edges, F.current_timestamp(), M.EDGE_ORDER
    )
    ends = ["in", "out", "rel_type"]
    return rows.select(*ends, "edge_uid", F.lit(None).cast("string").alias("reason")).unionAll(
        refused.select(*ends, F.lit(None).cast("bigint"), "reason")
    )


@query(
    "require_types",
    """WITH t AS (SELECT p_type AS name, min(CASE WHEN p_type < 'M' THEN 'entity' ELSE 'relation' END) AS category FROM part GROUP BY 1)
      SELECT p_partkey AS id, CASE WHEN t.name IS NULL THEN 'unknown type'
        WHEN t.category <> 'relation' THEN 'is of category entity, not relation' END AS reason
      FROM part LEFT JOIN t ON t.name = CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type END""",
)
def require_types(spark, sf):
    part = M.table(spark, sf, "part")
    types = part.select(
        F.col("p_type").alias("name"), F.expr("if(p_type < 'M', 'entity', 'relation')").alias("category")
    ).distinct()
    rows = part.select(
        F.col("p_partkey").alias("id"),
        F.expr("if(p_partkey % 4 = 0, p_name, p_type)").alias("kind"),
    )
    return _both(Q.require_types(rows, types, "relation", "kind"), "id")


@query(
    "attribute_rejects",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 1 THEN 'not an object' WHEN 2 THEN 'not JSON' END AS reason
      FROM events""",
)
def attribute_rejects(spark, sf):
    text = F.expr(
        "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']')"
        " WHEN 2 THEN concat(props, '}') ELSE '  ' END"
    )
    rows = M.table(spark, sf, "events").select(F.col("event_id").alias("id"), text.alias("attributes"))
    return _both(Q.check_attributes(rows), "id")


@query(
    "duration_parse",
    """WITH d AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_size || 's' WHEN 1 THEN '0' || p_size || 'm'
        WHEN 2 THEN p_size || 'h' WHEN 3 THEN p_size || 'd' WHEN 4 THEN '-' || p_size || 'm'
        WHEN 5 THEN p_size || '.5h' WHEN 6 THEN CAST(p_size AS VARCHAR) ELSE 'm' END AS raw, p_size, p_partkey % 8 AS k FROM part)
      SELECT id, raw, CASE k WHEN 0 THEN p_size WHEN 1 THEN p_size*60 WHEN 2 THEN p_size*3600 WHEN 3 THEN p_size*86400 END::BIGINT AS seconds,
        CASE k WHEN 0 THEN p_size || 's' WHEN 1 THEN p_size || 'm' WHEN 2 THEN p_size || 'h' WHEN 3 THEN p_size || 'd' END AS token,
        CASE WHEN k > 3 THEN 'not a duration' END AS reason FROM d""",
)
def duration_parse(spark, sf):
    raw = F.expr(
        "CASE p_partkey % 8 WHEN 0 THEN concat(p_size, 's') WHEN 1 THEN concat('0', p_size, 'm')"
        " WHEN 2 THEN concat(p_size, 'h') WHEN 3 THEN concat(p_size, 'd') WHEN 4 THEN concat('-', p_size, 'm')"
        " WHEN 5 THEN concat(p_size, '.5h') WHEN 6 THEN string(p_size) ELSE 'm' END"
    )
    rows = M.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))
    return _both(Q.check_durations(rows, "raw"), "id", "raw", "seconds", "token")
