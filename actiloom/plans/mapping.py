"""The given tables seen as the model's tables, in Spark and as oracle SQL.

Each Spark view has a SQL twin in ``CTES`` computing the same columns from the
plain tables. JSON columns exist only on the Spark side: the oracle gets their
numbers from the columns they were built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonval as J
from ..operators import ordered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EMITTED = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(conv_id * 37 + turn), 0)"

# Shape 1 for agents 0 and 1, shape 2 for agent 2, none for system rows.
_USE_INPUT = """
  CASE (turn div 2) % 4
    WHEN 0 THEN named_struct('content', text, 'new_string', null, 'command', null, 'edits', null)
    WHEN 1 THEN named_struct('content', null, 'new_string', text, 'command', null, 'edits', null)
    WHEN 2 THEN named_struct('content', null, 'new_string', null, 'command', text, 'edits', null)
    ELSE named_struct('content', null, 'new_string', null, 'command', null, 'edits',
                      array(named_struct('new_string', text), named_struct('new_string', 'x\\ny')))
  END"""
TOOL = "element_at(array('Write', 'Edit', 'Bash', 'MultiEdit'), int((turn div 2) % 4) + 1)"

_SHAPE1_ASSISTANT = f"""to_json(named_struct(
  'type', 'assistant', 'sessionId', string(conv_id),
  'timestamp', date_format({EMITTED}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'message', named_struct(
    'role', 'assistant',
    'model', concat('m', conv_id % 3, '-', (turn div 2) % 2),
    'usage', named_struct('input_tokens', turn * 10, 'output_tokens', length(text),
      'cache_read_input_tokens', length(text) * 2, 'cache_creation_input_tokens', turn),
    'content', array(
      named_struct('type', 'text', 'text', text, 'id', null, 'name', null, 'input', null),
      named_struct('type', 'tool_use', 'text', null, 'id', concat('t', conv_id, '-', turn),
        'name', {TOOL}, 'input', {_USE_INPUT})))))"""

_SHAPE1_USER = f"""CASE WHEN turn = 0 THEN to_json(named_struct(
  'type', 'user', 'sessionId', string(conv_id),
  'timestamp', date_format({EMITTED}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'origin', named_struct('kind', 'human'),
  'message', named_struct('role', 'user', 'content', text)))
ELSE to_json(named_struct(
  'type', 'user', 'sessionId', string(conv_id),
  'timestamp', date_format({EMITTED}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'message', named_struct('role', 'user', 'content', array(
    named_struct('type', 'tool_result', 'tool_use_id', concat('t', conv_id, '-', turn - 1),
      'content', text, 'is_error', length(text) % 5 = 0)))))
END"""

_SHAPE2_ASSISTANT = f"""to_json(named_struct(
  'id', concat('g', conv_id, '-', turn), 'type', 'gemini',
  'timestamp', date_format({EMITTED}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'model', 'g1', 'content', text,
  'tokens', named_struct('input', turn, 'output', length(text), 'cached', turn * 3,
    'total', length(text) + turn * 4),
  'toolCalls', array(
    named_struct('name', 'shell', 'status',
      element_at(array('success', 'error', 'cancelled', null), int((turn div 2) % 4) + 1),
      'resultDisplay', text),
    named_struct('name', null, 'status', null, 'resultDisplay', null))))"""

_SHAPE2_USER = f"""to_json(named_struct(
  'id', concat('g', conv_id, '-', turn), 'type', 'user',
  'timestamp', date_format({EMITTED}, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
  'content', array(named_struct('text', text))))"""

RAW = f"""CASE
  WHEN role = 'system' THEN null
  WHEN conv_id % 3 < 2 AND role = 'assistant' THEN {_SHAPE1_ASSISTANT}
  WHEN conv_id % 3 < 2 THEN {_SHAPE1_USER}
  WHEN role = 'assistant' THEN {_SHAPE2_ASSISTANT}
  ELSE {_SHAPE2_USER}
END"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("id"),
        F.col("conv_id").alias("session"),
        F.expr("conv_id % 3").alias("agent"),
        "role",
        F.col("text").alias("content"),
        F.expr(RAW).alias("raw"),
        F.col("turn").alias("seq"),
        F.expr(EMITTED).alias("emitted_at"),
        F.expr(f"{EMITTED} + interval '1' day").alias("valid_from"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    k = J.typed(F.col("props"), "k bigint")["k"]
    payload = F.to_json(
        F.struct(
            k.alias("k"),
            F.col("user_id").cast("string").alias("session"),
            F.expr("concat('mod-', event_id % 17)").alias("name"),
            k.alias("duration_ms"),
        )
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("lifecycle_event"),
        payload.alias("payload"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN (event_id * 7) % 200 END").alias("subject"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END").alias(
            "agent"
        ),
        F.col("ts").alias("valid_from"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return ids.select(
        "id",
        F.expr("id % 3").alias("agent"),
        F.expr("concat('agent_', id % 3)").alias("agent_name"),
        F.col("id").cast("string").alias("source_key"),
        F.expr("concat('agent_', id % 3, '/', id)").alias("name"),
    )


def agents(spark: SparkSession, sf: str) -> DataFrame:
    """Agents 0 and 1 have names; agent 2 stays unattributed."""
    ids = table(spark, sf, "conversations").select(F.expr("conv_id % 3").alias("id")).distinct()
    return ids.where("id < 2").withColumn("name", F.expr("concat('agent_', id)"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.expr("concat('agent_', s_nationkey % 4, '/', s_name)").alias("name"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.expr(
        "to_json(named_struct('name', concat(o_orderstatus, '-', o_orderkey % 997),"
        " 'value', o_orderkey % 7 - 2, 'version', nullif(string(o_orderkey % 5), '0'),"
        " 'status', if(o_orderkey % 3 = 0, 'disabled', 'enabled'),"
        " 'tag', element_at(array('active','failed','skipped','broken'), int(o_orderkey % 4) + 1),"
        " 'startup_duration_ms', o_orderkey % 50 - 5))"
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("target"),
        F.col("o_orderpriority").alias("type"),
        payload.alias("payload"),
        F.col("o_orderdate").alias("valid_from"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("in"),
        F.col("l_suppkey").alias("out"),
        F.expr("l_orderkey - l_linenumber").alias("edge_uid"),
        F.col("l_returnflag").alias("rel_type"),
        F.expr("l_linestatus = 'O'").alias("active"),
        F.col("l_shipdate").alias("valid_from"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
    )


EDGE_ORDER = ("valid_from", "in", "out", "q", "p")


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("uid"),
        F.expr("o_custkey * 2").alias("entity"),
        F.col("o_orderdate").alias("run_at"),
        F.expr(
            "element_at(array('none', 'every:90s', 'every:5x', 'every:2h'), int(o_orderkey % 4) + 1)"
        ).alias("recurrence"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'fired' ELSE 'cancelled' END"
        ).alias("status"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("valid_from"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.expr("l_orderkey * 8 + l_linenumber % 8").alias("id"),
        F.col("l_orderkey").alias("uid"),
        F.expr("l_suppkey").alias("schedule"),
        F.expr("l_orderkey % 500").alias("firing"),
        F.col("l_partkey").alias("task"),
        F.expr(
            "CASE l_returnflag WHEN 'R' THEN 'done' WHEN 'A' THEN 'failed'"
            " ELSE if(l_linestatus = 'O', 'dispatched', 'cancelled') END"
        ).alias("status"),
        F.col("l_shipdate").alias("valid_from"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
    )


RUN_ORDER = ("valid_from", "id", "task", "schedule", "q", "p")


def types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_type").alias("name"),
        F.expr("if(p_size % 2 = 0, 'entity', 'relation')").alias("category"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("description"),
    )


def modules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("uid"),
        F.expr("o_custkey").alias("entity"),
        F.expr("if(o_custkey % 2 = 0, 'kernel_module', 'adapter')").alias("kind"),
        F.expr("concat('v', o_orderkey % 9)").alias("version"),
        F.expr("o_orderstatus = 'F'").alias("provisioned"),
        F.col("o_orderdate").alias("valid_from"),
    )


def customers_as_entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), "c_name", "c_nationkey"
    )


# -- containment tree: region > nation > customer > order ----------------------


def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    nation, customer, orders = (table(spark, sf, t) for t in ("nation", "customer", "orders"))

    def link(df: DataFrame, parent: str, child: str, rel: str = "contains") -> DataFrame:
        return df.select(
            F.expr(parent).alias("in"),
            F.expr(child).alias("out"),
            F.expr(f"concat('{rel[0]}:', {child})").alias("edge_uid"),
            F.lit(rel).alias("rel_type"),
        )

    return (
        link(nation, "concat('r', n_regionkey)", "concat('n', n_nationkey)")
        .unionAll(link(customer, "concat('n', c_nationkey)", "concat('c', c_custkey)"))
        .unionAll(link(orders, "concat('c', o_custkey)", "concat('o', o_orderkey)"))
    )


def linked_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A second, weaker parent of every order: the nation o_orderkey % 25."""
    return table(spark, sf, "orders").select(
        F.expr("concat('n', o_orderkey % 25)").alias("in"),
        F.expr("concat('o', o_orderkey)").alias("out"),
        F.expr("concat('l:o', o_orderkey)").alias("edge_uid"),
        F.lit("linked").alias("rel_type"),
    )


def tree_anchors(spark: SparkSession, sf: str) -> DataFrame:
    region, nation, customer, orders = (
        table(spark, sf, t) for t in ("region", "nation", "customer", "orders")
    )
    start = F.expr("timestamp_ntz'1990-01-01 00:00:00'")

    def nodes(df: DataFrame, ident: str, kind: str, created) -> DataFrame:
        return df.select(
            F.expr(ident).alias("id"), F.expr(kind).alias("entity_type"), created.alias("created_at")
        )

    return (
        nodes(region, "concat('r', r_regionkey)", "'product'", start)
        .unionAll(nodes(nation, "concat('n', n_nationkey)", "'repo'", start))
        .unionAll(nodes(customer, "concat('c', c_custkey)", "'task'", start))
        .unionAll(
            nodes(
                orders,
                "concat('o', o_orderkey)",
                "if(o_orderstatus = 'F', 'text', 'document')",
                F.col("o_orderdate"),
            )
        )
    )


def tree_states(spark: SparkSession, sf: str) -> DataFrame:
    """One version per region and nation, two per customer, one for most orders."""
    region, nation, customer, orders = (
        table(spark, sf, t) for t in ("region", "nation", "customer", "orders")
    )

    def rows(df, sid, entity, name, content, at) -> DataFrame:
        return df.select(
            F.expr(sid).alias("id"),
            F.expr(entity).alias("entity"),
            F.expr(name).alias("name"),
            F.expr(content).alias("content"),
            F.expr(f"to_json(named_struct('original_name', concat({name}, '.md'), 'size', length({name})))").alias("attributes"),
            F.expr(at).alias("valid_from"),
        )

    early, late = "timestamp_ntz'1990-01-01 00:00:00'", "timestamp_ntz'1990-06-01 00:00:00'"
    return (
        rows(region, "concat('r', r_regionkey)", "concat('r', r_regionkey)", "r_name", "null", early)
        .unionAll(
            rows(nation, "concat('n', n_nationkey)", "concat('n', n_nationkey)", "n_name", "null", early)
        )
        .unionAll(
            rows(customer, "concat('c1-', c_custkey)", "concat('c', c_custkey)", "c_mktsegment", "null", early)
        )
        .unionAll(
            rows(customer, "concat('c2-', c_custkey)", "concat('c', c_custkey)", "c_name", "c_mktsegment", late)
        )
        .unionAll(
            rows(
                orders.where("o_orderkey % 10 <> 3"),
                "concat('o', o_orderkey)",
                "concat('o', o_orderkey)",
                "o_orderpriority",
                "o_orderstatus",
                "o_orderdate",
            )
        )
    )


def order_deps(spark: SparkSession, sf: str) -> DataFrame:
    """Every order depends on the same customer's previous order."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"
    )
    chained = ordered.with_running(
        orders,
        ["o_custkey"],
        ["o_orderdate", "o_orderkey"],
        {"dep": ordered.previous_of(F.col("o_orderkey"))},
    )
    return chained.select(
        F.col("o_custkey").alias("firing"), F.col("o_orderkey").alias("task"), "dep", "o_orderstatus"
    )


CTES = {
    "msg": """msg AS (
  SELECT conv_id*1000+turn AS id, conv_id AS session, conv_id % 3 AS agent, role, text AS content,
         turn AS seq, turn // 2 AS k, length(text) AS n,
         TIMESTAMP '2024-01-01' + to_minutes(conv_id*37+turn) AS emitted_at,
         TIMESTAMP '2024-01-02' + to_minutes(conv_id*37+turn) AS valid_from,
         (role = 'assistant' AND conv_id % 3 < 2) AS a1, (role = 'assistant' AND conv_id % 3 = 2) AS a2
  FROM conversations)""",
    "ev": """ev AS (
  SELECT event_id AS id, event_type AS lifecycle_event,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(user_id AS VARCHAR) AS key,
         user_id, 'mod-' || (event_id % 17) AS name,
         CASE WHEN event_id % 5 = 0 THEN (event_id*7) % 200 END AS subject,
         CASE WHEN event_id % 11 = 0 THEN (user_id+1) % 3 ELSE user_id % 3 END AS agent,
         ts AS valid_from
  FROM events)""",
    "sess": """sess AS (
  SELECT DISTINCT conv_id AS id, conv_id % 3 AS agent, 'agent_' || (conv_id % 3) AS agent_name,
         CAST(conv_id AS VARCHAR) AS source_key, 'agent_' || (conv_id % 3) || '/' || conv_id AS name
  FROM conversations)""",
    "ag": """ag AS (
  SELECT DISTINCT conv_id % 3 AS id, 'agent_' || (conv_id % 3) AS name
  FROM conversations WHERE conv_id % 3 < 2)""",
    "led": """led AS (
  SELECT o_orderkey AS id, o_custkey AS target, o_orderpriority AS type,
         o_orderstatus || '-' || (o_orderkey % 997) AS name, o_orderkey % 7 - 2 AS value,
         nullif(CAST(o_orderkey % 5 AS VARCHAR), '0') AS version,
         CASE WHEN o_orderkey % 3 = 0 THEN 'disabled' ELSE 'enabled' END AS status,
         CASE o_orderkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped'
           ELSE 'broken' END AS tag,
         o_orderkey % 50 - 5 AS startup, o_orderdate AS valid_from
  FROM orders)""",
    "edg": """edg AS (
  SELECT l_partkey AS "in", l_suppkey AS "out", l_orderkey-l_linenumber AS edge_uid,
         l_returnflag AS rel_type, l_linestatus = 'O' AS active, l_shipdate AS valid_from,
         l_quantity AS q, l_extendedprice AS p
  FROM lineitem)""",
    "cur_edg": """cur_edg AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_uid
      ORDER BY valid_from DESC, "in" DESC, "out" DESC, q DESC, p DESC) AS rn FROM edg) WHERE rn = 1)""",
    "sch": """sch AS (
  SELECT o_orderkey AS id, o_custkey AS uid, o_custkey*2 AS entity, o_orderdate AS run_at,
         CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'every:90s' WHEN 2 THEN 'every:5x'
           ELSE 'every:2h' END AS recurrence,
         CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'fired' ELSE 'cancelled' END AS status,
         o_orderdate + to_seconds(o_orderkey % 86400) AS valid_from
  FROM orders)""",
    "cur_sch": """cur_sch AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY valid_from DESC, id DESC) AS rn
    FROM sch) WHERE rn = 1)""",
    "rn": """rn AS (
  SELECT l_orderkey*8 + l_linenumber % 8 AS id, l_orderkey AS uid, l_suppkey AS schedule,
         l_orderkey % 500 AS firing, l_partkey AS task,
         CASE l_returnflag WHEN 'R' THEN 'done' WHEN 'A' THEN 'failed'
           ELSE CASE WHEN l_linestatus = 'O' THEN 'dispatched' ELSE 'cancelled' END END AS status,
         l_shipdate AS valid_from, l_quantity AS q, l_extendedprice AS p
  FROM lineitem)""",
    "cur_rn": """cur_rn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid
      ORDER BY valid_from DESC, id DESC, task DESC, schedule DESC, q DESC, p DESC) AS rn FROM rn) WHERE rn = 1)""",
    "typ": """typ AS (
  SELECT p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'entity' ELSE 'relation' END AS category,
         p_partkey AS id, p_name AS description
  FROM part)""",
    "mods": """mods AS (
  SELECT o_orderkey AS id, o_custkey AS uid, o_custkey AS entity,
         CASE WHEN o_custkey % 2 = 0 THEN 'kernel_module' ELSE 'adapter' END AS kind,
         'v' || (o_orderkey % 9) AS version, o_orderstatus = 'F' AS provisioned,
         o_orderdate AS valid_from
  FROM orders)""",
    "cur_led": """cur_led AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, type
      ORDER BY valid_from DESC, id DESC) AS rn FROM led) WHERE rn = 1)""",
    "cont": """cont AS (
  SELECT 'r' || n_regionkey AS "in", 'n' || n_nationkey AS "out" FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)""",
    "tst": """tst AS (
  SELECT 'r' || r_regionkey AS entity, r_name AS name, CAST(NULL AS VARCHAR) AS content,
         TIMESTAMP '1990-01-01' AS version FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, NULL, TIMESTAMP '1990-01-01' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, c_mktsegment, TIMESTAMP '1990-06-01' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders
    WHERE o_orderkey % 10 <> 3)""",
    "tan": """tan AS (
  SELECT 'r' || r_regionkey AS id, 'product' AS entity_type, TIMESTAMP '1990-01-01' AS created_at FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'repo', TIMESTAMP '1990-01-01' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'task', TIMESTAMP '1990-01-01' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'text' ELSE 'document' END,
    o_orderdate FROM orders)""",
    "odep": """odep AS (
  SELECT o_custkey AS firing, o_orderkey AS task, o_orderstatus,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dep,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth,
         count(*) OVER (PARTITION BY o_custkey) AS chain
  FROM orders)""",
}

# CTEs another one reads.
_NEEDS = {
    "cur_edg": ["edg"],
    "cur_sch": ["sch"],
    "cur_rn": ["rn"],
    "cur_led": ["led"],
}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named views in front of an oracle query."""
    wanted: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(CTES[n] for n in wanted) + "\n" + body
