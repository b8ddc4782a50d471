"""Schedules, runs, waves, blocked and runnable work, task context."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import schedule as S
from ..operators import versioned as V
from . import mapping as M
from .catalog import query

c = M.with_ctes
_NOW = "timestamp_ntz'2024-06-01 00:00:00'"


@query(
    "recurrence",
    c("cur_sch", """SELECT uid, entity, recurrence, 'scheduled' AS status, TIMESTAMP '2024-06-01' + CASE recurrence
      WHEN 'every:90s' THEN INTERVAL 90 SECOND ELSE INTERVAL 2 HOUR END AS run_at
      FROM cur_sch WHERE status = 'fired' AND recurrence IN ('every:90s', 'every:2h')"""),
)
def recurrence(spark, sf):
    rows = S.recurrence(M.schedules(spark, sf), F.expr(_NOW))
    return rows.select("uid", "entity", "recurrence", "status", "run_at")


@query(
    "schedule_cancel",
    c("cur_sch", """, req AS (SELECT c_custkey AS uid FROM customer UNION SELECT c_custkey + 100000000 FROM customer WHERE c_nationkey = 3)
      SELECT req.uid AS uid, CASE WHEN cur_sch.uid IS NULL THEN 'unknown schedule' WHEN status = 'cancelled' THEN 'already cancelled' END AS reason,
        CASE WHEN status <> 'cancelled' THEN entity END AS entity, CASE WHEN status <> 'cancelled' THEN recurrence END AS recurrence
      FROM req LEFT JOIN cur_sch ON cur_sch.uid = req.uid"""),
)
def schedule_cancel(spark, sf):
    customer = M.table(spark, sf, "customer")
    requests = customer.select(F.col("c_custkey").alias("uid")).unionAll(
        customer.where("c_nationkey = 3").select(F.expr("c_custkey + 100000000"))
    )
    current = V.current_schedules(M.schedules(spark, sf))
    rows, refused = S.transition(current, requests, "cancelled", F.expr(_NOW))
    none = F.lit(None)
    return rows.select("uid", none.cast("string").alias("reason"), "entity", "recurrence").unionAll(
        refused.select("uid", "reason", none.cast("bigint"), none.cast("string"))
    )


@query(
    "schedule_create",
    "SELECT c_custkey AS entity, 'none' AS recurrence, 'scheduled' AS status, count(*) AS chains FROM customer GROUP BY 1",
)
def schedule_create(spark, sf):
    requests = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.expr(_NOW).alias("run_at"),
        F.lit(None).cast("string").alias("recurrence"),
    )
    rows = S.create_schedules(requests, F.expr(_NOW))
    return rows.groupBy("entity", "recurrence", "status").agg(
        F.count_distinct("uid").alias("chains")
    )


@query(
    "run_transitions",
    c("cur_rn", "SELECT uid, firing, task, CASE WHEN status = 'dispatched' THEN 'done' ELSE status END AS status FROM cur_rn"),
)
def run_transitions(spark, sf):
    """Every dispatched run is reported done; the current view then says so."""
    runs = M.runs(spark, sf).select(
        F.concat_ws(
            "-", *[F.lpad(F.col(x).cast("string"), 14, "0") for x in M.RUN_ORDER[1:]]
        ).alias("id"),
        "uid", "schedule", "firing", "task", "status", "valid_from",
    )
    dispatched = V.current_runs(runs).where("status = 'dispatched'")
    done = S.run_rows(dispatched.withColumn("status", F.lit("done")), F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    after = V.current_runs(runs.unionByName(done.select(*runs.columns)))
    return after.select("uid", "firing", "task", "status")


def _chain(spark, sf):
    chain = M.order_deps(spark, sf)
    return chain.select("task"), chain.where("dep is not null").select("task", "dep")


@query("waves", c("odep", "SELECT task, CAST(nth AS INTEGER) AS wave FROM odep"))
def waves(spark, sf):
    placed, _ = S.waves(*_chain(spark, sf))
    return placed


@query("stop_order", c("odep", "SELECT task, CAST(chain - nth + 1 AS INTEGER) AS wave FROM odep"))
def stop_order(spark, sf):
    return S.reverse_waves(*_chain(spark, sf))


_LINKS = """links AS (SELECT c_custkey AS task, CAST(c_nationkey AS BIGINT) AS dep FROM customer WHERE c_custkey % 5 <> 4),
  nodes AS (SELECT c_custkey AS task FROM customer),
  reach(a, b) AS (SELECT task, dep FROM links UNION SELECT a, dep FROM reach JOIN links ON task = b),
  cyc AS (SELECT a AS task FROM reach WHERE a = b),
  stuck AS (SELECT DISTINCT a AS task FROM reach WHERE b IN (SELECT task FROM cyc) UNION SELECT task FROM cyc)"""


def _nation_links(spark, sf):
    """A customer depends on the customer numbered like its nation; some of these form cycles."""
    customer = M.table(spark, sf, "customer")
    nodes = customer.select(F.col("c_custkey").alias("task"))
    links = customer.where("c_custkey % 5 <> 4").select(
        F.col("c_custkey").alias("task"), F.col("c_nationkey").cast("bigint").alias("dep")
    )
    return nodes, links


@query("cycle_members", f"WITH RECURSIVE {_LINKS} SELECT task FROM cyc")
def cycle_members(spark, sf):
    return S.cycle_members(_nation_links(spark, sf)[1])


@query(
    "cycle_members_dense",
    c("cur_edg", """, links AS (SELECT DISTINCT "in" AS a, "out" AS b FROM cur_edg WHERE active),
      reach(a, b) AS (SELECT s_suppkey, b FROM supplier JOIN links ON a = s_suppkey UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
      SELECT a AS task FROM reach WHERE a = b""", recursive=True),
)
def cycle_members_dense(spark, sf):
    from ..operators import graph as G

    active = G.active_edges(M.edges(spark, sf), M.EDGE_ORDER)
    return S.cycle_members(active.select(F.col("in").alias("task"), F.col("out").alias("dep")))


@query(
    "stuck_tasks",
    f"WITH RECURSIVE {_LINKS} SELECT task, task IN (SELECT task FROM cyc) AS on_cycle FROM stuck",
)
def stuck_tasks(spark, sf):
    return S.classify_stuck(*_nation_links(spark, sf))


@query(
    "blocked",
    c("odep", """SELECT a.task AS task FROM odep a WHERE EXISTS (SELECT 1 FROM odep b
      WHERE b.firing = a.firing AND b.nth < a.nth AND b.o_orderstatus = 'P')"""),
)
def blocked(spark, sf):
    """Orders behind a failed (status P) order."""
    chain = M.order_deps(spark, sf)
    failed = chain.where("o_orderstatus = 'P'").select("task")
    return S.blocked(_chain(spark, sf)[1], failed)


@query(
    "runnable",
    c("odep", """SELECT firing, task FROM (SELECT a.firing, a.task, row_number() OVER (PARTITION BY a.firing ORDER BY a.task) AS n
      FROM odep a LEFT JOIN odep b ON b.task = a.dep
      WHERE a.o_orderstatus = 'O' AND (a.dep IS NULL OR b.o_orderstatus = 'F')) WHERE n <= 2"""),
)
def runnable(spark, sf):
    """Every customer's orders as one firing; F is done, P failed, O not dispatched."""
    chain = M.order_deps(spark, sf)
    status = chain.where("o_orderstatus <> 'O'").select(
        "firing", "task", F.expr("if(o_orderstatus = 'F', 'done', 'failed')").alias("status")
    )
    deps = chain.where("dep is not null").select("firing", "task", "dep")
    return S.runnable(chain.select("firing", "task"), deps, status, slots=2)


@query(
    "outcome_propagation",
    c("odep", """, f AS (SELECT *, min(CASE WHEN o_orderstatus = 'P' THEN nth END) OVER (PARTITION BY firing) AS bad FROM odep)
      SELECT task, CASE WHEN bad IS NULL OR nth < bad THEN 'active' WHEN nth = bad THEN 'failed' ELSE 'skipped' END AS outcome,
        CASE WHEN nth > bad THEN 'dependency ''' || dep || ''' is ' || CASE WHEN nth = bad + 1 THEN 'failed' ELSE 'skipped' END END AS reason FROM f"""),
)
def outcome_propagation(spark, sf):
    chain = M.order_deps(spark, sf)
    tasks = chain.select("task", F.expr("if(o_orderstatus = 'P', 'failed', 'active')").alias("outcome"))
    deps = chain.where("dep is not null").select("task", "dep", F.lit(0).alias("position"))
    return S.outcomes(tasks, deps)


def _context_parts(spark, sf):
    """Customers are tasks, their orders hang on them as instructions or context."""
    customer, orders = M.table(spark, sf, "customer"), M.table(spark, sf, "orders")
    nodes = customer.select(
        F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("root"),
        F.expr("concat('c', c_custkey)").alias("node"),
        F.lit("task").alias("entity_type"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("content"),
        F.lit(None).cast("string").alias("attributes"),
        F.lit(None).cast("timestamp_ntz").alias("version"),
    ).unionByName(
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("root"),
            F.expr("concat('o', o_orderkey)").alias("node"),
            F.expr("if(o_orderstatus = 'F', 'text', 'rag')").alias("entity_type"),
            F.col("o_orderpriority").alias("name"),
            F.expr("if(o_orderstatus = 'F', concat('do ', o_orderkey), null)").alias("content"),
            F.expr("if(o_orderstatus = 'P', '{\"a\":1}', null)").alias("attributes"),
            F.col("o_orderdate").alias("version"),
        )
    ).unionByName(
        M.table(spark, sf, "nation").select(
            F.expr("concat('r', n_nationkey)").alias("root"),
            F.expr("concat('t', n_nationkey)").alias("node"),
            F.lit("text").alias("entity_type"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("about "), "n_name").alias("content"),
            F.lit(None).cast("string").alias("attributes"),
            F.lit(None).cast("timestamp_ntz").alias("version"),
        )
    )
    edges = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("root"),
        F.expr("concat('c', o_custkey)").alias("in"),
        F.expr("concat('o', o_orderkey)").alias("out"),
        F.expr("if(o_orderstatus = 'F', 'instructs', 'consults')").alias("rel_type"),
        F.col("o_orderkey").alias("edge_uid"),
    ).unionByName(
        M.table(spark, sf, "nation").select(
            F.expr("concat('r', n_nationkey)").alias("root"),
            F.expr("concat('r', n_nationkey)").alias("in"),
            F.expr("concat('t', n_nationkey)").alias("out"),
            F.lit("describes").alias("rel_type"),
            F.lit(-1).cast("bigint").alias("edge_uid"),
        )
    )
    return nodes, edges


@query(
    "task_context",
    """WITH per AS (SELECT o_custkey,
        string_agg(CASE WHEN o_orderstatus = 'F' THEN chr(10) || 'Instructions:' || chr(10) || 'do ' || o_orderkey || chr(10) END, '' ORDER BY o_orderkey) AS told,
        string_agg(CASE WHEN o_orderstatus <> 'F' THEN '- [consults] ' || o_orderpriority || ' (rag)' || CASE WHEN o_orderstatus = 'P' THEN ' attributes: {"a":1}' ELSE '' END || chr(10) END, '' ORDER BY o_orderkey) AS ctx,
        arg_max(o_orderdate, o_orderkey) FILTER (o_orderstatus = 'F') AS v FROM orders GROUP BY 1)
      SELECT 'c' || c_custkey AS task, 'Task: ' || c_name || chr(10) || coalesce(told, '') || chr(10) || 'About the product:' || chr(10) || 'about ' || n_name || chr(10)
        || CASE WHEN ctx IS NULL THEN '' ELSE chr(10) || 'Linked context:' || chr(10) || ctx END || chr(10) || 'Report your result as plain text.' || chr(10) AS prompt,
        v AS instruct_version FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN per ON o_custkey = c_custkey""",
)
def task_context(spark, sf):
    return S.task_context(*_context_parts(spark, sf)).select("task", "prompt", "instruct_version")


@query(
    "task_dependencies",
    """SELECT l_partkey AS task, l_suppkey AS dep, max(CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END) = 1 AS warned
      FROM lineitem JOIN part s ON s.p_partkey = l_partkey AND s.p_size > 5
      LEFT JOIN part p ON p.p_partkey = l_suppkey AND p.p_size > 5 WHERE l_returnflag = 'R' GROUP BY 1, 2""",
)
def task_dependencies(spark, sf):
    nodes = M.table(spark, sf, "part").select(
        F.col("p_partkey").alias("node"),
        F.expr("if(p_size > 5, 'task', 'repo')").alias("entity_type"),
        F.col("p_name").alias("name"),
    )
    edges = M.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("in"),
        F.col("l_suppkey").alias("out"),
        F.expr("if(l_returnflag = 'R', 'depends_on', 'linked')").alias("rel_type"),
    )
    _, deps, warnings = S.dependencies(nodes, edges)
    return deps.select("task", "dep", F.lit(False).alias("warned")).unionAll(
        warnings.select("task", "dep", F.lit(True))
    )


@query(
    "pinned_version",
    """WITH v AS (SELECT o_custkey AS text_node, o_orderdate AS at, min(o_orderpriority) AS instructions FROM orders GROUP BY 1, 2)
      SELECT l_orderkey AS uid, l_linenumber AS n, o_custkey AS text_node, o_orderdate AS instruct_version, instructions
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN v ON v.text_node = o_custkey AND v.at = o_orderdate""",
)
def pinned_version(spark, sf):
    """Runs of an order pin the customer's instruction as of the order date."""
    orders, lines = M.table(spark, sf, "orders"), M.table(spark, sf, "lineitem")
    states = orders.groupBy(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("valid_from")
    ).agg(F.min("o_orderpriority").alias("content"))
    edges = orders.select(
        F.col("o_orderkey").alias("in"), F.col("o_custkey").alias("out"), F.lit("instructs").alias("rel_type")
    )
    runs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.struct("l_orderkey", "l_linenumber").alias("uid"),
        F.col("l_orderkey").alias("task"),
        F.lit("done").alias("status"),
        F.col("o_orderdate").alias("instruct_version"),
    )
    found = S.pinned_versions(runs, edges, states)
    return found.select(
        F.col("uid.l_orderkey").alias("uid"),
        F.col("uid.l_linenumber").alias("n"),
        "text_node",
        "instruct_version",
        "instructions",
    )


@query(
    "recurrence_events",
    c("cur_sch", """SELECT 'recurrence_enqueued' AS lifecycle_event, count(*) AS n FROM cur_sch
      WHERE status = 'fired' AND recurrence IN ('every:90s', 'every:2h')"""),
)
def recurrence_events(spark, sf):
    rows = S.recurrence(M.schedules(spark, sf), dt.datetime(2024, 6, 1))
    events = S.recurrence_events(rows)
    return events.groupBy("lifecycle_event").agg(F.count(F.lit(1)).alias("n"))
