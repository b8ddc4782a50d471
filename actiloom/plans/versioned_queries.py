"""Chains: current state, history, carry-forward, registries, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonval as J
from ..operators import versioned as V
from . import mapping as M
from .catalog import query

c = M.with_ctes


@query("current_state", c("cur_led", "SELECT target, type, id, name, valid_from FROM cur_led"))
def current_state(spark, sf):
    state = V.current_state(M.ledger(spark, sf))
    name = J.str_field(F.col("payload"), "name")
    return state.select("target", "type", "id", name.alias("name"), "valid_from")


@query(
    "state_history",
    c("led", """SELECT target, type, id, valid_from,
      row_number() OVER (PARTITION BY target, type ORDER BY valid_from, id) AS version FROM led"""),
)
def state_history(spark, sf):
    rows = M.ledger(spark, sf).drop("payload")
    return V.history(rows, ["target", "type"])


@query(
    "version_numbers",
    c("edg", """SELECT edge_uid, "in", "out", valid_from, row_number() OVER (PARTITION BY edge_uid
      ORDER BY valid_from, "in", "out", q, p) AS version FROM edg"""),
)
def version_numbers(spark, sf):
    numbered = V.history(M.edges(spark, sf), ["edge_uid"], M.EDGE_ORDER)
    return numbered.select("edge_uid", "in", "out", "valid_from", "version")


@query(
    "current_meta",
    c("tan tst", """SELECT id, entity_type, coalesce(name, '') AS name, content, version, created_at
      FROM tan LEFT JOIN tst ON id = entity"""),
)
def current_meta(spark, sf):
    orders = M.table(spark, sf, "orders").select(F.expr("concat('o', o_orderkey)").alias("id"))
    asked = M.tree_anchors(spark, sf).select("id").unionAll(orders.select(F.expr("concat('?', id)")))
    meta = V.current_meta(asked, M.tree_anchors(spark, sf), M.tree_states(spark, sf))
    return meta.select("id", "entity_type", "name", "content", "version", "created_at")


@query(
    "carry_forward",
    """SELECT o_custkey AS entity, o_orderkey AS id, o_orderdate AS valid_from,
      last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER w AS name,
      last_value(CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END IGNORE NULLS) OVER w AS content
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def carry_forward(spark, sf):
    patches = M.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("valid_from"),
        F.expr("if(o_orderkey % 3 = 0, o_orderpriority, null)").alias("name"),
        F.expr("if(o_orderkey % 4 = 1, o_orderstatus, null)").alias("content"),
    )
    return V.carry_forward(patches, ["entity"], ["name", "content"])


@query(
    "apply_patches",
    c("tst", """SELECT 'c' || c_custkey AS entity,
        coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'renamed ' || c_custkey END, t.name) AS name,
        t.content AS content, t.entity IS NULL AS refused
      FROM customer LEFT JOIN tst t ON t.entity = 'c' || c_custkey
      UNION ALL SELECT 'x' || c_custkey, NULL, NULL, true FROM customer WHERE c_custkey % 7 = 0"""),
)
def apply_patches(spark, sf):
    customer = M.table(spark, sf, "customer")
    none = F.lit(None).cast("string")
    patches = customer.select(
        F.expr("concat('c', c_custkey)").alias("entity"),
        F.expr("if(c_custkey % 2 = 0, concat('renamed ', c_custkey), null)").alias("name"),
        none.alias("content"),
        none.alias("attributes"),
    ).unionAll(
        customer.where("c_custkey % 7 = 0").select(
            F.expr("concat('x', c_custkey)"), F.lit("lost"), none, none
        )
    )
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    rows, refused = V.apply_patches(
        V.latest_by(M.tree_states(spark, sf), ["entity"]), patches, now
    )
    return rows.select("entity", "name", "content", F.lit(False).alias("refused")).unionAll(
        refused.select("entity", none, none, F.lit(True))
    )


@query("current_edges", c("cur_edg", 'SELECT edge_uid, "in", "out", rel_type, active, valid_from FROM cur_edg'))
def current_edges(spark, sf):
    now = V.current_edges(M.edges(spark, sf), M.EDGE_ORDER)
    return now.select("edge_uid", "in", "out", "rel_type", "active", "valid_from")


@query("current_schedules", c("cur_sch", "SELECT uid, entity, run_at, recurrence, status FROM cur_sch"))
def current_schedules(spark, sf):
    return V.current_schedules(M.schedules(spark, sf)).select(
        "uid", "entity", "run_at", "recurrence", "status"
    )


@query("current_runs", c("cur_rn", "SELECT uid, schedule, firing, task, status, valid_from FROM cur_rn"))
def current_runs(spark, sf):
    return V.latest_by(M.runs(spark, sf), ["uid"], M.RUN_ORDER).select(
        "uid", "schedule", "firing", "task", "status", "valid_from"
    )


@query(
    "current_runs_of_schedule",
    c("rn", """SELECT uid, firing, task, status FROM (SELECT *, row_number() OVER (PARTITION BY uid
      ORDER BY valid_from DESC, id DESC, task DESC, schedule DESC, q DESC, p DESC) AS n
      FROM rn WHERE schedule = 7) WHERE n = 1"""),
)
def current_runs_of_schedule(spark, sf):
    mine = M.runs(spark, sf).where("schedule = 7")
    return V.latest_by(mine, ["uid"], M.RUN_ORDER).select("uid", "firing", "task", "status")


@query(
    "module_ledger",
    c("mods", """SELECT uid, entity, kind, version, provisioned FROM (SELECT *, row_number() OVER (
      PARTITION BY uid ORDER BY valid_from DESC, id DESC) AS n FROM mods) WHERE n = 1"""),
)
def module_ledger(spark, sf):
    return V.module_ledger(M.modules(spark, sf)).select(
        "uid", "entity", "kind", "version", "provisioned"
    )


@query(
    "module_registration",
    c("mods", """SELECT c_custkey AS uid, 'v10' AS version, coalesce(m.provisioned, false) AS provisioned
      FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY uid ORDER BY valid_from DESC, id DESC) AS n FROM mods) WHERE n = 1) m
      ON m.uid = c_custkey"""),
)
def module_registration(spark, sf):
    descriptors = M.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("uid"),
        F.col("c_custkey").alias("entity"),
        F.lit("adapter").alias("kind"),
        F.lit("v10").alias("version"),
    )
    rows = V.register_modules(M.modules(spark, sf), descriptors, F.current_timestamp())
    return rows.select("uid", "version", "provisioned")


def _ledger_as(spark, sf, mapping):
    """The ledger with priorities renamed to attribute types."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return M.ledger(spark, sf).withColumn(
        "type", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("type")), F.col("type"))
    )


_AS = {
    "1-URGENT": "attr_module_descriptor",
    "2-HIGH": "attr_module_status",
    "3-MEDIUM": "attr_lifecycle_state",
}


@query(
    "registry_status",
    c("cur_led", """SELECT c_custkey AS target, c_mktsegment AS kind, d.name AS name,
        coalesce(d.version, '') AS version, coalesce(l.tag, 'enabled') AS lifecycle
      FROM customer JOIN cur_led d ON d.target = c_custkey AND d.type = '1-URGENT'
      LEFT JOIN cur_led l ON l.target = c_custkey AND l.type = '3-MEDIUM'"""),
)
def registry_status(spark, sf):
    return V.registry_status(M.customers_as_entities(spark, sf), _ledger_as(spark, sf, _AS))


@query(
    "operator_intent",
    c("cur_led", """SELECT c_custkey AS target,
        CASE WHEN s.target IS NULL THEN 'enabled' ELSE s.status END AS status, false AS corrupt
      FROM customer LEFT JOIN cur_led s ON s.target = c_custkey AND s.type = '2-HIGH'"""),
)
def operator_intent(spark, sf):
    return V.operator_intent(M.customers_as_entities(spark, sf), _ledger_as(spark, sf, _AS))


@query(
    "lifecycle_decoded",
    c("led", """SELECT id, tag, CASE WHEN tag = 'failed' THEN '' END AS error,
        CASE WHEN tag = 'active' THEN greatest(startup, 0) END AS startup_ms, NULL AS reason
      FROM led WHERE tag <> 'broken'
      UNION ALL SELECT id, NULL, NULL, NULL, 'unknown lifecycle tag ''broken''' FROM led WHERE tag = 'broken'"""),
)
def lifecycle_decoded(spark, sf):
    decoded, rejected = V.decode_lifecycle(M.ledger(spark, sf))
    none = F.lit(None)
    return decoded.select(
        "id",
        F.col("lifecycle.tag").alias("tag"),
        F.col("lifecycle.error").alias("error"),
        F.col("lifecycle.startup_duration_ms").alias("startup_ms"),
        none.cast("string").alias("reason"),
    ).unionAll(
        rejected.select(
            "id", none.cast("string"), none.cast("string"), none.cast("bigint"), "reason"
        )
    )


@query(
    "module_inventory",
    c("mods cur_led", """SELECT c_custkey AS entity, coalesce(m.kind, c_mktsegment) AS kind,
        coalesce(m.version, d.version, '-') AS version, coalesce(s.status, 'enabled') AS intent,
        coalesce(l.tag, 'never-booted') AS lifecycle, coalesce(m.provisioned, false) AS provisioned
      FROM customer
      LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY uid ORDER BY valid_from DESC, id DESC) AS n FROM mods) WHERE n = 1) m ON m.entity = c_custkey
      LEFT JOIN cur_led d ON d.target = c_custkey AND d.type = '1-URGENT'
      LEFT JOIN cur_led s ON s.target = c_custkey AND s.type = '2-HIGH'
      LEFT JOIN cur_led l ON l.target = c_custkey AND l.type = '3-MEDIUM'"""),
)
def module_inventory(spark, sf):
    return V.module_inventory(
        M.modules(spark, sf), M.customers_as_entities(spark, sf), _ledger_as(spark, sf, _AS)
    )


@query(
    "first_per_group",
    c("led", """SELECT target, id, valid_from FROM (SELECT *, row_number() OVER (
      PARTITION BY target ORDER BY valid_from DESC, id DESC) AS n FROM led) WHERE n = 1"""),
)
def first_per_group(spark, sf):
    from ..operators.ordered import newest_per_key

    rows = M.ledger(spark, sf).select("target", "id", "valid_from")
    return newest_per_key(rows, ["target"], V.ORDER, 1)


@query(
    "supersede_state",
    c("cur_led", """SELECT target, type, value + 100 AS value FROM cur_led WHERE value > 0
      UNION ALL SELECT target, type, value FROM cur_led WHERE value <= 0"""),
)
def supersede_state(spark, sf):
    """A new version for every chain with a positive value, read back as current."""
    ledger = M.ledger(spark, sf).withColumn("id", F.lpad(F.col("id").cast("string"), 20, "0"))
    value = J.int_field(F.col("payload"), "value")
    current = V.current_state(ledger)
    requests = current.where(value > 0).select(
        "target", "type", F.to_json(F.struct((value + 100).alias("value"))).alias("payload")
    )
    appended = V.supersede(requests, F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    after = V.current_state(ledger.unionByName(appended))
    return after.select("target", "type", value.alias("value"))


_CHANGED = """WITH req AS (SELECT o_orderkey AS id, 'mod-' || o_custkey % 60 AS name,
    ['starting', 'active', 'failed', 'skipped', 'disabled', 'gone'][(o_orderkey % 6 + 1)::INT] AS tag, o_orderkey % 50 - 5 AS took,
    CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS detail FROM orders),
  mods AS (SELECT DISTINCT 'mod-' || c_custkey AS name, c_custkey AS entity FROM customer WHERE c_custkey < 40),
  j AS (SELECT req.*, entity FROM req LEFT JOIN mods USING (name))"""


@query(
    "lifecycle_changes",
    f"""{_CHANGED} SELECT id, CASE WHEN tag = 'gone' THEN 'unknown tag' WHEN entity IS NULL THEN 'unknown module' END AS refusal,
        NULL AS lifecycle_event, NULL AS target, NULL AS tag, NULL AS error, NULL AS reason, NULL AS took FROM j WHERE tag = 'gone' OR entity IS NULL
      UNION ALL SELECT id, NULL, e, entity, CASE WHEN e IS NULL THEN tag END, CASE WHEN tag = 'failed' THEN coalesce(detail, '') END,
        CASE WHEN tag = 'skipped' THEN coalesce(detail, '') END, CASE WHEN tag = 'active' THEN greatest(took, 0) END
      FROM (SELECT *, unnest([NULL, 'module_' || tag]) AS e FROM j WHERE tag <> 'gone' AND entity IS NOT NULL)""",
)
def lifecycle_changes(spark, sf):
    """Orders as requests to sixty modules, of which thirty-nine exist: states, events and refusals."""
    detail = F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END")
    requests = M.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('mod-', o_custkey % 60)").alias("name"),
        F.expr("element_at(array('starting', 'active', 'failed', 'skipped', 'disabled', 'gone'), int(o_orderkey % 6) + 1)").alias("tag"),
        detail.alias("error"),
        detail.alias("failed_during"),
        detail.alias("reason"),
        F.expr("o_orderkey % 50 - 5").alias("startup_duration_ms"),
    )
    names = M.table(spark, sf, "customer").where("c_custkey < 40").select(
        F.expr("concat('mod-', c_custkey)").alias("name"), F.col("c_custkey").alias("entity")
    )
    states, events, refused = V.change_lifecycle(requests, names, F.expr("timestamp'2024-06-01'"))
    fields = "tag string, error string, reason string, startup_duration_ms bigint"
    number = F.substring_index("id", "-", 1).cast("bigint").alias("id")

    def shown(rows, event, target):
        body = rows.withColumn("_p", F.from_json("payload", fields))
        return body.select(number, F.lit(None).cast("string").alias("refusal"), event.alias("lifecycle_event"), target.cast("bigint").alias("target"),
            "_p.tag", "_p.error", "_p.reason", F.col("_p.startup_duration_ms").alias("took"))

    none = F.lit(None)
    gone = refused.select(F.col("id").cast("bigint").alias("id"), "refusal", *(none.cast(kind).alias(name) for name, kind in
        (("lifecycle_event", "string"), ("target", "bigint"), ("tag", "string"), ("error", "string"), ("reason", "string"), ("took", "bigint"))))
    return gone.unionAll(shown(states, none.cast("string"), F.col("target"))).unionAll(shown(events, F.col("lifecycle_event"), F.col("subject")))
