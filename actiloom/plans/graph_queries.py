"""Walks, ancestors, neighbourhoods, annotations and exchange of the work graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import versioned as V
from . import mapping as M
from .catalog import query

c = M.with_ctes
_NOW = "timestamp_ntz'2024-06-01 00:00:00'"
_ACTIVE = """act AS (SELECT * FROM cur_edg WHERE active), steps AS (SELECT DISTINCT "in", "out" FROM act)"""


def _active(spark, sf):
    return G.active_edges(M.edges(spark, sf), M.EDGE_ORDER)


def _regions(spark, sf):
    return M.table(spark, sf, "region").select(F.expr("concat('r', r_regionkey)").alias("id"))


def _suppliers(spark, sf):
    return M.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))


@query(
    "frontier_expansion",
    c("cur_edg", f', {_ACTIVE} SELECT edge_uid, "in", "out" FROM act WHERE "in" IN (SELECT s_suppkey FROM supplier)'),
)
def frontier_expansion(spark, sf):
    return G.expand(_active(spark, sf), _suppliers(spark, sf)).select("edge_uid", "in", "out")


_TREE = """tree AS (
  SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey)"""


@query("subgraph", f"WITH {_TREE} SELECT root, node, depth, depth = 3 AS frontier FROM tree")
def subgraph(spark, sf):
    return G.walk(M.tree_edges(spark, sf), _regions(spark, sf), 3)


_CYCLIC = """w(root, node, depth) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier
    UNION SELECT root, {far}, depth + 1 FROM w JOIN steps ON {near} = node WHERE depth < {max}),
  firsts AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2)"""


@query(
    "subgraph_cyclic",
    c("cur_edg", f""", {_ACTIVE}, {_CYCLIC.format(near='"in"', far='"out"', max=3)}
      SELECT root, node, depth, depth = 3 AS frontier FROM firsts""", recursive=True),
)
def subgraph_cyclic(spark, sf):
    return G.walk(_active(spark, sf), _suppliers(spark, sf), 3)


@query(
    "subgraph_reverse",
    c("cur_edg", f""", {_ACTIVE}, {_CYCLIC.format(near='"out"', far='"in"', max=1)}
      SELECT root, node, depth FROM firsts""", recursive=True),
)
def subgraph_reverse(spark, sf):
    return G.walk(_active(spark, sf), _suppliers(spark, sf), 1, reverse=True).drop("frontier")


@query(
    "subgraph_edges",
    c("cont", f""", {_TREE} SELECT root, "in", "out", depth FROM tree JOIN cont ON "in" = node"""),
)
def subgraph_edges(spark, sf):
    _, edges = G.subgraph(M.tree_edges(spark, sf), _regions(spark, sf), 3)
    return edges.select("root", "in", "out", "depth")


@query(
    "subgraph_truncated",
    c("cur_edg", f""", {_ACTIVE}, {_CYCLIC.format(near='"in"', far='"out"', max=2)}
      SELECT root, count(*) AS nodes, bool_or(depth = 2) AS truncated FROM firsts GROUP BY 1""", recursive=True),
)
def subgraph_truncated(spark, sf):
    return G.truncated_roots(G.walk(_active(spark, sf), _suppliers(spark, sf), 2))


@query(
    "level_metadata",
    c("tan tst", f""", {_TREE} SELECT root, node, depth, coalesce(entity_type, '') AS entity_type, coalesce(name, '') AS name,
      CASE WHEN entity_type IN ('text', 'document') THEN content END AS content, version
      FROM tree LEFT JOIN tan ON tan.id = node LEFT JOIN tst ON tst.entity = node"""),
)
def level_metadata(spark, sf):
    visited = G.walk(M.tree_edges(spark, sf), _regions(spark, sf), 3)
    labelled = G.with_meta(visited, M.tree_anchors(spark, sf), M.tree_states(spark, sf))
    return labelled.select("root", "node", "depth", "entity_type", "name", "content", "version")


_ANCESTORS = """anc AS (
  SELECT 'o' || o_orderkey AS start, 1 AS step, 'c' || o_custkey AS ancestor FROM orders
  UNION ALL SELECT 'o' || o_orderkey, 2, 'n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'o' || o_orderkey, 3, 'r' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey)"""


def _order_nodes(spark, sf):
    return M.table(spark, sf, "orders").select(F.expr("concat('o', o_orderkey)").alias("id"))


@query("ancestors", f"WITH {_ANCESTORS} SELECT start, step, ancestor, 'contains' AS rel_type FROM anc")
def ancestors(spark, sf):
    """``contains`` wins over the ``linked`` nation every order also has."""
    edges = M.tree_edges(spark, sf).unionByName(M.linked_edges(spark, sf))
    return G.ancestors(edges, _order_nodes(spark, sf))


@query(
    "ancestor_paths",
    c("tan tst", f""", {_ANCESTORS} SELECT start, step, ancestor, entity_type, name FROM anc
      JOIN tan ON tan.id = ancestor JOIN tst ON tst.entity = ancestor"""),
)
def ancestor_paths(spark, sf):
    found = G.ancestor_paths(
        M.tree_edges(spark, sf),
        _order_nodes(spark, sf),
        M.tree_anchors(spark, sf),
        M.tree_states(spark, sf),
    )
    return found.select("start", "step", "ancestor", "entity_type", "name")


@query(
    "ancestors_cyclic",
    c("cur_edg", f""", act AS (SELECT "in" AS parent, "out" AS node, CASE rel_type WHEN 'R' THEN 1 WHEN 'A' THEN 3 ELSE 7 END AS p FROM cur_edg WHERE active),
      best AS (SELECT node, parent, min(p) AS p FROM act GROUP BY 1, 2),
      w(start, here, path, step) AS (SELECT s_suppkey, s_suppkey, [s_suppkey], 0 FROM supplier
        UNION ALL SELECT start, parent, list_append(path, parent), step + 1 FROM (
          SELECT w.*, parent, row_number() OVER (PARTITION BY start ORDER BY p, parent) AS nth FROM w
          JOIN best ON node = here WHERE step < 12 AND NOT list_contains(path, parent)) WHERE nth = 1)
      SELECT start, step, here AS ancestor FROM w WHERE step > 0""", recursive=True),
)
def ancestors_cyclic(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("R", "contains", "A", "describes", "N", "linked")])
    edges = _active(spark, sf).withColumn("rel_type", names[F.col("rel_type")])
    return G.ancestors(edges, _suppliers(spark, sf)).drop("rel_type")


@query(
    "tree_rows",
    c("tan tst", """, lines AS (
        SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
        UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation
        UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION ALL SELECT 'r' || n_regionkey, 'o' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey
          JOIN nation ON n_nationkey = c_nationkey)
      SELECT root, node, depth, repeat('  ', depth) || CASE WHEN depth = 0 THEN node || ' ' ELSE 'contains → ' || node || '  ' END
        || CASE WHEN entity_type = 'text' THEN 'text "' || coalesce(content, name, '') || '"' ELSE entity_type || ' ' || coalesce(name, '') END AS line
      FROM lines JOIN tan ON tan.id = node LEFT JOIN tst ON tst.entity = node"""),
)
def tree_rows(spark, sf):
    rows = G.tree_rows(
        M.tree_edges(spark, sf),
        _regions(spark, sf),
        M.tree_anchors(spark, sf),
        M.tree_states(spark, sf),
        3,
    )
    return rows.select("root", "node", "depth", "line")


_AROUND = """around AS (
  SELECT 'n' || n_nationkey AS root, 'n' || n_nationkey AS node, 0 AS depth FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'n' || c_nationkey, 'o' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE o_orderstatus <> 'F')"""


def _nations(spark, sf):
    return M.table(spark, sf, "nation").select(F.expr("concat('n', n_nationkey)").alias("id"))


@query("neighbourhood", f"WITH {_AROUND} SELECT root, node, depth FROM around")
def neighbourhood(spark, sf):
    nodes, _, _ = G.neighbourhood(
        M.tree_edges(spark, sf), M.tree_anchors(spark, sf), _nations(spark, sf), 2
    )
    return nodes.select("root", "node", "depth")


@query(
    "neighbourhood_edges",
    c("cont", f""", {_AROUND} SELECT a.root AS root, "in", "out" FROM cont JOIN around a ON a.node = "in"
      JOIN around b ON b.node = "out" AND a.root = b.root"""),
)
def neighbourhood_edges(spark, sf):
    _, edges, _ = G.neighbourhood(
        M.tree_edges(spark, sf), M.tree_anchors(spark, sf), _nations(spark, sf), 2
    )
    return edges.select("root", "in", "out")


@query(
    "entity_edges",
    c("cont tan tst", """, both_ways AS (SELECT "in" AS entity, 'out' AS direction, "out" AS far FROM cont
        UNION ALL SELECT "out", 'in', "in" FROM cont)
      SELECT both_ways.entity AS entity, direction, far, entity_type AS far_type, coalesce(name, '') AS far_name
      FROM both_ways JOIN tan ON tan.id = far LEFT JOIN tst ON tst.entity = far"""),
)
def entity_edges(spark, sf):
    found = G.entity_edges(
        M.tree_edges(spark, sf), M.tree_anchors(spark, sf), M.tree_states(spark, sf)
    )
    return found.select("entity", "direction", "far", "far_type", "far_name")


def _role_edges(spark, sf):
    """Customer to order, the priority standing for the relation."""
    role = F.expr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'describes' WHEN '2-HIGH' THEN 'comments'"
        " WHEN '3-MEDIUM' THEN 'instructs' WHEN '5-LOW' THEN 'attached' ELSE 'linked' END"
    )
    return M.table(spark, sf, "orders").select(
        F.expr("concat('c', o_custkey)").alias("in"),
        F.expr("concat('o', o_orderkey)").alias("out"),
        F.expr("concat('e', o_orderkey)").alias("edge_uid"),
        role.alias("rel_type"),
    )


_ROLES = """rol AS (SELECT 'c' || o_custkey AS entity, 'o' || o_orderkey AS node, CASE o_orderpriority WHEN '1-URGENT' THEN 'describes'
    WHEN '2-HIGH' THEN 'comments' WHEN '3-MEDIUM' THEN 'instructs' WHEN '5-LOW' THEN 'attached' ELSE 'linked' END AS role FROM orders)"""


@query(
    "annotations",
    c("tst", f""", {_ROLES} SELECT rol.entity AS entity, role, node AS text_node, coalesce(content, name, '') AS text
      FROM rol LEFT JOIN tst ON tst.entity = node WHERE role IN ('describes', 'comments', 'instructs')"""),
)
def annotations(spark, sf):
    found = G.annotations(_role_edges(spark, sf), M.tree_states(spark, sf))
    return found.select("entity", "role", "text_node", "text")


@query(
    "attachments",
    c("tst", f""", {_ROLES} SELECT rol.entity AS entity, node AS document, coalesce(name || '.md', '') AS name,
      'application/octet-stream' AS mime, coalesce(length(name), 0) AS size, true AS file_missing
      FROM rol LEFT JOIN tst ON tst.entity = node WHERE role = 'attached'"""),
)
def attachments(spark, sf):
    listed, _ = G.attachments(_role_edges(spark, sf), M.tree_states(spark, sf))
    return listed.select(
        "entity", "document", "name", "mime", "size", F.col("file").isNull().alias("file_missing")
    )


@query(
    "comment_threads",
    c("odep", """SELECT 'o' || a.task AS root, 'o' || b.task AS node, CAST(b.nth - a.nth AS INTEGER) AS depth
      FROM odep a JOIN odep b ON a.firing = b.firing AND b.nth - a.nth BETWEEN 1 AND 4 WHERE a.nth = 1"""),
)
def comment_threads(spark, sf):
    chain = M.order_deps(spark, sf)
    edges = chain.where("dep is not null").select(
        F.expr("concat('o', dep)").alias("in"),
        F.expr("concat('o', task)").alias("out"),
        F.expr("concat('k', task)").alias("edge_uid"),
        F.lit("comments").alias("rel_type"),
    )
    roots = chain.where("dep is null").select(F.expr("concat('o', task)").alias("id"))
    return G.threads(edges, roots, 4).select("root", "node", "depth")


def _customer_documents(spark, sf):
    roots = M.table(spark, sf, "customer").select(F.expr("concat('c', c_custkey)").alias("id"))
    nodes, edges = G.subgraph(M.tree_edges(spark, sf), roots, 1)
    labelled = G.with_meta(nodes, M.tree_anchors(spark, sf), M.tree_states(spark, sf))
    return G.export_parts(labelled, edges)


@query(
    "export_parts",
    """SELECT 'c' || c_custkey AS root, 0 AS section, '{"root":"c' || c_custkey || '","truncated_at_depth":' ||
        CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'true' ELSE 'false' END || ',"nodes":[' AS json FROM customer
      UNION ALL SELECT 'c' || c_custkey, 2, '],"edges":[' FROM customer
      UNION ALL SELECT 'c' || o_custkey, 3, string_agg('{"edge_uid":"c:o' || o_orderkey || '","from":"c' || o_custkey || '","to":"o' || o_orderkey
        || '","rel":"contains"}', ',' ORDER BY 'c:o' || o_orderkey) FROM orders GROUP BY o_custkey
      UNION ALL SELECT 'c' || c_custkey, 4, ']}' FROM customer""",
)
def export_parts(spark, sf):
    """All sections but the nodes, which the round trip checks."""
    parts = _customer_documents(spark, sf)
    return parts.where("part.section <> 1").select(
        "root", F.col("part.section").alias("section"), "json"
    )


@query(
    "graph_round_trip",
    c("tan tst", """, n AS (SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS uid, 0 AS depth FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 1 FROM orders)
      SELECT root, uid, depth, entity_type AS type, coalesce(name, '') AS name,
        CASE WHEN entity_type IN ('text', 'document') THEN content END AS content
      FROM n JOIN tan ON tan.id = uid LEFT JOIN tst ON tst.entity = uid"""),
)
def graph_round_trip(spark, sf):
    nodes, _ = G.import_documents(G.assemble(_customer_documents(spark, sf)))
    return nodes.select("root", "uid", "depth", "type", "name", "content")


@query(
    "import_edges",
    """SELECT 'c' || o_custkey AS root, 'c' || o_custkey AS "from", 'o' || o_orderkey AS "to", 'contains' AS rel FROM orders""",
)
def import_edges(spark, sf):
    _, edges = G.import_documents(G.assemble(_customer_documents(spark, sf)))
    return edges.select("root", "from", "to", "rel")


@query(
    "role_texts",
    """WITH held AS (SELECT o_custkey, min('o' || o_orderkey) AS node FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
      SELECT c_custkey AS cust, CASE WHEN length(c_name || ' is a customer of the ' || c_mktsegment || ' segment') > 40
        THEN left(c_name || ' is a customer of the ' || c_mktsegment || ' segment', 40) || '…' ELSE c_name || ' is a customer of the ' || c_mktsegment || ' segment' END AS name,
        node, node IS NULL AS created FROM customer LEFT JOIN held ON o_custkey = c_custkey""",
)
def role_texts(spark, sf):
    text = F.concat("c_name", F.lit(" is a customer of the "), "c_mktsegment", F.lit(" segment\nsecond line"))
    requests = M.table(spark, sf, "customer").select(
        F.expr("concat('c', c_custkey)").alias("entity"),
        F.lit("describes").alias("role"),
        text.alias("text"),
    )
    anchors, states, links = G.set_role_texts(requests, _role_edges(spark, sf), F.expr(_NOW))
    made = anchors.select(F.col("id").alias("entity"), F.lit(True).alias("created"))
    number = F.regexp_extract("content", "#([0-9]+)", 1).cast("bigint")
    rows = states.join(made, "entity", "left")
    created = F.coalesce("created", F.lit(False))
    return rows.select(
        number.alias("cust"), "name", F.when(~created, F.col("entity")).alias("node"), created.alias("created")
    )


@query(
    "comments_added",
    """SELECT 'c' || o_custkey AS entity, count(*) AS comments, max(o_orderpriority) AS text FROM orders GROUP BY 1""",
)
def comments_added(spark, sf):
    requests = M.table(spark, sf, "orders").select(
        F.expr("concat('c', o_custkey)").alias("entity"), F.col("o_orderpriority").alias("text")
    )
    _, states, links = G.add_comments(requests, F.expr(_NOW))
    texts = states.select(F.col("entity").alias("out"), "content")
    return (
        links.where("rel_type = 'comments'")
        .join(texts, "out")
        .groupBy(F.col("in").alias("entity"))
        .agg(F.count(F.lit(1)).alias("comments"), F.max("content").alias("text"))
    )


@query(
    "results_written_back",
    """SELECT l_partkey AS task, count(*) AS results, 'result' AS name, max(l_quantity) AS newest FROM lineitem GROUP BY 1""",
)
def results_written_back(spark, sf):
    results = M.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("task"), F.col("l_quantity").cast("string").alias("output")
    )
    _, states, links = G.write_back(results, F.expr(_NOW))
    texts = states.select(F.col("entity").alias("out"), "name", "content")
    return (
        links.where("rel_type = 'produced'")
        .join(texts, "out")
        .groupBy(F.col("in").alias("task"))
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.max("name").alias("name"),
            F.max(F.col("content").cast("double")).alias("newest"),
        )
    )


@query(
    "entities_created",
    """SELECT p_type AS entity_type, count(*) AS n, min(p_name) AS name FROM part GROUP BY 1""",
)
def entities_created(spark, sf):
    requests = M.table(spark, sf, "part").select(
        F.col("p_type").alias("entity_type"),
        F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("content"),
        F.lit("{}").alias("attributes"),
    )
    anchors, states = G.create_entities(requests, F.expr(_NOW))
    meta = V.current_meta(anchors.select("id"), anchors, states)
    return meta.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("name")
    )
