"""The work graph: bounded walks, ancestor paths, neighbourhoods, annotations.

Edges are (in, out, edge_uid, rel_type, active, valid_from); ``in`` is where
an edge starts. Every walk runs for many roots at once, keeps one row per
(root, node), and is computed level by level, each written once in the shared
folder, so plans stay short and a lost executor repeats no earlier level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import jsonval as J
from ..functions import text as X
from ..session import Rounds, written
from . import ordered, versioned
from .adjacency import Adjacency

EDGE_COLUMNS = ("edge_uid", "in", "out", "rel_type")


def active_edges(edges: DataFrame, order: Sequence[str] = versioned.ORDER) -> DataFrame:
    """Edges whose newest version is active."""
    columns = ("in", "out", "rel_type", "active")
    return versioned.latest_by(edges, ["edge_uid"], order, columns).where("active")


def expand(edges: DataFrame, frontier: DataFrame, reverse: bool = False) -> DataFrame:
    """Edges leaving (or entering) the nodes of the frontier."""
    near = "out" if reverse else "in"
    return edges.join(frontier.select(F.col("id").alias(near)), near, "left_semi")


def walk(
    edges: DataFrame, roots: DataFrame, max_depth: int, reverse: bool = False
) -> DataFrame:
    """First-visit depth of every node reached: (root, node, depth, frontier).

    ``edges`` are active ones; ``roots`` has a column ``id``. ``frontier``
    marks rows found at the last depth, from which the walk did not go on.
    """
    near, far = ("out", "in") if reverse else ("in", "out")
    # Parallel edges add nothing to reachability.
    steps = Adjacency(edges.select(F.col(near).alias("near"), F.col(far).alias("far")), "near")
    levels = Rounds(edges.sparkSession, "walk")
    here = F.col("id")
    level = levels.add(roots.select(here.alias("root"), here.alias("node")).distinct())
    while levels.count <= max_depth:
        met = steps.meet(level.select("root", F.col("node").alias("near")))
        if met is None:
            break
        found = written(met.select("root", F.col("far").alias("node")).distinct(), "found")
        # What was visited is looked up by what was found, and not moved.
        old = levels.read().select("root", "node").join(found, ["root", "node"], "left_semi")
        level = levels.add(found.join(old, ["root", "node"], "left_anti"))
    nodes = levels.read().select("root", "node", F.col("round").alias("depth"))
    return nodes.withColumn("frontier", F.col("depth") == F.lit(max_depth))


def walk_edges(
    edges: DataFrame, visited: DataFrame, reverse: bool = False
) -> DataFrame:
    """Every edge a walk went along: it leaves a visited node that was expanded."""
    near = "out" if reverse else "in"
    inner = visited.where(~F.col("frontier")).select(
        "root", F.col("node").alias(near), "depth"
    )
    return inner.join(edges.select(*EDGE_COLUMNS), near).select("root", *EDGE_COLUMNS, "depth")


def truncated_roots(visited: DataFrame) -> DataFrame:
    """Per root: nodes found and whether a frontier was left at the last depth.

    True also when nothing lies beyond that frontier.
    """
    return visited.groupBy("root").agg(
        F.count(F.lit(1)).alias("nodes"), F.bool_or("frontier").alias("truncated")
    )


def with_meta(visited: DataFrame, anchors: DataFrame, states: DataFrame) -> DataFrame:
    """Labels for the nodes of a walk, joined once after the walk.

    Content stays with text and document nodes only; unknown nodes are empty.
    """
    ids = visited.select(F.col("node").alias("id"))
    meta = versioned.current_meta(ids, anchors, states).withColumnRenamed("id", "node")
    content = F.when(F.col("entity_type").isin("text", "document"), F.col("content"))
    return visited.join(meta, "node", "left").select(
        "root",
        "node",
        "depth",
        "frontier",
        F.coalesce("entity_type", F.lit("")).alias("entity_type"),
        F.coalesce("name", F.lit("")).alias("name"),
        content.alias("content"),
        "attributes",
        "version",
    )


def subgraph(
    edges: DataFrame,
    roots: DataFrame,
    max_depth: int,
    reverse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from each root within ``max_depth`` steps."""
    visited = walk(edges, roots, max_depth, reverse)
    return visited, walk_edges(edges, visited, reverse)


def neighbourhood(
    edges: DataFrame,
    anchors: DataFrame,
    roots: DataFrame,
    depth: int,
    direction: str = "both",
    ceiling: int = model.GRAPH_DEPTH_CEILING,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, per-root flags) around each root, forward, backward or both.

    A node keeps its smallest depth, an edge appears once, text nodes other
    than the root are left out, and so are edges missing an end.
    """
    depth = max(1, min(depth, ceiling))
    ways = {"out": [False], "in": [True]}.get(direction, [False, True])
    parts = [subgraph(edges, roots, depth, reverse) for reverse in ways]
    visited = reduce(DataFrame.unionAll, [p[0] for p in parts])
    flags = visited.groupBy("root").agg(F.bool_or("frontier").alias("truncated"))
    kinds = anchors.select(F.col("id").alias("node"), "entity_type")
    nodes = (
        visited.groupBy("root", "node")
        .agg(F.min("depth").alias("depth"))
        .join(kinds, "node", "left")
        .where(
            (F.col("node") == F.col("root"))
            | ~F.coalesce(F.col("entity_type") == "text", F.lit(False))
        )
        .select("root", "node", "depth", "entity_type")
    )
    walked = reduce(DataFrame.unionAll, [p[1] for p in parts])
    # An edge may be walked from both sides; its columns are the same each time.
    found = walked.groupBy("root", "edge_uid").agg(
        F.first(F.struct("in", "out", "rel_type")).alias("_e")
    ).select("root", "edge_uid", "_e.*")
    ends = nodes.select("root", "node")
    kept = found.join(
        ends.withColumnRenamed("node", "in"), ["root", "in"], "left_semi"
    ).join(ends.withColumnRenamed("node", "out"), ["root", "out"], "left_semi")
    return nodes, kept.select("root", *EDGE_COLUMNS), flags


def _priority(rel_type: Column) -> Column:
    order = F.array(*[F.lit(r) for r in model.PARENT_PRIORITY])
    place = F.array_position(order, rel_type)
    return F.when(place == 0, len(model.PARENT_PRIORITY) + 1).otherwise(place)


def ancestors(
    edges: DataFrame, starts: DataFrame, max_depth: int = model.ANCESTOR_DEPTH
) -> DataFrame:
    """The ancestor path of every start: (start, step, ancestor, rel_type), step 1 nearest.

    One parent per level: best relation first, then the smallest id, never a
    node already on the path. Which parent comes first does not depend on the
    start, so every node's path along first parents is found for all nodes at
    once, by jumps of doubling length: a node's path goes on with the path of the
    node where it ends, in about log2(max_depth) rounds. A path that comes back to
    a node of its own is cut before the first repeat, and goes on from there step by
    step with the next best parents; without cycles there are none of these.
    """
    priced = F.struct(_priority(F.col("rel_type")).alias("p"), F.col("in").alias("parent"), "rel_type")
    links = edges.where(F.col("in") != F.col("out"))
    first = links.groupBy("out").agg(F.min(priced).alias("_b"))
    step = F.struct("_b.parent", "_b.rel_type")
    jumps = written(first.select(F.col("out").alias("node"), F.array(step).alias("path")), "jumps")
    length = 1
    while length < max_depth:
        # Paths as long as all their jumps may go on; the others have met a node without a parent.
        going = F.size("path") == length
        end = F.element_at("path", -1)["parent"]
        on = jumps.select(F.col("node").alias("_end"), F.col("path").alias("_on"))
        longer = jumps.where(going).withColumn("_end", end).join(on, "_end", "left")
        longer = longer.select("node", F.concat("path", F.coalesce("_on", F.array().cast(on.schema["_on"].dataType))).alias("path"))
        jumps = written(jumps.where(~going).unionByName(longer), "jumps")
        length *= 2
    ids = starts.select(F.col("id").alias("start")).distinct()
    paths = ids.join(jumps, ids["start"] == jumps["node"]).select("start", F.slice("path", 1, max_depth).alias("path"))
    nodes = F.concat(F.array("start"), F.col("path")["parent"])
    fresh = F.transform("_nodes", lambda n, k: F.array_position(F.col("_nodes"), n) == k + 1)
    paths = paths.withColumn("_nodes", nodes).withColumn("_repeat", F.array_position(fresh, F.lit(False)))
    # Nodes count from the start, so the repeated one is two behind the last kept step.
    kept = F.when(F.col("_repeat") == 0, F.col("path")).otherwise(F.slice("path", 1, F.col("_repeat").cast("int") - 2))
    paths = written(paths.select("start", kept.alias("path"), (F.col("_repeat") > 0).alias("cut")), "paths")
    cut = paths.where("cut")
    if not cut.isEmpty():
        paths = paths.where("not cut").unionByName(_next_best(links.select("out", priced.alias("c")), cut, max_depth))
    steps = paths.select("start", F.posexplode("path").alias("step", "_s"))
    return steps.select("start", F.col("step") + 1, F.col("_s.parent").alias("ancestor"), "_s.rel_type").toDF(
        "start", "step", "ancestor", "rel_type"
    )


def _next_best(links: DataFrame, paths: DataFrame, max_depth: int) -> DataFrame:
    """Paths (start, path) gone on with, one step at a time, by the best parent that is not on them.

    A path holds at most ``max_depth`` nodes besides its start, so the best
    ``max_depth + 1`` distinct parents of a node always include the right one:
    a node carries these, and a level is one join whatever the in-degree.
    """
    parents = links.groupBy("out", "c.parent").agg(F.min("c").alias("c"))
    best = Window.partitionBy("out").orderBy("c")
    short = parents.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max_depth + 1)
    choices = written(short.groupBy("out").agg(F.array_sort(F.collect_list("c")).alias("choices")), "choices")
    done, here = Rounds(links.sparkSession, "paths"), paths.select("start", "path")
    for _ in range(max_depth + 1):
        end = F.coalesce(F.element_at("path", -1)["parent"], F.col("start"))
        end = F.when(F.size("path") > 0, end).otherwise(F.col("start"))
        on = F.concat(F.array("start"), F.col("path")["parent"])
        pick = F.get(F.filter("choices", lambda c: ~F.array_contains(F.col("_on"), c["parent"])), F.lit(0))
        moved = here.withColumn("out", end).withColumn("_on", on).join(choices, "out", "left").withColumn("_pick", pick)
        stays = F.col("_pick").isNull() | (F.size("path") >= max_depth)
        moved = done.add(
            moved.select(
                "start",
                F.when(stays, F.col("path")).otherwise(F.concat("path", F.array(F.struct("_pick.parent", "_pick.rel_type")))).alias("path"),
                stays.alias("done"),
            )
        )
        here = moved.where("not done").select("start", "path")
        if here.isEmpty():
            break
    return done.read().where("done").select("start", "path", F.lit(True).alias("cut"))


def ancestor_paths(
    edges: DataFrame,
    starts: DataFrame,
    anchors: DataFrame,
    states: DataFrame,
    max_depth: int = model.ANCESTOR_DEPTH,
) -> DataFrame:
    """Ancestors with type and name, in root-first order."""
    found = ancestors(edges, starts, max_depth)
    meta = versioned.current_meta(
        found.select(F.col("ancestor").alias("id")), anchors, states
    ).select(F.col("id").alias("ancestor"), "entity_type", "name")
    return (
        found.join(meta, "ancestor", "left")
        .select(
            "start",
            "step",
            "ancestor",
            "rel_type",
            F.coalesce("entity_type", F.lit("")).alias("entity_type"),
            F.coalesce("name", F.lit("")).alias("name"),
        )
        .orderBy("start", F.desc("step"))
    )


def first_visits(lines: DataFrame, roots: DataFrame) -> DataFrame:
    """Where a depth-first walk meets each node first: (root, node, path).

    ``lines`` are the edges (root, edge_uid, in, out) of each root's graph, ``path``
    the edge ids from the root. A depth-first walk goes along edges in the order
    of their paths, so a node's place is the least of its parents' places each
    with one edge more, none of them lying below the node itself. That rule has one
    solution. Places only ever get smaller, so each round offers the places of
    nodes that moved to those below them; on a tree every node moves once, and
    rounds are as many as levels.
    """
    steps = Adjacency(lines.select("root", F.col("in").alias("near"), F.col("out").alias("node"), "edge_uid"), "near")
    moves = Rounds(lines.sparkSession, "visits")
    edge = lines.schema["edge_uid"].dataType.simpleString()
    here = F.col("id")
    moved = moves.add(
        roots.select(here.alias("root"), here.alias("node")).distinct().select(
            "root", "node", F.array().cast(f"array<{edge}>").alias("path"), F.array("root").alias("on")
        )
    )
    least = F.min(F.struct("path", "on")).alias("_m")
    while (met := steps.meet(moved.select(F.col("root").alias("_of"), F.col("node").alias("near"), "path", "on"))) is not None:
        # Edges and places of one node stand for different roots: both must agree.
        offers = met.where((F.col("root") == F.col("_of")) & ~F.array_contains("on", F.col("node")))
        offers = offers.select(
            "root", "node", F.concat("path", F.array("edge_uid")).alias("path"), F.concat("on", F.array("node")).alias("on")
        )
        offers = written(offers.groupBy("root", "node").agg(least).select("root", "node", "_m.*"), "offers")
        now = moves.read().join(offers.select("root", "node"), ["root", "node"], "left_semi")
        now = now.groupBy("root", "node").agg(F.min("path").alias("_now"))
        better = F.col("_now").isNull() | (F.col("path") < F.col("_now"))
        moved = moves.add(offers.join(now, ["root", "node"], "left").where(better).drop("_now"))
    return moves.read().groupBy("root", "node").agg(F.min("path").alias("path"))


def tree_rows(
    edges: DataFrame,
    roots: DataFrame,
    anchors: DataFrame,
    states: DataFrame,
    max_depth: int,
) -> DataFrame:
    """Depth-first tree lines: (root, nth, path, node, depth, line, repeated).

    A node is expanded where a depth-first drawing meets it first; elsewhere it is
    a leaf, marked when it has children. ``path`` holds the edge ids from the root,
    ``nth`` numbers a root's lines from 1 in the order of the drawing.

    The last level of the walk is where its lines end, so it is not walked for. Only
    nodes with children need a place: the others, most of a wide tree, are lines alone.
    """
    # What is expanded: the nodes met before the last level.
    inner = walk(edges, roots, max(max_depth - 1, 0)).where(F.col("depth") < max_depth)
    lines = walk_edges(edges, inner.withColumn("frontier", F.lit(False)))
    lines = written(lines.select("root", "edge_uid", "in", "out", "rel_type"), "lines")
    expanded = lines.select("root", F.col("in").alias("out")).distinct()
    places = written(first_visits(lines.join(expanded, ["root", "out"], "left_semi"), roots), "places")
    parents = places.select("root", F.col("node").alias("in"), F.col("path").alias("_at"))
    owned = places.select("root", F.col("node").alias("out"), F.col("path").alias("_own"))
    below = lines.join(parents, ["root", "in"]).withColumn("path", F.concat("_at", F.array("edge_uid")))
    # A line's node with a place has children, and is drawn with them where it has that place.
    again = F.col("_own").isNotNull() & F.coalesce(F.col("path") != F.col("_own"), F.lit(True))
    below = below.join(owned, ["root", "out"], "left").select(
        "root", F.col("out").alias("node"), "rel_type", "path", again.alias("repeated")
    )
    tops = places.where(F.size("path") == 0).select(
        "root", "node", F.lit(None).cast("string").alias("rel_type"), "path", F.lit(False).alias("repeated")
    )
    rows = ordered.with_running(tops.unionByName(below), ["root"], ["path"], {"nth": ordered.count_rows()})
    ids = lines.select(F.col("out").alias("id")).unionAll(places.where(F.size("path") == 0).select(F.col("node").alias("id")))
    meta = versioned.current_meta(ids, anchors, states).select(F.col("id").alias("node"), "entity_type", "name", "content")
    marked = rows.join(meta, "node", "left")
    label = F.when(
        F.col("entity_type") == "text",
        F.concat(F.lit('text "'), X.first_line(F.coalesce("content", "name")), F.lit('"')),
    ).otherwise(F.coalesce(F.concat_ws(" ", "entity_type", "name"), F.lit("?")))
    depth = F.size("path")
    edge = F.when(
        F.col("rel_type").isNotNull(),
        F.concat(F.col("rel_type"), F.lit(" → "), F.substring(F.col("node").cast("string"), 1, 13), F.lit("  ")),
    ).otherwise(F.concat(F.col("node").cast("string"), F.lit(" ")))
    mark = F.when(F.col("repeated"), F.lit(" (already shown above — cycle)")).otherwise("")
    return marked.select(
        "root",
        "nth",
        "path",
        "node",
        depth.alias("depth"),
        F.concat(F.repeat(F.lit("  "), depth), edge, label, mark).alias("line"),
        "repeated",
    )


def export_parts(
    nodes: DataFrame, edges: DataFrame, items_per_part: int = 10_000
) -> DataFrame:
    """Subgraphs as JSON documents in numbered parts: (root, part, json).

    The texts of a root's parts, in order, make one document
    ``{"root", "truncated_at_depth", "nodes": [...], "edges": [...]}``. No part
    holds more than ``items_per_part`` items, so a root that reaches a third of
    the graph is never one task's string.
    """

    def numbered(rows: DataFrame, order: list[str], key: str) -> DataFrame:
        with_nth = ordered.with_running(
            rows, ["root"], order, {"_nth": ordered.count_rows()}
        )
        return with_nth.select("root", F.col("_nth").alias("nth"), F.col(key).alias("item"))

    def parts(rows: DataFrame, section: int) -> DataFrame:
        number = F.expr(f"bigint((nth - 1) div {int(items_per_part)})")
        first = F.min("nth") == 1
        body = F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"]), ","
        )
        return rows.groupBy("root", number.alias("n")).agg(
            F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), body).alias("json")
        ).select("root", F.lit(section).alias("section"), "n", "json")

    node_json = F.to_json(
        F.struct(
            F.col("node").cast("string").alias("uid"),
            F.col("entity_type").alias("type"),
            "name",
            "content",
            F.try_parse_json("attributes").alias("attributes"),
            "version",
            "depth",
        ),
        {"ignoreNullFields": "false"},
    )
    edge_json = F.to_json(
        F.struct(
            F.col("edge_uid").cast("string").alias("edge_uid"),
            F.col("in").cast("string").alias("from"),
            F.col("out").cast("string").alias("to"),
            F.col("rel_type").alias("rel"),
        )
    )
    n = numbered(nodes.withColumn("_json", node_json), ["depth", "node"], "_json")
    e = numbered(edges.withColumn("_json", edge_json), ["depth", "edge_uid"], "_json")
    flags = nodes.groupBy("root").agg(F.bool_or("frontier").alias("truncated"))
    opening = F.to_json(
        F.struct(
            F.col("root").cast("string").alias("root"),
            F.col("truncated").alias("truncated_at_depth"),
        )
    )
    head = flags.select(
        "root",
        F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("n"),
        F.concat(F.rtrim(opening, F.lit("}")), F.lit(',"nodes":[')).alias("json"),
    )

    def fixed(section: int, text: str) -> DataFrame:
        return flags.select(
            "root",
            F.lit(section).alias("section"),
            F.lit(0).cast("bigint").alias("n"),
            F.lit(text).alias("json"),
        )

    pieces = [head, parts(n, 1), fixed(2, '],"edges":['), parts(e, 3), fixed(4, "]}")]
    return reduce(DataFrame.unionByName, pieces).select(
        "root", F.struct("section", "n").alias("part"), "json"
    )


def assemble(parts: DataFrame) -> DataFrame:
    """One whole document per root (root, json), for consumers that need it whole.

    A row is as large as its subgraph; consumers of large graphs read the parts.
    """
    texts = F.array_sort(F.collect_list(F.struct("part", "json")))
    return parts.groupBy("root").agg(
        F.array_join(F.transform(texts, lambda p: p["json"]), "").alias("json")
    )


GRAPH_DOCUMENT = (
    "root string, truncated_at_depth boolean,"
    " nodes array<struct<uid: string, type: string, name: string, content: string,"
    " attributes: variant, version: string, depth: bigint>>,"
    " edges array<struct<edge_uid: string, `from`: string, `to`: string, rel: string>>"
)


def import_documents(documents: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents; a missing version is '' and depth 0."""
    parsed = documents.select(F.from_json(column, GRAPH_DOCUMENT).alias("g")).where(
        "g.root is not null"
    )
    nodes = parsed.select("g.root", F.inline("g.nodes")).withColumns(
        {
            "version": F.coalesce("version", F.lit("")),
            "depth": F.coalesce("depth", F.lit(0)),
        }
    )
    return nodes, parsed.select("g.root", F.inline("g.edges"))


def entity_edges(edges: DataFrame, anchors: DataFrame, states: DataFrame) -> DataFrame:
    """Both directions of every active non-text edge with the far side's label."""
    plain = edges.where(~F.col("rel_type").isin(model.TEXT_ROLES))
    out = plain.select(
        F.col("in").alias("entity"), F.lit("out").alias("direction"), "rel_type", F.col("out").alias("far"), "edge_uid"
    )
    back = plain.select(
        F.col("out").alias("entity"), F.lit("in").alias("direction"), "rel_type", F.col("in").alias("far"), "edge_uid"
    )
    both = out.unionAll(back)
    meta = versioned.current_meta(both.select(F.col("far").alias("id")), anchors, states).select(
        F.col("id").alias("far"), F.col("entity_type").alias("far_type"), F.col("name").alias("far_name")
    )
    return both.join(meta, "far", "left").select(
        "entity",
        "direction",
        "rel_type",
        "edge_uid",
        "far",
        F.coalesce("far_type", F.lit("")).alias("far_type"),
        F.coalesce("far_name", F.lit("")).alias("far_name"),
    )


def annotations(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Texts hung on entities: current content, else name, else ''."""
    roles = edges.where(F.col("rel_type").isin(model.TEXT_ROLES))
    columns = ("name", "content", "valid_from")
    now = versioned.latest_by(states, ["entity"], columns=columns).select(
        F.col("entity").alias("out"), "name", "content", F.col("valid_from").alias("version")
    )
    return roles.join(now, "out", "left").select(
        F.col("in").alias("entity"),
        F.col("rel_type").alias("role"),
        F.col("out").alias("text_node"),
        F.coalesce("content", "name", F.lit("")).alias("text"),
        "version",
    )


def threads(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Comments on comments below each root."""
    return walk(edges.where("rel_type = 'comments'"), roots, max_depth).where("depth > 0")


def attachments(edges: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents attached to entities, and those whose attributes name no file."""
    now = versioned.latest_by(states, ["entity"], columns=("name", "attributes")).select(
        F.col("entity").alias("out"), "name", "attributes"
    )
    rows = edges.where("rel_type = 'attached'").join(now, "out", "left")
    text = F.col("attributes")
    listed = rows.select(
        F.col("in").alias("entity"),
        F.col("out").alias("document"),
        F.coalesce(J.str_field(text, "original_name"), F.col("name"), F.lit("")).alias("name"),
        F.coalesce(J.str_field(text, "mime"), F.lit(model.OTHER_MIME)).alias("mime"),
        F.coalesce(J.int_field(text, "size"), F.lit(0)).alias("size"),
        J.str_field(text, "file").alias("file"),
    )
    return listed, listed.where("file is null")


def create_entities(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Anchors and first versions for (entity_type, name, content, attributes) requests.

    The new ids must be the same in both results, so they are fixed first.
    """
    made = written(requests.withColumns({"id": F.expr("uuid()"), "_at": now}))
    anchors = made.select("id", "entity_type", F.col("_at").alias("created_at"))
    states = made.select(
        F.expr("uuid()").alias("id"),
        F.col("id").alias("entity"),
        "name",
        "content",
        "attributes",
        F.col("_at").alias("valid_from"),
    )
    return anchors, states


def text_label(text: Column) -> Column:
    """A text node's name: its first line, cut at 40 characters."""
    return X.first_line(text, 40)


def set_role_texts(
    requests: DataFrame, edges: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, states, edges) to append for (entity, role, text) requests.

    An active role edge gets a new version of its text node; otherwise a new
    node and edge are made. ``edges`` are active ones.
    """
    held = edges.groupBy(F.col("in").alias("entity"), F.col("rel_type").alias("role")).agg(
        F.min("out").alias("_node")
    )
    joined = requests.dropDuplicates(["entity", "role"]).join(held, ["entity", "role"], "left")
    return _text_rows(joined, now)


def add_comments(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Always a new node and edge, for (entity, text) requests."""
    rows = requests.select(
        "entity", F.lit("comments").alias("role"), "text", F.lit(None).cast("string").alias("_node")
    )
    return _text_rows(rows, now)


def _text_rows(
    rows: DataFrame, now: Column, name: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = written(
        rows.withColumns(
            {
                "_new": F.col("_node").isNull(),
                "_node": F.coalesce(F.col("_node").cast("string"), F.expr("uuid()")),
                "_at": now,
            }
        )
    )
    fresh = made.where("_new")
    anchors = fresh.select(
        F.col("_node").alias("id"), F.lit("text").alias("entity_type"), F.col("_at").alias("created_at")
    )
    states = made.select(
        F.expr("uuid()").alias("id"),
        F.col("_node").alias("entity"),
        (text_label(F.col("text")) if name is None else name).alias("name"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("attributes"),
        F.col("_at").alias("valid_from"),
    )
    links = fresh.select(
        F.expr("uuid()").alias("id"),
        F.col("entity").alias("in"),
        F.col("_node").alias("out"),
        F.expr("uuid()").alias("edge_uid"),
        F.col("role").alias("rel_type"),
        F.lit(True).alias("active"),
        F.col("_at").alias("valid_from"),
    )
    return anchors, states, links


def write_back(results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A result text node and ``produced`` edge per (task, output) row."""
    rows = results.select(
        F.col("task").alias("entity"),
        F.lit("produced").alias("role"),
        F.col("output").alias("text"),
        F.lit(None).cast("string").alias("_node"),
    )
    return _text_rows(rows, now, F.lit("result"))
