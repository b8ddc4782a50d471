"""Walks, ancestors, cycles and waves against plain Python on random graphs."""

import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from actiloom import session
from actiloom.operators import adjacency
from actiloom.operators import graph as G
from actiloom.operators import quality as Q
from actiloom.operators import schedule as S
from actiloom.operators import versioned as V
from actiloom.operators.adjacency import Adjacency

T0 = dt.datetime(2026, 1, 1)
EDGE = "in string, out string, edge_uid string, rel_type string"
RELS = ["contains", "attached", "describes", "linked", "produced"]


def random_edges(seed, nodes=14, count=30):
    rng = random.Random(seed)
    return [
        (f"n{rng.randrange(nodes):02d}", f"n{rng.randrange(nodes):02d}", f"e{i:03d}", rng.choice(RELS))
        for i in range(count)
    ]


def plain_walk(edges, root, depth, reverse):
    seen, frontier, d = {root: 0}, [root], 0
    walked = []
    while frontier and d < depth:
        nxt = []
        for a, b, uid, _ in edges:
            near, far = (b, a) if reverse else (a, b)
            if near in frontier:
                walked.append(uid)
                if far not in seen:
                    seen[far] = d + 1
                    nxt.append(far)
        frontier, d = nxt, d + 1
    return seen, sorted(walked), bool(frontier)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("reverse", [False, True])
def test_walk(spark, seed, reverse):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, EDGE)
    roots = ["n00", "n05", "n13", "gone"]
    ids = spark.createDataFrame([(r,) for r in roots], "id string")
    for depth in (1, 3, 20):
        nodes, walked = G.subgraph(df, ids, depth, reverse)
        found, uids = defaultdict(dict), defaultdict(list)
        for r in nodes.collect():
            found[r.root][r.node] = r.depth
        for r in walked.collect():
            uids[r.root].append(r.edge_uid)
        flags = {r.root: r.truncated for r in G.truncated_roots(nodes).collect()}
        for root in roots:
            seen, used, truncated = plain_walk(edges, root, depth, reverse)
            assert found[root] == seen
            assert sorted(uids[root]) == used
            assert flags[root] == truncated


def plain_ancestors(edges, start, depth):
    order = ["contains", "attached", "describes", "instructs", "comments", "produced"]
    rank = lambda rel: order.index(rel) if rel in order else len(order)
    here, seen, path = start, {start}, []
    for _ in range(depth):
        options = [(rank(rel), a) for a, b, _, rel in edges if b == here and a not in seen]
        if not options:
            break
        here = min(options)[1]
        seen.add(here)
        path.append(here)
    return path


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("depth", [1, 2, 12])
def test_ancestors(spark, seed, depth):
    edges = random_edges(seed, nodes=9, count=40)
    df = spark.createDataFrame(edges, EDGE)
    starts = spark.createDataFrame([(f"n{i:02d}",) for i in range(10)], "id string")
    found = defaultdict(list)
    for r in sorted(G.ancestors(df, starts, depth).collect(), key=lambda r: r.step):
        found[r.start].append(r.ancestor)
    for i in range(10):
        assert found[f"n{i:02d}"] == plain_ancestors(edges, f"n{i:02d}", depth)


@pytest.mark.parametrize("seed", range(5))
def test_cycles_and_waves(spark, seed):
    rng = random.Random(seed)
    n = 16
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([8, 14, 22]))}
    reach = {(a, b) for a, b in pairs}
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    on_cycle = {a for a, b in reach if a == b}
    stuck = on_cycle | {a for a, b in reach if b in on_cycle}
    deps = spark.createDataFrame(sorted(pairs), "task int, dep int")
    tasks = spark.range(n).select(F.col("id").cast("int").alias("task"))
    assert {r.task for r in S.cycle_members(deps).collect()} == on_cycle
    placed, left = S.waves(tasks, deps)
    wave = {r.task: r.wave for r in placed.collect()}
    assert {r.task for r in left.collect()} == stuck
    assert set(wave) == set(range(n)) - stuck
    for task in wave:
        before = [wave[d] for t, d in pairs if t == task]
        assert wave[task] == 1 + max(before, default=0)
    got = {r.task: r.on_cycle for r in S.classify_stuck(tasks, deps).collect()}
    assert got == {t: t in on_cycle for t in stuck}


def store(spark, entities, links):
    """Entities (id, type, name, content) and active links (from, to, rel) in creation order."""
    anchors = spark.createDataFrame([(i, t, T0) for i, t, _, _ in entities], "id string, entity_type string, created_at timestamp")
    states = spark.createDataFrame(
        [(f"s{i}", i, n, c, None, T0) for i, _, n, c in entities],
        "id string, entity string, name string, content string, attributes string, valid_from timestamp",
    )
    edges = spark.createDataFrame([(a, b, f"e{k:02d}", r) for k, (a, b, r) in enumerate(links)], EDGE)
    return anchors, states, edges


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_neighbourhood(spark):
    anchors, _, edges = store(
        spark,
        [("p", "product", "P", None), ("t", "task", "T", None), ("r", "repo", "R", None), ("g", "rag", "G", None), ("x", "text", "X", "hi")],
        [("p", "t", "contains"), ("t", "r", "linked"), ("g", "p", "linked"), ("p", "x", "describes")],
    )
    def around(depth, way):
        nodes, links, flags = G.neighbourhood(edges, anchors, ids(spark, "p"), depth, way)
        return {r.node: r.depth for r in nodes.collect()}, links.count(), flags.first().truncated
    assert around(5, "both") == ({"p": 0, "t": 1, "r": 2, "g": 1}, 3, False)
    assert around(5, "out")[0] == {"p": 0, "t": 1, "r": 2}
    assert around(1, "both")[2] is True
    nodes, _, _ = G.neighbourhood(edges, anchors, ids(spark, "x"), 1, "out")
    assert [r.node for r in nodes.collect()] == ["x"]


def test_tree_and_export(spark):
    anchors, states, edges = store(
        spark,
        [("p", "product", "P", None), ("a", "task", "A", None), ("b", "task", "B", None), ("x", "text", "X", "first line\nsecond")],
        [("p", "a", "contains"), ("a", "b", "contains"), ("b", "p", "linked"), ("p", "x", "describes")],
    )
    rows = G.tree_rows(edges, ids(spark, "p"), anchors, states, 10).orderBy("path").collect()
    assert [r.line for r in rows] == [
        "p product P",
        "  contains → a  task A",
        "    contains → b  task B",
        "      linked → p  product P (already shown above — cycle)",
        '  describes → x  text "first line"',
    ]
    nodes, walked = G.subgraph(edges, ids(spark, "p", "x"), 1)
    labelled = G.with_meta(nodes, anchors, states)
    parts = {
        (items, r.root): json.loads(r.json)
        for items in (1, 2, 1000)
        for r in G.assemble(G.export_parts(labelled, walked, items)).collect()
    }
    for items in (1, 2, 1000):
        doc = parts[items, "p"]
        assert doc["root"] == "p" and doc["truncated_at_depth"] is True
        assert [(n["uid"], n["depth"]) for n in doc["nodes"]] == [("p", 0), ("a", 1), ("x", 1)]
        assert doc["nodes"][0]["content"] is None and doc["nodes"][2]["content"] == "first line\nsecond"
        assert [e["edge_uid"] for e in doc["edges"]] == ["e00", "e03"]
        assert parts[items, "x"]["edges"] == []
    nodes_back, edges_back = G.import_documents(
        spark.createDataFrame([('{"root":"q","nodes":[{"uid":"q","type":"task","name":"n"}],"edges":[]}',)], "json string")
    )
    back = nodes_back.first()
    assert (back.uid, back.version, back.depth) == ("q", "", 0) and edges_back.count() == 0


def plain_tree(edges, root, depth):
    """(path of edge ids, node, whether it is marked) in the order of a recursive drawing."""
    seen, walked, _ = plain_walk(edges, root, depth, False)
    below = defaultdict(list)
    for a, b, uid, _ in sorted(edges, key=lambda e: e[2]):
        if uid in walked:
            below[a].append((uid, b))
    out, drawn = [((), root, False)], {root}

    def draw(node, path):
        for uid, child in below[node]:
            fresh = child not in drawn
            drawn.add(child)
            out.append(((*path, uid), child, not fresh and bool(below[child])))
            if fresh:
                draw(child, (*path, uid))

    draw(root, ())
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("depth", [2, 20])
def test_tree_is_drawn_depth_first(spark, seed, depth):
    """Many parents, cycles and parallel edges: line for line the recursive drawing."""
    edges = random_edges(seed, nodes=11, count=28)
    df = spark.createDataFrame(edges, EDGE)
    roots = ["n00", "n03", "gone"]
    anchors, states, _ = store(spark, [(f"n{i:02d}", "task", f"N{i}", None) for i in range(11)], [("a", "b", "contains")])
    rows = G.tree_rows(df, spark.createDataFrame([(r,) for r in roots], "id string"), anchors, states, depth).collect()
    for root in roots:
        own = sorted((r for r in rows if r.root == root), key=lambda r: r.nth)
        assert [r.nth for r in own] == list(range(1, len(own) + 1))
        assert [(tuple(r.path), r.node, r.repeated) for r in own] == plain_tree(edges, root, depth)
        assert all(r.depth == len(r.path) for r in own)


def test_trees_look_for_places_of_nodes_with_children_alone(spark, monkeypatch):
    written = []
    add = session.Rounds.add

    def counted(self, df):
        rows = add(self, df)
        written.append(rows.count())
        return rows

    monkeypatch.setattr(session.Rounds, "add", counted)
    edges = [("r", "a", "e0", "contains"), ("r", "b", "e1", "contains")]
    edges += [("a" if k % 2 else "b", f"x{k:03d}", f"f{k:03d}", "contains") for k in range(300)]
    anchors, states, _ = store(spark, [("r", "task", "R", None)], [("a", "b", "contains")])
    rows = G.tree_rows(spark.createDataFrame(edges, EDGE), ids(spark, "r"), anchors, states, 2).collect()
    assert len(rows) == 303 and [r.node for r in sorted(rows, key=lambda r: r.nth)][:3] == ["r", "a", "x001"]
    assert not any(r.repeated for r in rows)
    assert sum(written) < 20


def test_rounds_write_what_their_frontier_is(spark, monkeypatch):
    """A chain beside many tasks that wait for its end: until then a round writes one row."""
    sizes = defaultdict(list)
    add = session.Rounds.add

    def counted(self, df):
        rows = add(self, df)
        sizes[self.path].append(rows.count())
        return rows

    monkeypatch.setattr(session.Rounds, "add", counted)
    n = 20
    chain = spark.range(1, n).selectExpr("id as task", "id - 1 as dep")
    wide = spark.range(1000, 3000).selectExpr("id as task", f"{n - 1}L as dep")
    tasks = spark.range(n).union(spark.range(1000, 3000)).toDF("task")
    placed, stuck = S.waves(tasks, chain.union(wide).union(wide))
    wave = {r.task: r.wave for r in placed.collect()}
    assert wave == {k: k + 1 for k in range(n)} | {k: n + 1 for k in range(1000, 3000)} and stuck.isEmpty()
    assert list(sizes.values()) == [[1] * n + [2000, 0]]


def test_ancestors_take_rounds_of_doubling_length(spark, monkeypatch):
    names = []
    monkeypatch.setattr(G, "written", lambda df, name="rows": names.append(name) or session.written(df, name))
    edges = spark.range(1, 200).selectExpr("concat('n', id) as out", "concat('n', id - 1) as `in`", "concat('e', id) as edge_uid", "'contains' as rel_type")
    starts = spark.range(200).selectExpr("concat('n', id) as id")
    found = defaultdict(list)
    for r in sorted(G.ancestors(edges, starts, 100).collect(), key=lambda r: r.step):
        found[r.start].append(r.ancestor)
    assert names.count("jumps") == 8 and "choices" not in names  # 1, 2, 4, ... 128 steps
    assert all(found[f"n{k}"] == [f"n{j}" for j in range(k - 1, max(k - 101, -1), -1)] for k in range(200))


def test_frontiers_meet_links_without_moving_them(spark, monkeypatch):
    links = spark.range(5000).selectExpr("id % 500 as near", "id as far")
    table = Adjacency(links.union(links), "near")
    few = session.written(spark.range(3).selectExpr("id as near"))
    assert table.meet(few).count() == 30
    plan = table.meet(few)._jdf.queryExecution().executedPlan().toString()
    assert "In(near, [0,1,2])" in plan or "near IN (0,1,2)" in plan.replace("`", "") or "INSET" in plan
    assert "SelectedBucketsCount: 4 out of 4" not in plan or "PushedFilters: [In(near" in plan
    assert table.meet(few.where('near > 5')) is None
    monkeypatch.setattr(adjacency, "PUSHED", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = table.meet(few)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and joined.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_and_history(spark):
    schema = "id string, in string, out string, edge_uid string, rel_type string, active boolean, valid_from timestamp"
    log = []
    def view():
        return spark.createDataFrame(log, schema) if log else spark.createDataFrame([], schema)
    types = spark.createDataFrame([("linked", "relation"), ("task", "entity")], "name string, category string")
    asked = spark.createDataFrame(
        [("1", "a", "b", "linked"), ("2", "a", "b", "linked"), ("3", "a", "a", "linked"), ("4", "a", "b", "task")],
        "id string, in string, out string, rel_type string",
    )
    ok, refused = Q.check_links(asked, types, view())
    assert [r.id for r in ok.collect()] == ["1"]
    assert {r.id: r.reason for r in refused.collect()} == {
        "2": "asked for twice", "3": "self link", "4": "unknown relation"}
    log.append(("e1", "a", "b", "u1", "linked", True, T0))
    _, refused = Q.check_links(asked.limit(1), types, view())
    assert refused.first().reason == "already linked"
    rows, _ = Q.unlink(asked.limit(1), view(), F.lit(T0 + dt.timedelta(seconds=1)))
    off = rows.first()
    assert off.edge_uid == "u1" and off.active is False
    log.append((off.id, "a", "b", "u1", "linked", False, off.valid_from))
    _, gone = Q.unlink(asked.limit(1), view(), F.lit(T0))
    assert gone.first().reason == "no active link"
    assert Q.check_links(asked.limit(1), types, view())[0].count() == 1
    log.append(("e3", "a", "b", "u2", "linked", True, T0 + dt.timedelta(seconds=2)))
    active = V.current_edges(view()).where("active").collect()
    assert [r.edge_uid for r in active] == ["u2"]


def test_instants_not_text(spark):
    rows = spark.sql("""select * from values
      ('1','u','a', timestamp'2026-01-01T10:00:06Z'), ('2','u','b', timestamp'2026-01-01T10:00:06.5Z')
      t(id, edge_uid, tag, valid_from)""")
    assert V.current_edges(rows).first().tag == "b"


def test_role_texts_and_deep_chain(spark):
    anchors, states, edges = store(spark, [("t", "task", "T", None)], [])
    asked = spark.createDataFrame([("t", "describes", "long " * 20 + "\nmore")], "entity string, role string, text string")
    a, s, l = G.set_role_texts(asked, edges, F.lit(T0))
    node, name = s.first().entity, s.first().name
    assert a.count() == 1 and l.count() == 1 and name == ("long " * 20)[:40] + "…"
    edges2 = edges.unionByName(l.select("in", "out", "edge_uid", "rel_type"))
    a2, s2, l2 = G.set_role_texts(asked, edges2, F.lit(T0))
    assert a2.count() == 0 and l2.count() == 0 and s2.first().entity == node
    chain = spark.createDataFrame([(f"{i:02d}", "x", f"v{i}", T0 + dt.timedelta(seconds=i)) for i in range(26)], "id string, entity string, name string, valid_from timestamp")
    assert V.latest_by(chain, ["entity"]).first().name == "v25"
    assert V.history(chain, ["entity"]).agg(F.max("version")).first()[0] == 26


@pytest.mark.parametrize("seed", range(2))
def test_planning(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i:02d}" for i in range(12)]
    needs = {name: set(rng.sample(names[:i], min(i, rng.randrange(3)))) for i, name in enumerate(names)}
    noted = rng.sample(names, 3)
    links = [(t, d, "depends_on") for t in names for d in sorted(needs[t])] + [(t, "note", "depends_on") for t in noted]
    entities = [(n, "task", n.upper(), None) for n in names] + [("note", "document", "NOTE", None)]
    anchors, states, edges = store(spark, entities, links)
    nodes = anchors.join(states.select("entity", "name"), anchors["id"] == states["entity"]).select(
        F.col("id").alias("node"), "entity_type", "name")
    tasks, deps, warnings = S.dependencies(nodes, edges)
    assert sorted((r.task, r.dep) for r in warnings.collect()) == sorted((t, "note") for t in noted)
    wave, back, behind = {}, {}, set()
    bad = rng.choice(names[:4])
    for name in names:
        wave[name] = 1 + max((wave[d] for d in needs[name]), default=0)
        if needs[name] & (behind | {bad}):
            behind.add(name)
    for name in reversed(names):
        back[name] = 1 + max((back[t] for t in names if name in needs[t]), default=0)
    placed, stuck = S.waves(tasks, deps)
    assert {r.task: r.wave for r in placed.collect()} == wave and stuck.count() == 0
    failed = spark.createDataFrame([(bad,)], "task string")
    assert {r.task for r in S.blocked(deps, failed).collect()} == behind
    assert {r.task: r.wave for r in S.reverse_waves(tasks, deps).collect()} == back


def test_outcomes(spark):
    tasks = spark.createDataFrame(
        [("a", "active"), ("b", "failed"), ("c", "active"), ("d", "active"), ("e", "active"), ("x", "active"), ("y", "active"), ("z", "active")],
        "task string, outcome string")
    deps = spark.createDataFrame(
        [("b", "a", 0), ("c", "a", 0), ("c", "b", 1), ("d", "c", 0), ("e", "ghost", 0), ("e", "b", 1), ("x", "y", 0), ("y", "x", 0), ("z", "x", 0)],
        "task string, dep string, position int")
    got = {r.task: (r.outcome, r.reason) for r in S.outcomes(tasks, deps).collect()}
    assert got["a"] == ("active", None) and got["b"] == ("failed", None)
    assert got["c"] == ("skipped", "dependency 'b' is failed")
    assert got["d"] == ("skipped", "dependency 'c' is skipped")
    assert got["e"] == ("skipped", "depends on unknown 'ghost'")
    assert got["x"][0] == got["y"][0] == got["z"][0] == "not started"


@pytest.mark.parametrize("seed", range(3))
def test_chains_between_forks(spark, monkeypatch, seed):
    """Chains, forks and cycles at random: outcomes and blocked tasks as a plain walk finds them."""
    rng = random.Random(seed)
    n = 60
    links = {(k, k - 1) for k in range(1, n) if k % 13}
    links |= {(rng.randrange(n), rng.randrange(n)) for _ in range(6)}
    bad = set(rng.sample(range(n), 3))
    needs = defaultdict(set)
    for task, dep in links:
        needs[task].add(dep)

    def closure(start):
        met, todo = set(), [start]
        while todo:
            for d in needs[todo.pop()] - met:
                met.add(d)
                todo.append(d)
        return met

    below = {k: closure(k) for k in range(n)}
    behind = {k for k in range(n) if below[k] & bad}
    stuck = {k for k in range(n) if k in below[k] or any(d in below[d] for d in below[k])}
    deps = spark.createDataFrame([(t, d, 0) for t, d in sorted(links)], "task long, dep long, position int")
    failed = spark.createDataFrame([(k,) for k in sorted(bad)], "task long")
    monkeypatch.setattr(S, "PUSHED", 0)
    assert sorted(r.task for r in S.blocked(deps, failed).collect()) == sorted(behind)
    tasks = spark.createDataFrame([(k, "failed" if k in bad else "active") for k in range(n)], "task long, outcome string")
    got = {r.task: r.outcome for r in S.outcomes(tasks, deps).collect()}
    assert got == {k: "not started" if k in stuck else "skipped" if k in behind else "failed" if k in bad else "active" for k in range(n)}


def test_outcomes_take_rounds_of_doubling_length(spark, monkeypatch):
    rounds = defaultdict(int)
    add = session.Rounds.add

    def counted(self, df):
        rounds[self.path] += 1
        return add(self, df)

    monkeypatch.setattr(session.Rounds, "add", counted)
    n = 100
    tasks = spark.range(n).selectExpr("id as task", "if(id = 40, 'failed', 'active') as outcome")
    deps = spark.range(1, n).selectExpr("id as task", "id - 1 as dep", "0 as position")
    got = {r.task: r.outcome for r in S.outcomes(tasks, deps).collect()}
    assert got == {k: "active" if k < 40 else "failed" if k == 40 else "skipped" for k in range(n)}
    assert sum(rounds.values()) <= 9  # 1, 2, 4, ... 128 links


def test_runnable(spark):
    tasks = spark.createDataFrame([("f", t) for t in "abcde"], "firing string, task string")
    deps = spark.createDataFrame([("f", "b", "a"), ("f", "c", "a"), ("f", "d", "z"), ("f", "e", "b")], "firing string, task string, dep string")
    status = spark.createDataFrame([("f", "a", "done"), ("f", "z", "failed")], "firing string, task string, status string")
    free = S.runnable(tasks, deps, status).collect()
    assert sorted(r.task for r in free) == ["b", "c"]
    assert [r.task for r in S.runnable(tasks, deps, status, slots=1).collect()] == ["b"]
