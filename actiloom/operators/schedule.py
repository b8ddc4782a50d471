"""Scheduling data: chains, due work, execution waves, blocked and runnable tasks.

Dependencies are (task, dep): ``task`` runs after ``dep``. Tasks are a column
``task``. All loops cut lineage with a reliable checkpoint per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..session import Rounds, written
from . import graph, versioned
from .adjacency import PUSHED, Adjacency


# -- chains ------------------------------------------------------------------


def create_schedules(requests: DataFrame, now: Column) -> DataFrame:
    """First rows of new chains for (entity, run_at, recurrence) requests."""
    return requests.select(
        F.expr("uuid()").alias("id"),
        F.expr("uuid()").alias("uid"),
        "entity",
        "run_at",
        F.coalesce("recurrence", F.lit("none")).alias("recurrence"),
        F.lit("scheduled").alias("status"),
        now.alias("valid_from"),
    )


def transition(
    current: DataFrame, requests: DataFrame, status: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(rows to append, refused) for moving chains (column ``uid``) to ``status``.

    The new row carries the intent fields. Cancelling a cancelled chain and
    touching an unknown one are refused.
    """
    wanted = requests.select("uid").distinct()
    chain = current.select(
        F.col("uid"), "entity", "run_at", "recurrence", F.col("status").alias("_status"), F.lit(True).alias("_known")
    )
    joined = wanted.join(chain, "uid", "left")
    reason = F.when(F.col("_known").isNull(), "unknown schedule")
    if status == "cancelled":
        reason = reason.when(F.col("_status") == "cancelled", "already cancelled")
    judged = joined.withColumn("reason", reason)
    rows = judged.where("reason is null").select(
        F.expr("uuid()").alias("id"),
        "uid",
        "entity",
        "run_at",
        "recurrence",
        F.lit(status).alias("status"),
        now.alias("valid_from"),
    )
    return rows, judged.where("reason is not null").select("uid", "reason")


def run_rows(transitions: DataFrame, now: Column) -> DataFrame:
    """Run rows to append; optional columns that are missing become null."""
    optional = {
        "instruct_version": "timestamp",
        "output_ref": "string",
        "detail": "string",
    }
    present = [
        F.col(c) if c in transitions.columns else F.lit(None).cast(kind).alias(c)
        for c, kind in optional.items()
    ]
    return transitions.select(
        F.expr("uuid()").alias("id"),
        "uid",
        "schedule",
        "firing",
        "task",
        "status",
        *present,
        now.alias("valid_from"),
    )


def due(schedules: DataFrame, now) -> DataFrame:
    """Current schedules still waiting whose time has come."""
    current = versioned.current_schedules(schedules)
    return current.where((F.col("status") == "scheduled") & (F.col("run_at") <= clock.mark(schedules, now, "run_at")))


def queue_view(schedules: DataFrame, names: DataFrame) -> DataFrame:
    """Waiting schedules, soonest first, with the entity's name."""
    waiting = versioned.current_schedules(schedules).where("status = 'scheduled'")
    labels = names.select(F.col("id").alias("entity"), "name")
    return (
        waiting.join(labels, "entity", "left")
        .select(
            "uid",
            "entity",
            F.coalesce("name", F.lit("(unresolved)")).alias("name"),
            "run_at",
            "recurrence",
        )
        .orderBy("run_at", "uid")
    )


def recurrence(schedules: DataFrame, now) -> DataFrame:
    """``scheduled`` rows that follow current ``fired`` rows with ``every:<duration>``.

    ``none`` rests, a cancelled chain stays cancelled, a bad token is skipped.
    """
    at = clock.instant(now)
    fired = versioned.current_schedules(schedules).where("status = 'fired'")
    every = fired.where(F.startswith("recurrence", F.lit("every:")))
    token = F.substr("recurrence", F.lit(len("every:") + 1))
    next_run = clock.add_duration(at, token)
    return every.withColumn("_next", next_run).where("_next is not null").select(
        F.concat(F.col("id").cast("string"), F.lit("-next")).alias("id"),
        "uid",
        "entity",
        F.col("_next").alias("run_at"),
        "recurrence",
        F.lit("scheduled").alias("status"),
        at.alias("valid_from"),
    )


def done_tasks(runs: DataFrame, firing=None, order=versioned.ORDER) -> DataFrame:
    """(firing, task) whose current run is done."""
    rows = runs if firing is None else runs.where(F.col("firing") == F.lit(firing))
    current = versioned.latest_by(rows, ["uid"], order, ("firing", "task", "status"))
    return current.where("status = 'done'").select("firing", "task").distinct()


# -- dependencies ------------------------------------------------------------


def dependencies(
    nodes: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, deps, warnings) of a subgraph.

    An edge from a node that is no task is ignored; one to such a node is
    treated as satisfied and warned about.
    """
    tasks = nodes.where("entity_type = 'task'").select(F.col("node").alias("task"), "name").distinct()
    depends = (
        edges.where("rel_type = 'depends_on'")
        .select(F.col("in").alias("task"), F.col("out").alias("dep"))
        .distinct()
        .join(tasks, "task")
    )
    known = tasks.select(F.col("task").alias("dep"))
    deps = depends.join(known, "dep", "left_semi").select("task", "dep")
    warnings = depends.join(known, "dep", "left_anti").select("task", "name", "dep", F.lit("no task").alias("reason"))
    return tasks.select("task"), deps, warnings


#: Rounds after which the closed dependencies of all rounds are added up in one table.
MERGE = 16


def waves(tasks: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, wave) from 1, and the tasks no wave can hold.

    Every dependency knows how many its task has in all. A round looks only at the
    dependents of what was placed just before, adds what that closed to what
    earlier rounds had closed of the same tasks, and so tells which of them have
    none left. What a round writes follows its frontier, and not what still
    waits; of earlier rounds it reads the tasks with some but not all of their
    dependencies closed, now and then added up into one table. Counts are combined
    before they are shuffled, so a task with very many dependencies, or one that
    very many wait for, is no hot spot.
    """
    wanted = deps.where("dep is not null").select("task", "dep").distinct()
    counts = wanted.groupBy("task").agg(F.count(F.lit(1)).alias("all"))
    links = Adjacency(wanted.join(counts, "task"), "dep")
    known = tasks.select("task").distinct()
    rounds, merged, earlier = Rounds(tasks.sparkSession, "waves"), 0, None
    zero = F.lit(0).cast("bigint")
    start = known.join(links.links.select("task").distinct(), "task", "left_anti")
    ready = rounds.add(start.select("task", zero.alias("closed"), zero.alias("open")))
    while (hits := links.meet(ready.where("open = 0").select(F.col("task").alias("dep")))) is not None:
        some = rounds.read(merged).where("open > 0").select("task", "closed")
        some = some if earlier is None else some.unionAll(earlier.select("task", "closed"))
        none = F.lit(None).cast("bigint")
        both = hits.select("task", F.lit(1).cast("bigint").alias("closed"), F.lit(1).alias("now"), "all").unionAll(
            some.select("task", "closed", F.lit(0), none)
        )
        total = both.groupBy("task").agg(F.sum("closed").alias("so_far"), F.sum(F.col("closed") * F.col("now")).alias("closed"), F.max("all").alias("all"))
        ready = rounds.add(total.where("closed > 0").select("task", "closed", (F.col("all") - F.col("so_far")).alias("open")))
        if rounds.count - merged == MERGE:
            held = rounds.read(merged).select("task", "closed", "open")
            held = held if earlier is None else held.unionAll(earlier)
            held = held.groupBy("task").agg(F.sum("closed").alias("closed"), F.min("open").alias("open")).where("open > 0")
            earlier, merged = written(held, "closed"), rounds.count
    # A task that no wave can hold was never left without an open dependency.
    found = rounds.read().where("open = 0").select("task", (F.col("round") + 1).alias("wave")).join(known, "task", "left_semi")
    return found, known.join(found, "task", "left_anti")


def reverse_waves(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Stopping order: dependents before what they depend on.

    Tasks nothing else can order (a cycle) come last, together.
    """
    present = tasks.select("task").distinct()
    inner = (
        deps.where("task <> dep")
        .join(present, "task", "left_semi")
        .join(present.select(F.col("task").alias("dep")), "dep", "left_semi")
    )
    flipped = inner.select(F.col("dep").alias("task"), F.col("task").alias("dep"))
    placed, stuck = waves(present, flipped)
    last = placed.agg(F.coalesce(F.max("wave"), F.lit(0)).alias("m")).select(F.col("m") + 1).scalar()
    return placed.unionByName(stuck.withColumn("wave", last))


def _trim(links: DataFrame) -> DataFrame:
    """Links whose ends both have a way in and a way out, repeated to a fixed point."""
    count = links.count()
    while count:
        sources = links.select(F.col("task").alias("dep")).distinct()
        targets = links.select(F.col("dep").alias("task")).distinct()
        links = written(
            links.join(sources, "dep", "left_semi").join(targets, "task", "left_semi").select("task", "dep")
        )
        left = links.count()
        if left == count:
            break
        count = left
    return links


def cycle_members(deps: DataFrame) -> DataFrame:
    """Tasks that reach themselves along dependencies.

    Colouring: every node takes the smallest id that reaches it; walking back
    from each colour's root inside the colour gives one strongly connected
    component per colour. Nothing larger than the links themselves is kept,
    unlike a transitive closure. Rounds repeat on the links that remain.
    """
    links = written(deps.select("task", "dep").distinct())
    loops = links.where("task = dep").select("task")
    links = _trim(written(links.where("task <> dep")))
    found = [loops]
    while not links.isEmpty():
        colours = _colours(links)
        inside = written(_within_colour(links, colours))
        members = colours.where("node = colour").select("node", "colour")
        frontier = members
        while True:
            # Against the direction the colours ran in.
            back = (
                frontier.join(inside, (F.col("node") == F.col("to")) & (F.col("colour") == F.col("c")))
                .select(F.col("from").alias("node"), "colour")
                .distinct()
                .join(members, ["node", "colour"], "left_anti")
            )
            frontier = written(back)
            if frontier.isEmpty():
                break
            members = written(members.unionByName(frontier))
        sizes = members.groupBy("colour").count().where("count > 1").select("colour")
        found.append(members.join(sizes, "colour", "left_semi").select(F.col("node").alias("task")))
        gone = members.select("node")
        links = _trim(
            written(
                links.join(gone.select(F.col("node").alias("task")), "task", "left_anti").join(
                    gone.select(F.col("node").alias("dep")), "dep", "left_anti"
                ).select("task", "dep")
            )
        )
    return reduce(DataFrame.unionByName, found).distinct()


def _colours(links: DataFrame) -> DataFrame:
    """The smallest id that reaches each node along task -> dep."""
    nodes = links.select(F.col("task").alias("node")).union(links.select("dep")).distinct()
    colours = written(nodes.withColumn("colour", F.col("node")))
    while True:
        offers = (
            links.join(colours, links["task"] == colours["node"])
            .groupBy("dep")
            .agg(F.min("colour").alias("offer"))
        )
        moved = (
            colours.join(offers, colours["node"] == offers["dep"], "left")
            .select(
                "node",
                F.least("colour", F.coalesce("offer", "colour")).alias("colour"),
                (F.col("offer") < F.col("colour")).alias("_changed"),
            )
        )
        moved = written(moved)
        colours = moved.select("node", "colour")
        if moved.where("_changed").isEmpty():
            return colours


def _within_colour(links: DataFrame, colours: DataFrame) -> DataFrame:
    a = colours.select(F.col("node").alias("from"), F.col("colour").alias("c"))
    b = colours.select(F.col("node").alias("to"), F.col("colour").alias("c2"))
    named = links.select(F.col("task").alias("from"), F.col("dep").alias("to"))
    return named.join(a, "from").join(b, "to").where("c = c2").select("from", "to", "c")


def classify_stuck(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks no wave holds: ``on_cycle`` true, or false when merely behind one."""
    placed, stuck = waves(tasks, deps)
    among = deps.join(stuck, "task", "left_semi").join(
        stuck.select(F.col("task").alias("dep")), "dep", "left_semi"
    )
    on = cycle_members(among).withColumn("on_cycle", F.lit(True))
    return stuck.join(on, "task", "left").select(
        "task", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")
    )


def runnable(
    tasks: DataFrame,
    deps: DataFrame,
    status: DataFrame,
    keys: Sequence[str] = ("firing",),
    slots: int | None = None,
) -> DataFrame:
    """Tasks that can start now, for every firing at once.

    ``tasks`` has (*keys, task), ``deps`` (*keys, task, dep) and ``status``
    (*keys, task, status) with the current run. A task qualifies when it was
    not dispatched and every dependency is done; the first ``slots`` by id are
    taken, which is the free capacity of a firing. ``slots`` is a per-firing
    number and the rank filter keeps at most that many rows per map task.
    """
    on = [*keys, "task"]
    started = status.select(*on).distinct()
    done = status.where("status = 'done'").select(*keys, F.col("task").alias("dep")).distinct()
    waiting = deps.join(done, [*keys, "dep"], "left_anti").select(*on).distinct()
    free = (
        tasks.select(*on).distinct().join(started, on, "left_anti").join(waiting, on, "left_anti")
    )
    if slots is None:
        return free
    window = Window.partitionBy(*keys).orderBy("task")
    return free.withColumn("_n", F.row_number().over(window)).where(
        F.col("_n") <= int(slots)
    ).drop("_n")


def blocked(deps: DataFrame, failed: DataFrame) -> DataFrame:
    """(task) never dispatched because something it depends on, near or far, failed.

    Reachability from the failed tasks over reversed dependencies. A failed task
    behind another failed one is blocked as well. From few failed tasks it is a walk
    that follows its frontier; for many, chains are followed in doubling jumps first.
    """
    frontier = written(failed.select("task").distinct(), "failed")
    if len(frontier.take(PUSHED + 1)) <= PUSHED:
        return _spread(deps, frontier)
    return _behind(*_chains(deps, frontier))


def _spread(deps: DataFrame, frontier: DataFrame) -> DataFrame:
    """One multi-source walk that remembers only which tasks were met."""
    links = Adjacency(deps.select("task", "dep"), "dep")
    met = Rounds(deps.sparkSession, "blocked")
    while (hits := links.meet(frontier.select(F.col("task").alias("dep")))) is not None:
        step = hits.select("task").distinct()
        frontier = met.add(step.join(met.read().select("task"), "task", "left_anti") if met.count else step)
    return met.read().select("task") if met.count else frontier


def _chains(deps: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Where the tasks' dependencies lead, followed through tasks that have a single one.

    The first table has a row (task, end, hit, done) per task with one dependency,
    the second a row per dependency of those with several (None if no task has). ``end`` is
    the next task below with none or several, ``hit`` tells whether a task of ``marked``
    was met on the way, ``end`` included. Jumps double in length, so rounds are
    as many as the logarithm of the longest chain. A chain that runs into a cycle of
    single dependencies has no end: it is not ``done``, and its ``hit`` is complete too,
    since the rounds go on while any chain ends or meets its first marked task.
    """
    links = deps.where("dep is not null").select("task", "dep")
    heads = written(links.groupBy("task").agg(F.min("dep").alias("dep"), F.max("dep").alias("_last")), "heads")
    single, several = heads.where("dep = _last").select("task", "dep"), heads.where("dep <> _last").select("task")
    no, yes = F.lit(False), F.lit(True)
    nodes = single.select("task", yes.alias("one"), no.alias("hit")).unionAll(marked.select("task", no, yes))
    nodes = nodes.groupBy("task").agg(F.bool_or("one").alias("one"), F.bool_or("hit").alias("hit"))
    first = single.join(nodes.withColumnRenamed("task", "dep"), "dep", "left").select(
        "task", F.col("dep").alias("end"), F.coalesce("hit", no).alias("hit"), (~F.coalesce("one", no)).alias("done")
    )
    jumps, before = Rounds(deps.sparkSession, "jumps"), None
    going = jumps.add(first).where("not done")
    while (open_ := going.agg(F.count(F.lit(1)), F.count_if("hit")).first())[0] and open_ != before:
        before = open_
        newest = jumps.read().where(F.col("done") | (F.col("round") == jumps.count - 1)).drop("round")
        on = newest.select(F.col("task").alias("end"), F.col("end").alias("_end"), F.col("hit").alias("_hit"), F.col("done").alias("_done"))
        longer = going.join(on, "end").select("task", F.col("_end").alias("end"), (F.col("hit") | F.col("_hit")).alias("hit"), F.col("_done").alias("done"))
        going = jumps.add(longer).where("not done")
    newest = jumps.read().where(F.col("done") | (F.col("round") == jumps.count - 1)).drop("round")
    if several.isEmpty():
        return newest, None
    forks = links.join(several.withColumnRenamed("task", "_t"), F.col("task").eqNullSafe(F.col("_t")), "left_semi").distinct()
    forks = forks.join(newest.withColumnRenamed("task", "dep"), "dep", "left")
    forks = forks.join(marked.select(F.col("task").alias("dep"), yes.alias("_bad")).distinct(), "dep", "left").select(
        "task", F.coalesce("end", "dep").alias("end"), (F.coalesce("hit", no) | F.coalesce("_bad", no)).alias("hit"), F.coalesce("done", yes).alias("done")
    )
    return newest, written(forks.distinct(), "forks")


def _behind(jumps: DataFrame, forks: DataFrame | None) -> DataFrame:
    """(task), each once: what is behind a marked task. Forks are walked among themselves."""
    hit = jumps.where("hit").select("task")
    if forks is None:
        return hit
    seeds = written(forks.where("hit").select("task").distinct(), "seeds")
    far = _spread(forks.select("task", F.col("end").alias("dep")), seeds).unionAll(seeds)
    far = written(far.distinct(), "far")
    behind = jumps.where("not hit").join(far.select(F.col("task").alias("end")), "end", "left_semi")
    return hit.unionAll(behind.select("task")).unionAll(far).distinct()


def _never_placed(jumps: DataFrame, forks: DataFrame | None) -> DataFrame:
    """(task): what is on or behind a cycle. Waves are of the forks and of where chains end."""
    loops = jumps.where("not done").select("task")
    if forks is None:
        return loops
    # A fork that leads into a cycle of single dependencies waits for a task that is not there.
    tasks = forks.select("task").unionAll(forks.where("done").select("end"))
    stuck = written(waves(tasks, forks.select("task", F.col("end").alias("dep")))[1], "stuck")
    behind = jumps.where("done").join(stuck.select(F.col("task").alias("end")), "end", "left_semi")
    return loops.unionAll(behind.select("task")).unionAll(stuck)


def outcomes(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(task, outcome, reason) when work starts in dependency order.

    ``tasks`` has (task, outcome): what a task turns into if it is started.
    ``deps`` has (task, dep, position). A task is skipped when a dependency is
    unknown or not active; the first such one by position names the reason.
    Tasks on or behind a cycle are never started.

    Skipped are exactly the tasks behind a bad one, and never started those that
    no wave holds. Both follow from where chains of single dependencies lead, found
    once for all tasks; walks and waves go over the tasks with several dependencies
    alone. The reasons follow from one join.
    """
    own = written(tasks.select("task", "outcome"))
    known = own.select(F.col("task").alias("dep")).distinct().withColumn("known", F.lit(True))
    wanted = written(deps.select("task", "dep", "position").join(known, "dep", "left"))
    inner, unknown = wanted.where("known"), wanted.where("known is null")
    bad = own.where("outcome <> 'active'").select("task").unionAll(unknown.select("task"))
    chains = _chains(inner, bad)
    marks = _never_placed(*chains).withColumn("_stuck", F.lit(True)).unionAll(
        _behind(*chains).unionAll(unknown.select("task")).withColumn("_stuck", F.lit(False))
    )
    marks = marks.groupBy("task").agg(F.when(F.bool_or("_stuck"), "not started").otherwise("skipped").alias("_mark"))
    final = written(
        own.join(marks, "task", "left").select(
            "task", F.coalesce("_mark", "outcome").alias("outcome"), F.col("_mark").alias("mark")
        )
    )
    text = F.col("dep").cast("string")
    state = final.where("outcome <> 'active'").select(
        F.col("task").alias("dep"), F.col("outcome").alias("_o")
    )
    reasons = inner.join(state, "dep").select(
        "task",
        "position",
        F.concat(F.lit("dependency '"), text, F.lit("' is "), F.col("_o")).alias("reason"),
    ).unionAll(
        unknown.select(
            "task", "position", F.concat(F.lit("depends on unknown '"), text, F.lit("'"))
        )
    )
    first = reasons.groupBy("task").agg(F.min_by("reason", "position").alias("_reason"))
    reason = F.when(F.col("mark") == "skipped", F.col("_reason")).when(
        F.col("mark") == "not started", "on or behind a dependency cycle"
    )
    return final.join(first, "task", "left").select("task", "outcome", reason.alias("reason"))


# -- context documents -------------------------------------------------------


def task_context(
    nodes: DataFrame, edges: DataFrame, order: Sequence[str] = ("edge_uid",)
) -> DataFrame:
    """(root, task, prompt, instruct_version) for every task of each subgraph.

    ``nodes`` are (root, node, entity_type, name, content, attributes,
    version), ``edges`` (root, in, out, rel_type, edge_uid). Lines of one task
    stand in edge order; they are collected per task, which is the document's
    own size.
    """
    n = nodes.select(
        "root",
        F.col("node").alias("out"),
        F.col("entity_type").alias("n_type"),
        F.col("name").alias("n_name"),
        F.col("content").alias("n_content"),
        F.col("attributes").alias("n_attributes"),
        F.col("version").alias("n_version"),
    )
    tasks = nodes.where("entity_type = 'task'").select("root", F.col("node").alias("task"), "name")
    stamp = F.struct(*order)
    rel = F.col("rel_type")
    instructs = rel == "instructs"
    attributes = F.coalesce(F.concat(F.lit(" attributes: "), F.col("n_attributes")), F.lit(""))
    context = F.concat(
        F.lit("- ["), rel, F.lit("] "), F.col("n_name"), F.lit(" ("), F.col("n_type"), F.lit(")"), attributes, F.lit("\n")
    )
    told = F.concat(F.lit("\nInstructions:\n"), F.col("n_content"), F.lit("\n"))
    linked = (
        edges.join(n, ["root", "out"])
        .join(tasks.select("root", F.col("task").alias("in")), ["root", "in"], "left_semi")
        .withColumnRenamed("in", "task")
    )
    per_task = linked.groupBy("root", "task").agg(
        _ordered_text(F.when(instructs, told), stamp).alias("told"),
        _ordered_text(F.when(~instructs, context), stamp).alias("context"),
        F.max_by("n_version", F.when(instructs, stamp)).alias("instruct_version"),
    )
    about = (
        edges.where((F.col("in") == F.col("root")) & (rel == "describes"))
        .join(n, ["root", "out"])
        .groupBy("root")
        .agg(
            _ordered_text(
                F.concat(F.lit("\nAbout the product:\n"), F.col("n_content"), F.lit("\n")), stamp
            ).alias("about")
        )
    )
    empty = F.lit("")
    prompt = F.concat(
        F.lit("Task: "),
        F.col("name"),
        F.lit("\n"),
        F.coalesce("told", empty),
        F.coalesce("about", empty),
        F.when(
            F.coalesce("context", empty) != "", F.concat(F.lit("\nLinked context:\n"), F.col("context"))
        ).otherwise(""),
        F.lit("\nReport your result as plain text.\n"),
    )
    return (
        tasks.join(per_task, ["root", "task"], "left")
        .join(about, "root", "left")
        .select("root", "task", prompt.alias("prompt"), "instruct_version")
    )


def _ordered_text(piece: Column, stamp: Column) -> Column:
    pairs = F.collect_list(F.when(piece.isNotNull(), F.struct(stamp.alias("s"), piece.alias("t"))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["t"]), "")


def pinned_versions(runs: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """Each run with the exact instruction text it used.

    The pinned stamp joins to the state row of the task's instruction node.
    """
    instructs = edges.where("rel_type = 'instructs'").select(
        F.col("in").alias("task"), F.col("out").alias("text_node")
    )
    versions = states.select(
        F.col("entity").alias("text_node"),
        F.col("valid_from").alias("instruct_version"),
        F.col("content").alias("instructions"),
    )
    return (
        runs.where("instruct_version is not null")
        .join(instructs, "task")
        .join(versions, ["text_node", "instruct_version"])
        .select("uid", "task", "status", "text_node", "instruct_version", "instructions")
    )


def recurrence_events(rows: DataFrame) -> DataFrame:
    """Announcements for re-enqueued schedules."""
    payload = F.to_json(
        F.struct(F.col("uid").alias("schedule"), F.col("run_at").alias("next_run_at"))
    )
    return rows.select(
        F.col("id"),
        F.lit("recurrence_enqueued").alias("lifecycle_event"),
        payload.alias("payload"),
        F.lit(None).cast("string").alias("subject"),
        F.lit(None).cast("string").alias("agent"),
        "valid_from",
    )


