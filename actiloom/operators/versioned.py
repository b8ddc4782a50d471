"""Append-only chains: the newest row of a chain is its current state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import jsonval as J
from . import ordered

ORDER = ("valid_from", "id")


def latest_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ORDER,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The newest row per chain, ties broken by the last order column.

    ``max_by`` combines inside the map tasks: one row per chain and task is
    shuffled, so a chain with very many versions costs no more than others.
    ``columns`` names what is needed besides the keys; Spark cannot prune
    inside the aggregate, so naming them keeps the others out of the scan.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    latest = df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")
    return latest if columns is not None else latest.select(*df.columns)


def current_state(ledger: DataFrame) -> DataFrame:
    return latest_by(ledger, ["target", "type"])


def supersede(requests: DataFrame, now: Column) -> DataFrame:
    """Rows to append for (target, type, payload) requests."""
    return requests.select(
        F.expr("uuid()").alias("id"), "target", "type", "payload", now.alias("valid_from")
    )


def history(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER) -> DataFrame:
    """Every version with its number in the chain, 1 for the oldest."""
    return ordered.with_running(df, keys, order, {"version": ordered.count_rows()})


def carry_forward(
    patches: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """A sequence of patches to full versions: an unset field keeps its last value."""
    filled = ordered.with_running(
        patches,
        keys,
        order,
        {f"_full_{f}": ordered.last_of(F.col(f)) for f in fields},
    )
    kept = [c for c in patches.columns if c not in fields]
    return filled.select(*kept, *[F.col(f"_full_{f}").alias(f) for f in fields])


def apply_patches(current: DataFrame, patches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One patch per entity on its current state: (rows to append, refused)."""
    p, c = patches.alias("p"), current.alias("c")
    joined = p.join(c, F.col("p.entity") == F.col("c.entity"), "left")
    found = joined.where(F.col("c.entity").isNotNull()).select(
        F.expr("uuid()").alias("id"),
        F.col("p.entity").alias("entity"),
        *[
            F.coalesce(F.col(f"p.{f}"), F.col(f"c.{f}")).alias(f)
            for f in ("name", "content", "attributes")
        ],
        now.alias("valid_from"),
    )
    refused = joined.where(F.col("c.entity").isNull()).select(
        "p.*", F.lit("no state chain").alias("reason")
    )
    return found, refused


def current_meta(ids: DataFrame, anchors: DataFrame, states: DataFrame) -> DataFrame:
    """Type, labels and version stamp of a set of anchors (column ``id``).

    An anchor without states has empty fields; an unknown id is dropped.
    """
    wanted_columns = ("name", "content", "attributes", "valid_from")
    now = latest_by(states, ["entity"], columns=wanted_columns).select(
        F.col("entity").alias("id"),
        "name",
        "content",
        "attributes",
        F.col("valid_from").alias("version"),
    )
    wanted = ids.select("id").distinct()
    return (
        wanted.join(anchors, "id")
        .join(now, "id", "left")
        .select(
            "id",
            "entity_type",
            F.coalesce("name", F.lit("")).alias("name"),
            "content",
            "attributes",
            "version",
            "created_at",
        )
    )


def current_edges(edges: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row per edge chain, active or not; times compare as instants."""
    return latest_by(edges, ["edge_uid"], order)


def current_schedules(schedules: DataFrame) -> DataFrame:
    return latest_by(schedules, ["uid"])


def current_runs(runs: DataFrame, schedule: object | None = None) -> DataFrame:
    """The newest row per run; a schedule filter applies before the reduction."""
    chosen = runs if schedule is None else runs.where(F.col("schedule") == F.lit(schedule))
    return latest_by(chosen, ["uid"])


def module_ledger(modules: DataFrame) -> DataFrame:
    return latest_by(modules, ["uid"])


def register_modules(ledger: DataFrame, descriptors: DataFrame, now: Column) -> DataFrame:
    """Ledger rows for registrations; ``provisioned`` is carried, false at first."""
    before = module_ledger(ledger).select("uid", F.col("provisioned").alias("_before"))
    return descriptors.join(before, "uid", "left").select(
        F.expr("uuid()").alias("id"),
        "uid",
        "entity",
        "kind",
        "version",
        F.coalesce("_before", F.lit(False)).alias("provisioned"),
        now.alias("valid_from"),
    )


def state_columns(ledger: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Current payloads side by side: one row per target, one column per type.

    ``types`` maps an attribute type to its column name. One aggregation
    replaces a current-state view and a join per type.
    """
    stamp = F.struct(*ORDER)
    wanted = ledger.where(F.col("type").isin(list(types)))
    return wanted.groupBy("target").agg(
        *[
            F.max_by("payload", F.when(F.col("type") == kind, stamp)).alias(name)
            for kind, name in types.items()
        ]
    )


MODULE_STATE = {
    "attr_module_descriptor": "descriptor",
    "attr_module_status": "intent",
    "attr_lifecycle_state": "lifecycle",
}


def registry_status(entities: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every registered entity with version and lifecycle.

    No descriptor: the row is dropped. No lifecycle: ``enabled``. No version: ''.
    """
    state = state_columns(ledger, MODULE_STATE)
    descriptor = F.col("descriptor")
    return (
        entities.select(F.col("id").alias("target"), F.col("type").alias("kind"))
        .join(state.where("descriptor is not null"), "target")
        .select(
            "target",
            "kind",
            J.str_field(descriptor, "name").alias("name"),
            F.coalesce(J.str_field(descriptor, "version"), F.lit("")).alias("version"),
            F.coalesce(J.str_field(F.col("lifecycle"), "tag"), F.lit("enabled")).alias(
                "lifecycle"
            ),
        )
    )


def operator_intent(entities: DataFrame, ledger: DataFrame) -> DataFrame:
    """enabled or disabled per module; anything else is flagged corrupt."""
    state = state_columns(ledger, {"attr_module_status": "intent"})
    status = J.str_field(F.col("intent"), "status")
    return (
        entities.select(F.col("id").alias("target"))
        .join(state, "target", "left")
        .select(
            "target",
            F.when(F.col("intent").isNull(), "enabled").otherwise(status).alias("status"),
            (
                F.col("intent").isNotNull()
                & ~F.coalesce(status.isin(model.MODULE_INTENTS), F.lit(False))
            ).alias("corrupt"),
        )
    )


def decode_lifecycle(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tagged lifecycle records to a STRUCT: (decoded, rejected).

    A missing duration is 0 and a negative one becomes 0. An unknown tag is
    rejected, never defaulted.
    """
    schema = (
        "tag string, error string, failed_during string, reason string,"
        " startup_duration_ms bigint"
    )
    read = states.withColumn("_s", F.from_json("payload", schema))
    tag = F.col("_s.tag")
    known = F.coalesce(tag.isin(model.LIFECYCLE_TAGS), F.lit(False))

    def only(kind: str, value: Column) -> Column:
        return F.when(tag == kind, value)

    empty = F.lit("")
    lifecycle = F.struct(
        tag.alias("tag"),
        only("failed", F.coalesce("_s.error", empty)).alias("error"),
        only("failed", F.coalesce("_s.failed_during", empty)).alias("failed_during"),
        only("skipped", F.coalesce("_s.reason", empty)).alias("reason"),
        only(
            "active", F.greatest(F.coalesce("_s.startup_duration_ms", F.lit(0)), F.lit(0))
        ).alias("startup_duration_ms"),
    )
    kept = [F.col(c) for c in states.columns]
    decoded = read.where(known).select(*kept, lifecycle.alias("lifecycle"))
    rejected = read.where(~known).select(
        *kept,
        F.concat(F.lit("unknown lifecycle tag '"), F.coalesce(tag, empty), F.lit("'")).alias(
            "reason"
        ),
    )
    return decoded, rejected


#: What a state of each tag records besides the tag.
LIFECYCLE_FIELDS = {"failed": ["error", "failed_during"], "skipped": ["reason"], "active": ["startup_duration_ms"]}


def change_lifecycle(
    requests: DataFrame, names: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger rows, events, refused) for changes of modules' lifecycles.

    ``requests`` have ``id``, ``name``, ``tag``, ``error``, ``failed_during``, ``reason``
    and ``startup_duration_ms``; ``names`` gives each module's ``entity``. A state keeps
    the fields of its tag alone, a missing text being empty and a missing or negative
    duration 0; the event announces the same. An unknown module or tag is refused.
    Ids follow from the request, so writing a batch again changes nothing.
    """
    known = names.groupBy("name").agg(F.min("entity").alias("entity"))
    tag = F.col("tag")
    refusal = F.when(
        ~F.coalesce(tag.isin(model.LIFECYCLE_TAGS), F.lit(False)), F.lit("unknown tag")
    ).when(F.col("entity").isNull(), F.lit("unknown module"))
    judged = requests.join(known, "name", "left").withColumn("refusal", refusal)
    values = {
        "startup_duration_ms": F.greatest(F.coalesce(F.col("startup_duration_ms").cast("bigint"), F.lit(0)), F.lit(0))
    }

    def own(field: str) -> Column:
        tags = [t for t, fields in LIFECYCLE_FIELDS.items() if field in fields]
        return F.when(tag.isin(tags), values.get(field, F.coalesce(field, F.lit("")))).alias(field)

    fields = [own(f) for fields in LIFECYCLE_FIELDS.values() for f in fields]
    done = judged.where("refusal is null")
    states = done.select(
        F.concat(F.col("id").cast("string"), F.lit("-state")).alias("id"),
        F.col("entity").alias("target"),
        F.lit("attr_lifecycle_state").alias("type"),
        F.to_json(F.struct("tag", *fields)).alias("payload"),
        now.alias("valid_from"),
    )
    events = done.select(
        F.concat(F.col("id").cast("string"), F.lit("-event")).alias("id"),
        F.concat(F.lit("module_"), tag).alias("lifecycle_event"),
        F.to_json(F.struct("name", *fields)).alias("payload"),
        F.col("entity").cast("string").alias("subject"),
        F.lit(None).cast("string").alias("agent"),
        now.alias("valid_from"),
    )
    return states, events, judged.where("refusal is not null").select(*requests.columns, "refusal")


def module_inventory(modules: DataFrame, entities: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inventory with intent, lifecycle and provisioning.

    Defaults: version ``-``, intent ``enabled``, lifecycle ``never-booted``.
    """
    current = module_ledger(modules).select("uid", "entity", "kind", "version", "provisioned")
    state = state_columns(ledger, MODULE_STATE)
    inventory = entities.select(
        F.col("id").alias("entity"), F.col("type").alias("entity_type")
    ).join(current, "entity", "left")
    return inventory.join(state, inventory["entity"] == state["target"], "left").select(
        "entity",
        F.coalesce("kind", "entity_type").alias("kind"),
        F.coalesce(
            F.nullif("version", F.lit("")),
            J.str_field(F.col("descriptor"), "version"),
            F.lit("-"),
        ).alias("version"),
        F.coalesce(J.str_field(F.col("intent"), "status"), F.lit("enabled")).alias(
            "intent"
        ),
        F.coalesce(J.str_field(F.col("lifecycle"), "tag"), F.lit("never-booted")).alias(
            "lifecycle"
        ),
        F.coalesce("provisioned", F.lit(False)).alias("provisioned"),
    )
