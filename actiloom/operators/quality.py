"""Integrity checks: each splits its input into accepted and refused-with-reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import clock
from ..functions import jsonval as J
from . import versioned

class Split(tuple):
    """(accepted, refused), and ``judged``: all rows with their ``reason`` or null.

    A caller that keeps both sides works from ``judged``, so the checks run once.
    """

    judged: DataFrame

    def __new__(cls, judged: DataFrame) -> Split:
        accepted = judged.where("reason is null").drop("reason")
        split = super().__new__(cls, (accepted, judged.where("reason is not null")))
        split.judged = judged
        return split


def _split(df: DataFrame, reason: Column, keep: Sequence[str] | None = None) -> Split:
    """Rows without a reason are accepted; ``keep`` names the columns to return."""
    return Split(df.select(*(keep or df.columns), reason.alias("reason")))


def ensure_types(existing: DataFrame, wanted: DataFrame, key: str = "uid") -> DataFrame:
    """Rows to append: unknown keys only, one row for a key asked for twice."""
    return wanted.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def seed_graph_types(existing: DataFrame, now: Column) -> DataFrame:
    """The contract types that are not registered yet; its count is the number created."""
    seed = existing.sparkSession.createDataFrame(model.GRAPH_TYPES, "name string, category string")
    return ensure_types(existing, seed, "name").withColumn("valid_from", now)


def register_types(existing: DataFrame, requests: DataFrame) -> Split:
    """Names match ``[a-z0-9_]+``, the category is known, the name is new."""
    known = existing.select("name").distinct().withColumn("_known", F.lit(True))
    firsts = requests.groupBy("name").agg(F.min("id").alias("_first"))
    joined = requests.join(firsts, "name", "left").join(known, "name", "left")
    reason = (
        F.when(~F.col("name").rlike("^[a-z0-9_]+$"), "bad name")
        .when(~F.col("category").isin(model.GRAPH_CATEGORIES), "bad category")
        .when(F.col("_known"), "already registered")
        .when(F.col("id") != F.col("_first"), "asked for twice")
    )
    return _split(joined, reason, requests.columns)


def check_category(rows: DataFrame, types: DataFrame, expected: str, column: str = "type") -> Split:
    """``column`` must name a type of the expected category.

    An unknown type and a type of another category give different reasons.
    """
    lookup = types.select(
        F.col("uid").alias("_uid"), F.col("category").alias("_category")
    ).dropDuplicates(["_uid"])
    joined = rows.join(lookup, F.col(column) == F.col("_uid"), "left")
    reason = F.when(F.col("_uid").isNull(), F.lit("unknown type")).when(
        F.col("_category") != expected,
        F.concat(F.lit("is of category "), F.col("_category"), F.lit(f", not {expected}")),
    )
    return _split(joined, reason, rows.columns)


def check_endpoint_roles(
    rows: DataFrame, entities: DataFrame, roles: Mapping[str, tuple[str, bool]]
) -> Split:
    """Foreign keys must point at entities of a given type.

    ``roles`` maps a column to (entity type, may be null).
    """
    joined = rows
    reasons = []
    for column, (kind, optional) in roles.items():
        # Only entities the column points at; a column with few values (agent)
        # then has a small side, and the rows are not shuffled by it.
        used = rows.select(F.col(column).alias("id")).where("id is not null").distinct()
        side = entities.join(used, "id", "left_semi").select(
            F.col("id").alias(f"_{column}_id"), F.col("type").alias(f"_{column}_type")
        )
        joined = joined.join(side, F.col(column) == F.col(f"_{column}_id"), "left")
        wrong = ~F.col(f"_{column}_type").eqNullSafe(F.lit(kind))
        if optional:
            wrong = wrong & F.col(column).isNotNull()
        reasons.append(F.when(wrong, F.lit(f"{column} is not a {kind}")))
    return _split(joined, F.coalesce(*reasons), rows.columns)


def check_enums(rows: DataFrame, allowed: Mapping[str, Sequence[str]]) -> Split:
    """Every listed column must hold one of its values."""
    reasons = [
        F.when(
            ~F.coalesce(F.col(c).isin(list(values)), F.lit(False)), F.lit(f"bad {c}")
        )
        for c, values in allowed.items()
    ]
    return _split(rows, F.coalesce(*reasons))


def check_vocabulary(rows: DataFrame, table: str) -> Split:
    """The columns of a table that only hold fixed words: each must hold one of its own."""
    return check_enums(rows, model.VOCABULARIES[table])


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_endpoints(edges: DataFrame, anchors: DataFrame) -> Split:
    """Both ends of an edge must exist."""
    known = anchors.select("id").distinct()
    a, b = known.select(F.col("id").alias("_in")), known.select(F.col("id").alias("_out"))
    joined = edges.join(a, F.col("in") == F.col("_in"), "left").join(
        b, F.col("out") == F.col("_out"), "left"
    )
    reason = F.when(F.col("_in").isNull(), F.lit("unknown source")).when(
        F.col("_out").isNull(), F.lit("unknown target")
    )
    return _split(joined, reason, edges.columns)


def _ends() -> list[Column]:
    return [F.col("in"), F.col("out"), F.col("rel_type")]


def active_links(edges: DataFrame, order: Sequence[str] = versioned.ORDER) -> DataFrame:
    """(in, out, rel_type) of links that are active now, one row each."""
    columns = ("in", "out", "rel_type", "active")
    now = versioned.latest_by(edges, ["edge_uid"], order, columns).where("active")
    return now.groupBy(*_ends()).agg(F.min("edge_uid").alias("edge_uid"))


def check_links(
    requests: DataFrame,
    types: DataFrame,
    edges: DataFrame,
    order: Sequence[str] = versioned.ORDER,
) -> Split:
    """A link needs a known relation, two different ends and no active twin.

    Of equal requests in one batch the first (by ``id``) is taken.
    """
    relations = (
        types.where("category = 'relation'").select(F.col("name").alias("_rel")).distinct()
    )
    ends, now = ["in", "out", "rel_type"], ("in", "out", "rel_type", "active")
    on = versioned.latest_by(edges, ["edge_uid"], order, now).where("active")
    asked = requests.select(*ends, F.col("id").alias("_id"), F.lit(False).alias("_on"))
    there = on.select(*ends, F.lit(None).cast(requests.schema["id"].dataType).alias("_id"), F.lit(True).alias("_on"))
    # Requests and active links meet in one aggregate with map-side combine, so one
    # link asked for very often does not fill one task; its result is dealt out as
    # the join back to the requests wants it.
    marks = asked.unionAll(there).groupBy(*ends).agg(F.min("_id").alias("_first"), F.bool_or("_on").alias("_taken"))
    joined = requests.join(marks, ends, "left").join(relations, F.col("rel_type") == F.col("_rel"), "left")
    reason = (
        F.when(F.col("_rel").isNull(), "unknown relation")
        .when(F.col("in") == F.col("out"), "self link")
        .when(F.col("_taken"), "already linked")
        .when(F.col("id") != F.col("_first"), "asked for twice")
    )
    return _split(joined, reason, requests.columns)


def unlink(
    requests: DataFrame, edges: DataFrame, now: Column, order: Sequence[str] = versioned.ORDER
) -> tuple[DataFrame, DataFrame]:
    """Edge rows that end active links, and requests without an active link."""
    live = active_links(edges, order)
    ends = ["in", "out", "rel_type"]
    wanted = requests.dropDuplicates(ends)
    rows = wanted.select(*ends).join(live, ends).select(
        F.expr("uuid()").alias("id"),
        *ends,
        "edge_uid",
        F.lit(False).alias("active"),
        now.alias("valid_from"),
    )
    refused = wanted.join(live, ends, "left_anti").withColumn("reason", F.lit("no active link"))
    return rows, refused


def require_types(rows: DataFrame, types: DataFrame, category: str, column: str) -> Split:
    """Check by name: unknown and wrong-category names give two reasons."""
    by_name = types.select(F.col("name").alias("uid"), "category")
    return check_category(rows, by_name, category, column)


def check_attributes(rows: DataFrame, column: str = "attributes") -> Split:
    """Attributes must be a JSON object; blank text means no change."""
    text = F.col(column)
    blank = text.isNull() | (F.trim(text) == "")
    verdict = J.let(
        J.parse_whole(text),
        lambda value: F.when(value.isNull(), F.lit("not JSON")).when(
            ~J.is_object(value), F.lit("not an object")
        ),
    )
    return _split(rows, F.when(~blank, verdict))


def check_durations(rows: DataFrame, column: str) -> Split:
    """Duration tokens to ``seconds`` and normal form ``token``."""
    parsed = rows.withColumns(
        {
            "seconds": clock.duration_seconds(F.col(column)),
            "token": clock.duration_token(F.col(column)),
        }
    )
    return _split(parsed, F.when(F.col("seconds").isNull(), F.lit("not a duration")))
