"""A join of wide rows to one row per key, when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are looked for as heavy, and those that the sketch counts to find them.
HEAVY, COUNTED = 100, 10_000


def heavy_keys(rows: DataFrame, keys: Sequence[str], top: int = HEAVY) -> list[int]:
    """Hashes of the ``top`` most frequent keys, from a sketch of bounded size that tasks fill and merge.

    Which keys it names decides where rows are joined, never what comes out.
    """
    found = rows.select(F.xxhash64(*keys).alias("_h")).agg(F.expr(f"approx_top_k(_h, {int(top)}, {COUNTED})").alias("_top")).first()
    return [item["item"] for item in found["_top"] or []]


def join_apart(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row per key (null being a key).

    Rows of the heavy keys stay where they are: the few rows of the table that
    they need are broadcast. Only rows of the other keys, none of which is
    frequent, are shuffled.
    """
    heavy = heavy_keys(rows, keys)
    named = F.xxhash64(*keys).isin(heavy) if heavy else F.lit(False)
    right = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    few = table.where(named).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    # At most one row per heavy key, whatever the table's size.
    common = rows.where(named).join(F.broadcast(few), same, "left")
    return common.unionByName(rows.where(~named).join(right, same, "left")).drop(*(f"_k_{k}" for k in keys))
