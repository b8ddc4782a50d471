"""Running values along ordered chains, balanced however long a chain is.

A plain ``OVER (PARTITION BY chain ORDER BY ...)`` sends a whole chain to one
task. Here it is a segmented scan in two levels. Rows are sorted by ranges of
(chain, order) and written, so a part holds about as many rows as any other,
be they of one chain or of many. Each part runs its own window; of the chains
that a part boundary cuts, each part adds up one total; totals are combined
along the parts and joined back. Only the first chain of a part can have begun
earlier, so at most one row per part is joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_PART = "_part"


@dataclass(frozen=True)
class Running:
    """One running value: a count of rows, a sum, the last non-null value, or the
    value of the row before."""

    kind: str
    value: Column | None = None


def count_rows() -> Running:
    return Running("count")


def sum_of(value: Column) -> Running:
    return Running("sum", value)


def last_of(value: Column) -> Running:
    return Running("last", value)


def previous_of(value: Column) -> Running:
    """The value of the row before, null for the first row of a chain."""
    return Running("previous", value)


def _over(spec: Running, window) -> Column:
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    if spec.kind == "count":
        return F.row_number().over(so_far).cast("bigint")
    if spec.kind == "sum":
        return F.sum(spec.value).over(so_far)
    if spec.kind == "previous":
        return F.struct(F.lag(spec.value).over(window).alias("value"), (F.row_number().over(window) == 1).alias("first"))
    return F.last(spec.value, ignorenulls=True).over(so_far)


def _total(spec: Running, order: Sequence[str]) -> Column:
    """What a part of a chain adds to those behind it."""
    if spec.kind == "count":
        return F.count(F.lit(1))
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "previous":
        return F.max_by(spec.value, F.struct(*order))
    return F.max_by(spec.value, F.when(spec.value.isNotNull(), F.struct(*order)))


def _carried(spec: Running, total: Column, chain) -> Column:
    """The totals of all earlier parts of a chain combined; ``chain`` orders its parts."""
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "previous":
        return F.lag(total).over(chain)
    return (F.last(total, ignorenulls=True) if spec.kind == "last" else F.sum(total)).over(earlier)


def _combine(spec: Running, before: Column, local: Column) -> Column:
    if spec.kind == "count":
        return local + F.coalesce(before, F.lit(0))
    if spec.kind == "sum":
        return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(before + local)
    if spec.kind == "previous":
        return F.when(local["first"], before).otherwise(local["value"])
    return F.coalesce(local, before)


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by ranges of (keys, order) and written, with the number ``_part`` of each row's range."""
    by = [*keys, *(c for c in order if c not in keys)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(rows.withColumn(_PART, F.spark_partition_id()), "ranges")


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, Running]
) -> DataFrame:
    """Add running values per ``keys`` in ascending ``order`` (current row included)."""
    rows = in_ranges(df, keys, order)
    key = F.struct(*keys)
    # One row per part: its first and its last chain, all that a boundary can cut.
    ends = rows.groupBy(_PART).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    cut = rows.join(F.broadcast(ends), _PART).where(key.eqNullSafe(F.col("_low")) | key.eqNullSafe(F.col("_high")))
    # The parts are the ranges already; dealing them out by number is all the window needs.
    return _scan(rows.repartitionByRange(_PART), cut, keys, order, columns)


def with_running_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    columns: Mapping[str, Running],
) -> DataFrame:
    """Same, with the parts given by a rising expression of the order.

    For lines of a file the byte offset divided by a block size is such a
    bucket: it bounds a task without looking at the data first.
    """
    rows = df.withColumn(_PART, bucket)
    return _scan(rows, rows, keys, order, columns)


def _scan(
    rows: DataFrame,
    totals_from: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, Running],
) -> DataFrame:
    on = [*keys, _PART]
    window = Window.partitionBy(*on).orderBy(*order)
    local = rows.withColumns({f"_l_{n}": _over(s, window) for n, s in columns.items()})
    totals = totals_from.groupBy(*on).agg(*[_total(s, order).alias(f"_t_{n}") for n, s in columns.items()])
    # One row per part of a chain, so this window is small even for a hot one.
    chain = Window.partitionBy(*keys).orderBy(_PART)
    carry = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in on],
        (F.row_number().over(chain) > 1).alias("_begun"),
        *[_carried(s, F.col(f"_t_{n}"), chain).alias(f"_c_{n}") for n, s in columns.items()],
    )
    carry = written(carry.where("_begun").drop("_begun"), "carry")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on])
    joined = local.join(carry, same, "left")
    return joined.select(
        *[F.col(c) for c in rows.columns if c != _PART],
        *[_combine(s, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, s in columns.items()],
    )


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int
) -> DataFrame:
    """The newest ``count`` rows per key.

    Spark limits each key inside every map task before the shuffle
    (WindowGroupLimit), so a hot key ships at most ``count`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where(f"_rank <= {int(count)}").drop(
        "_rank"
    )
