"""Running values: any chunk size, hot chains, ties and null keys give one result."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from actiloom.operators import ordered, skew, versioned


@contextmanager
def settings(spark, partitions):
    """So many shuffle partitions, none of them coalesced."""
    now = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def chains(seed=3):
    rng = random.Random(seed)
    keys = ["hot"] * 60 + ["warm"] * 15 + [None] * 20 + list("abcde")
    rows = [
        (k, rng.randrange(12), i, rng.choice([None, rng.randrange(9)])) for i, k in enumerate(keys)
    ]
    rng.shuffle(rows)
    return rows


def expected(rows):
    out, state = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        n, total, last, before = state.get(k, (0, None, None, None))
        total = total if v is None else (total or 0) + v
        out[i] = (n + 1, total, last if v is None else v, before)
        state[k] = (*out[i][:3], i)
    return out


def columns():
    return {
        "n": ordered.count_rows(),
        "total": ordered.sum_of(F.col("v")),
        "last": ordered.last_of(F.col("v")),
        "before": ordered.previous_of(F.col("i")),
    }


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
@pytest.mark.parametrize("parts", [1, 5])
def test_hot_chains(spark, ranges, parts):
    """Whatever the ranges, chains that they cut run on."""
    rows = chains()
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(parts)
    with settings(spark, ranges):
        found = ordered.with_running(df, ["k"], ["t", "i"], columns())
        assert {r.i: (r.n, r.total, r["last"], r.before) for r in found.collect()} == expected(rows)


def test_the_value_before_may_be_null(spark):
    rows = [("a", i, None if i % 3 else i) for i in range(40)] + [("b", 0, None), ("b", 1, 5), (None, 0, 1), (None, 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    before = {(k, t): v for k, t, v in rows}
    with settings(spark, 8):
        found = ordered.with_running(df, ["k"], ["t"], {"before": ordered.previous_of(F.col("v"))}).collect()
    assert len(found) == len(rows)
    assert all(r.before == before.get((r.k, r.t - 1)) for r in found)


@pytest.mark.parametrize("width", [1, 4, 100])
def test_buckets(spark, width):
    rows = chains(5)
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    found = ordered.with_running_in_buckets(
        df, ["k"], ["t", "i"], F.expr(f"t div {width}"), columns()
    )
    assert {r.i: (r.n, r.total, r["last"], r.before) for r in found.collect()} == expected(rows)


def test_ranges_stay_even_under_a_hot_chain(spark):
    """A third of a million rows in one chain: no range and no task of the window holds much more than another."""
    df = spark.range(1_000_000).select(
        F.expr("if(id % 3 = 0, -1, id % 1000)").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v")
    )
    with settings(spark, 12):
        parts = ordered.in_ranges(df, ["k"], ["t"]).groupBy("_part").count().collect()
        counts = sorted(r["count"] for r in parts)
        assert len(counts) == 12 and counts[-1] < 2 * counts[len(counts) // 2]
        found = ordered.with_running(df, ["k"], ["t"], {"n": ordered.count_rows(), "s": ordered.sum_of(F.col("v"))})
        assert found.where("n <> s or (k = -1 and n <> t div 3 + 1)").isEmpty()
        tasks = sorted(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(tasks) > 8 and tasks[-1] < 3 * tasks[len(tasks) // 2]


def test_the_window_runs_on_the_ranges(spark):
    """Behind the written ranges one exchange deals out the parts; the window and the join add none."""
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"))
    found = ordered.with_running(df, ["k"], ["t"], {"n": ordered.count_rows()})
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 0


def test_current_state_ignores_row_order(spark):
    rows = [("a", "x", f"{i:02d}", i // 3) for i in range(30)] + [("b", "x", "00", 1)]
    want = {("a", "29"), ("b", "00")}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "target string, type string, id string, valid_from int")
        found = versioned.current_state(df.repartition(seed + 1)).collect()
        assert {(r.target, r.id) for r in found} == want


def test_newest_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, t int")
    found = ordered.newest_per_key(df, ["k"], ["t"], 2).collect()
    assert sorted((r.k, r.t) for r in found) == [("a", 7), ("a", 8), ("b", 1)]


def test_rows_of_heavy_keys_stay_where_they_are(spark):
    """A third of the rows under one key, another third under none: the join answers all and moves only the rest."""
    rows = spark.range(30_000).select(
        F.expr("case id % 3 when 0 then 'hot' when 1 then null else concat('k', id % 997) end").alias("k"),
        F.col("id"), F.lit("wide").alias("body"),
    )
    table = rows.select("k").distinct().withColumn("answer", F.concat(F.lit("a-"), F.coalesce("k", F.lit("none"))))
    heavy = skew.heavy_keys(rows, ["k"], 2)
    assert len(heavy) == 2
    with settings(spark, 12):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            found = skew.join_apart(rows, table, ["k"])
            assert found.columns == ["k", "id", "body", "answer"] and found.count() == 30_000
            assert found.where("answer <> concat('a-', coalesce(k, 'none')) or answer is null").isEmpty()
            parts = found.where("id % 3 = 2").groupBy(F.spark_partition_id().alias("p")).count().collect()
            sizes = sorted(r["count"] for r in parts)
            assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert skew.join_apart(rows.limit(0), table, ["k"]).count() == 0
