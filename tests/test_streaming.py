"""Streams over the append tables, retries and recurrence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from actiloom.operators import versioned as V
from actiloom.sources.store import Store
from actiloom.streaming import live, stateful

T0 = dt.datetime(2026, 1, 1, 10, 0, 0)


def event(i, second, agent="a"):
    return (f"e{i}", "x", "{}", None, agent, T0 + dt.timedelta(seconds=second))


def add(spark, store, table, rows, batch):
    store.append(table, spark.createDataFrame(rows, store.schema(table)), batch)


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_store_replaces_a_retried_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("telemetry_stream").count() == 0
    add(spark, store, "telemetry_stream", [event(1, 0), event(2, 1)], "b-0")
    add(spark, store, "telemetry_stream", [event(1, 0), event(2, 1)], "b-0")
    add(spark, store, "telemetry_stream", [event(3, 100_000)], "b-1")
    assert store.read("telemetry_stream").count() == 3
    assert store.read("telemetry_stream", without_batch="b-1").count() == 2
    late = store.since("telemetry_stream", T0 + dt.timedelta(days=1))
    assert [r.id for r in late.collect()] == ["e3"]
    scan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan


def test_tumbling_windows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    seconds = [0, 10, 70, 3600, 3601]
    add(spark, store, "telemetry_stream", [event(i, s) for i, s in enumerate(seconds)], "b-0")
    found = drain(live.windowed_counts(store.stream("telemetry_stream"), watermark="1 minute"), "windows")
    closed = {r.start: r.value for r in found.collect()}
    assert closed[T0] == 2 and closed[T0 + dt.timedelta(minutes=1)] == 1
    whole = drain(live.windowed_counts(store.stream("telemetry_stream")), "windows_all", "complete")
    assert sorted(r.value for r in whole.collect()) == [1, 2, 2]


def test_live_tails_and_feed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("message")
    add(spark, store, "telemetry_stream", [event(1, 0), event(2, 1, "b")], "b-0")
    add(spark, store, "message", [("m1", "s", "a", "user", "hi", None, None, None, T0)], "b-0")
    events, messages = store.stream("telemetry_stream"), store.stream("message")
    assert drain(live.event_tail(events, "b"), "tail").count() == 1
    assert drain(live.conversation_tail(messages, "s"), "talk").count() == 1
    feed = drain(live.merged_feed(messages, events), "merged")
    assert sorted(r.id for r in feed.collect()) == ["e1", "e2", "m1"]


def test_recurrence(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    row = lambda i, uid, rec, status, s: (f"{uid}{i}", uid, "x", T0, rec, status, T0 + dt.timedelta(seconds=s))
    add(spark, store, "schedule", [
        row(1, "every", "every:2s", "scheduled", 0), row(2, "every", "every:2s", "fired", 1),
        row(1, "none", "none", "fired", 0),
        row(1, "stop", "every:2s", "fired", 0), row(2, "stop", "every:2s", "cancelled", 1),
        row(1, "bad", "every:5x", "fired", 0)], "b-0")
    now = T0 + dt.timedelta(seconds=30)
    for _ in range(2):
        live.follow_recurrence(store, str(tmp_path / "cp"), lambda: now).awaitTermination()
    chain = store.read("schedule").where("uid = 'every'").orderBy("valid_from").collect()
    assert [r.status for r in chain] == ["scheduled", "fired", "scheduled"]
    assert chain[-1].run_at == now + dt.timedelta(seconds=2)
    current = {r.uid: r.status for r in V.current_schedules(store.read("schedule")).collect()}
    assert current == {"every": "scheduled", "none": "fired", "stop": "cancelled", "bad": "fired"}


def test_feed_survives_a_rewritten_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("message")
    add(spark, store, "telemetry_stream", [event(1, 0)], "b-0")
    feed = live.merged_feed(store.stream("message"), store.stream("telemetry_stream"))
    seen = []

    def run():
        query = (
            feed.writeStream.foreachBatch(lambda df, n: seen.extend(r.id for r in df.select("id").collect()))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    add(spark, store, "telemetry_stream", [event(1, 0)], "b-0")
    add(spark, store, "telemetry_stream", [event(2, 1)], "b-1")
    run()
    assert sorted(seen) == ["e1", "e2"]


def follow(df, path, seen):
    query = (
        df.writeStream.foreachBatch(lambda rows, n: seen.extend(r.id for r in rows.select("id").collect()))
        .option("checkpointLocation", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_tails_repeat_no_batch_and_take_rows_in_time(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path / "t")), []
    store.create("telemetry_stream")
    tail = live.event_tail(store.stream("telemetry_stream"), "a", "1 minute")
    add(spark, store, "telemetry_stream", [event(1, 0), event(2, 300)], "b-0")
    follow(tail, str(tmp_path / "cp"), seen)
    # The first batch again, one row a little late and one far too late.
    add(spark, store, "telemetry_stream", [event(1, 0), event(2, 300)], "b-0")
    add(spark, store, "telemetry_stream", [event(3, 290), event(4, 1), event(5, 400), event(6, 400, "b")], "b-1")
    follow(tail, str(tmp_path / "cp"), seen)
    assert sorted(seen) == ["e1", "e2", "e3", "e5"]


def test_feed_refuses_a_watermark_that_loses_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for table in ("message", "telemetry_stream"):
        store.create(table)
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        with pytest.raises(ValueError, match="multipleWatermarkPolicy"):
            live.merged_feed(store.stream("message"), store.stream("telemetry_stream"))
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


def test_grown_records_across_batches(spark, tmp_path):
    schema = "file string, offset long, record_id string, text string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    batches = [
        [("f", 1, "x", "ab"), ("f", 2, "x", "a"), ("f", 3, None, "n"), ("g", 1, "x", None)],
        [("f", 4, "x", "ab"), ("f", 5, "y", "y"), ("g", 2, "x", "z")],
        [("f", 6, "x", "abcd"), ("f", 7, "x", "abc"), ("f", 8, None, "n"), ("g", 3, "x", "z")],
    ]
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / f"batch={n}"))
        query = (
            stateful.grown_records(stream).writeStream.foreachBatch(lambda df, _: seen.extend((r.file, r.offset) for r in df.collect()))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    # The last line of a batch goes on, if it is longer than all that came in earlier batches.
    assert sorted(seen) == [("f", 2), ("f", 3), ("f", 5), ("f", 7), ("f", 8), ("g", 1), ("g", 2)]


def test_no_private_checkpoints(spark):
    """Lineage is cut in the shared folder the session names."""
    from actiloom.session import materialize, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
