"""Transcripts and logs to rows: counts, resume, rotation, caps, splits."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from actiloom.sources import adapters, capture, lines, logs, shape2, tail
from actiloom.sources.store import Store
from actiloom.streaming.capture import run_once

TALK = "night-7"
SHAPE1 = [
    {"type": "summary", "leafUuid": "z"},
    {"type": "assistant", "sessionId": TALK, "timestamp": "2025-11-02T03:04:05.25Z", "message": {"content": [
        {"type": "tool_use", "name": "Grep", "id": "call-9", "input": {"pattern": "moss"}},
        {"type": "text", "text": "looking for moss"}, {"type": "text", "text": "in both beds"}]}},
    {"type": "user", "sessionId": TALK, "message": {"content": [
        {"type": "tool_result", "tool_use_id": "call-9", "content": "bed 4"}]}},
    {"type": "user", "sessionId": TALK, "origin": {"kind": "human"}, "message": {"content": "then water bed 4"}},
    {"type": "assistant", "sessionId": TALK, "message": {"content": [{"type": "text", "text": "watered"}]}},
]
HEADER = {"kind": "main", "sessionId": "plot-3", "startTime": "t0", "projectHash": "ph"}
NOTICE = {"type": "warning", "id": "w-4", "content": "sensor 9 is old"}
ASK = {"type": "user", "id": "q-7", "content": [{"text": "which rows"}, {"text": "are dry"}, {"text": "today"}]}
SHORT = {"type": "gemini", "id": "r-2", "content": "rows"}
LONG = {"type": "gemini", "id": "r-2", "content": "rows 2 and 9 are dry", "model": "q", "tokens": {"output": 11}, "toolCalls": [
    {"name": "probe", "id": "k-1", "status": "error", "resultDisplay": ["long"]}, {"name": "probe", "id": "k-2", "status": "success"}]}
SHAPE2 = [HEADER, NOTICE, ASK, SHORT, {"$set": {"lastUpdated": "t1"}}, LONG]
ASKED = "which rows\nare dry\ntoday"


def write(path, rows, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as out:
        for row in rows:
            out.write((row if isinstance(row, str) else json.dumps(row)) + "\n")


def kinds(store):
    rows = store.read("telemetry_stream").groupBy("lifecycle_event").count().collect()
    return {r[0]: r[1] for r in rows}


@pytest.fixture
def project(tmp_path):
    file = tmp_path / "projects" / "garden" / f"{TALK}.jsonl"
    write(file, [*SHAPE1, "[broken, line"])
    return tmp_path, file


def test_shape1_rows_resume_and_append(spark, project):
    root, file = project
    store = Store(spark, str(root / "store"))
    source = adapters.BlockTranscripts(str(root / "projects"), "agent_b")
    assert run_once([source], store, str(root / "cp")) == {}
    messages = store.read("message").orderBy("id").collect()
    assert [(m.role, m.content) for m in messages] == [
        ("assistant", "looking for moss\nin both beds"), ("tool", "bed 4"), ("user", "then water bed 4"), ("assistant", "watered")]
    assert messages[0].emitted_at.isoformat() == "2025-11-02T03:04:05.250000"
    assert messages[3].emitted_at is None
    assert kinds(store) == {
        "message_captured": 4, "transcript_event": 1, "transcript_raw": 1,
        "agent_discovered": 1, "source_discovered": 1, "session_discovered": 1,
    }
    names = {r.name for r in capture.current_names(store.read("state_ledger")).collect()}
    assert names == {"agent_b", "agent_b/garden", f"agent_b/{TALK}"}
    # Nothing new: nothing written. A partial line waits for its newline.
    with file.open("a") as out:
        out.write('{"type":"user","message":{"content":"part')
    run_once([source], store, str(root / "cp"))
    assert store.read("message").count() == 4
    with file.open("a") as out:
        out.write('ial"}}\n')
    run_once([source], store, str(root / "cp"))
    assert store.read("message").where("content = 'partial'").count() == 1
    found = kinds(store)
    assert found["message_captured"] == 5
    assert found["session_discovered"] == 1
    offsets = capture.latest_offsets(store.read("cursor")).collect()
    assert [o.offset for o in offsets] == [file.stat().st_size]
    report = {r.name: r.captured for r in capture.report(
        store.read("telemetry_stream"), store.read("state_ledger")).collect()}
    assert report[f"agent_b/{TALK}"] == 6


def test_shape2_rows(spark, tmp_path):
    file = tmp_path / "tmp" / "proj" / "chats" / "session-1.jsonl"
    write(file, SHAPE2)
    write(tmp_path / "tmp" / "background-processes" / "chats" / "x.jsonl", SHAPE2)
    store = Store(spark, str(tmp_path / "store"))
    source = adapters.ChatTranscripts(str(tmp_path), "agent_g")
    assert run_once([source], store, str(tmp_path / "cp")) == {}
    messages = store.read("message").orderBy("id").collect()
    assert [(m.role, m.content) for m in messages] == [
        ("user", ASKED), ("assistant", LONG["content"])]
    assert "resultDisplay" not in messages[1].raw
    kept = [{k: v for k, v in call.items() if k != "resultDisplay"} for call in LONG["toolCalls"]]
    assert json.loads(messages[1].raw)["toolCalls"] == kept
    found = kinds(store)
    assert found["tool_call"] == 2 and found["transcript_event"] == 1
    names = {r.name for r in capture.current_names(store.read("state_ledger")).collect()}
    assert "agent_g/plot-3" in names
    # The header of the first batch still names the session of later lines.
    write(file, [{"id": "q-8", "type": "user", "content": "and now"}], "a")
    run_once([source], store, str(tmp_path / "cp"))
    sessions = store.read("message").select("session").distinct().count()
    assert store.read("message").count() == 3 and sessions == 1


def test_grow_only_keeps_longer_copies(spark, tmp_path):
    file = tmp_path / "tmp" / "proj" / "chats" / "s.jsonl"
    write(file, [HEADER, ASK, SHORT])
    store = Store(spark, str(tmp_path / "store"))
    source = adapters.ChatTranscripts(str(tmp_path), "agent_g", grow_only=True)
    run_once([source], store, str(tmp_path / "cp"))
    write(file, [SHORT, ASK, LONG], "a")
    run_once([source], store, str(tmp_path / "cp"))
    contents = Counter(r.content for r in store.read("message").collect())
    assert contents == {ASKED: 1, SHORT["content"]: 1, LONG["content"]: 1}


def test_backfill_cap(spark, tmp_path):
    file = tmp_path / "tmp" / "proj" / "chats" / "s.jsonl"
    tail_line = {"id": "q-99", "type": "user", "content": [{"text": "the last question"}]}
    write(file, [*SHAPE2, tail_line])
    store = Store(spark, str(tmp_path / "store"))
    source = adapters.ChatTranscripts(str(tmp_path), "agent_g", max_backfill_bytes=100)
    run_once([source], store, str(tmp_path / "cp"))
    assert [m.content for m in store.read("message").collect()] == ["the last question"]
    event = store.read("telemetry_stream").where("lifecycle_event = 'backfill_capped'").collect()
    skipped = json.loads(event[0].payload)["skipped_bytes"]
    assert skipped == file.stat().st_size - len(json.dumps(tail_line)) - 1


def test_logs_fold_filter_rotate(spark, tmp_path):
    root = tmp_path / "logs"
    record = [
        "2026-08-07 10:00:00 [info] polling",
        "2026-08-07 10:00:01 [info] Starting app",
        "2026-08-07 10:00:02 [error] failed ENOENT",
        "    at autoUpdater",
        "    at next",
        "2026-08-07 10:00:03 [info] polling",
        "2026-08-07 10:00:04 [info] [MCP] up",
        "2026-08-07 10:00:05 [info] polling",
    ]
    write(root / "main.log", record)
    write(root / "main1.log", record)
    write(root / "unknown-window.log", record)
    store = Store(spark, str(tmp_path / "store"))
    source = adapters.AppLogs(str(root), "agent_l")
    run_once([source], store, str(tmp_path / "cp"))

    def found():
        return store.read("telemetry_stream").where("lifecycle_event = 'desktop_event'").collect()

    texts = [json.loads(r.payload) for r in found()]
    assert len(texts) == 3
    assert any("ENOENT" in t["line"] and "autoUpdater" in t["line"] for t in texts)
    assert {t["file"] for t in texts} == {"agent_l/main.log"}
    run_once([source], store, str(tmp_path / "cp"))
    assert len(found()) == 3
    write(root / "main.log", ["2026-08-08 09:00:00 [info] Starting app"])
    run_once([source], store, str(tmp_path / "cp"))
    assert len(found()) == 4
    write(root / "main.log", ["2026-08-08 09:00:01 willQuit"], "a")
    run_once([source], store, str(tmp_path / "cp"))
    assert len(found()) == 5
    assert [r.name for r in adapters.discover(spark, source).collect()] == ["main.log"]


def test_discovery_lists_without_reading(spark, project):
    root, _ = project
    (root / "projects" / "alpha").mkdir()
    write(root / "projects" / "alpha" / "a.jsonl", [])
    write(root / "projects" / "alpha" / "deep" / "b.jsonl", ["x"])
    source = adapters.BlockTranscripts(str(root / "projects"), "agent_b")
    assert [r.name for r in adapters.discover(spark, source).collect()] == ["alpha", "garden"]
    assert adapters.discover(spark, adapters.BlockTranscripts(str(root / "none"), "a")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_splits_deliver_each_line_once(spark, tmp_path, size):
    body = b"one\n\ntwo \xff bad\nthree\r\n" + b"x" * 50 + b"\nlast one\npartial"
    (tmp_path / "f.txt").write_bytes(body)
    rows = tail.read_lines(spark, str(tmp_path / "*.txt"), splitBytes=str(size)).orderBy("offset").collect()
    assert [r.line for r in rows] == ["one", "", "two � bad", "three\r", "x" * 50, "last one"]
    assert [r.offset for r in rows][1:] == [r.next for r in rows][:-1]


def test_small_ranges_share_tasks(tmp_path):
    lines = [b"%06d" % k for k in range(30_000)]
    (tmp_path / "f.txt").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "g.txt").write_bytes(b"g\n")
    reader = tail.LineReader({"path": str(tmp_path / "*.txt"), "splitBytes": "100"})
    tasks = reader.partitions()
    assert len(tasks) == 1 and len(tasks[0].parts) == 2101
    assert [r[2].encode() for r in tail.rows(tasks[0])] == [*lines, b"g"]
    full = tail.packed([tail.ByteRange("f", k, k + (1 << 20)) for k in range(0, 20 << 20, 1 << 20)])
    assert [len(t.parts) for t in full] == [7, 8, 5]


def test_ranges_read_about_their_own_bytes(tmp_path):
    class Counted:
        def __init__(self, file):
            self.file, self.bytes, self.seek = file, 0, file.seek

        def read(self, size):
            block = self.file.read(size)
            self.bytes += len(block)
            return block

    for body in (b"a line\n" * 30_000, b"x" * 300_000 + b"\ny\n"):
        (tmp_path / "f.txt").write_bytes(body)
        with open(tmp_path / "f.txt", "rb") as file:
            stream = Counted(file)
            parts = tail.split("f.txt", 0, len(body), 10_000)
            assert b"".join(line + b"\n" for p in parts for _, line in tail.complete_lines(stream, p)) == body
            assert stream.bytes < 5 * len(body)


@pytest.mark.parametrize("size", [3, 1000])
def test_cap_equals_batch_form(spark, tmp_path, size):
    text = "".join(f"line {i}\n" for i in range(40))
    path = tmp_path / "f.txt"
    path.write_text(text)
    every = tail.read_lines(spark, str(path))
    for cap in (1, 20, 57, len(text) - 1, len(text) + 5):
        reader = tail.LineStreamReader({"path": str(path), "maxBackfillBytes": cap, "splitBytes": size})
        rows = [r for p in reader.partitions({}, {str(path): len(text)}) for r in tail.rows(p)]
        kept, skipped = adapters.capped_lines(every, cap)
        assert sorted(r[2] for r in rows if r[2] is not None) == sorted(r.line for r in kept.collect())
        told = [r[4] for r in rows if r[4] is not None]
        batch = [r.skipped_bytes for r in skipped.collect()]
        assert told[-1:] == batch


def test_sanitize_keeps_everything_else(spark):
    data = "é" * 300
    record = {"id": "1", "other": {"a": [1, 2.5, None, True]}, "content": [
        {"text": "t", "inlineData": {"data": data, "mimeType": "m"}}, {"inlineData": {"data": "short"}}, "bare"],
        "toolCalls": [{"name": "n", "resultDisplay": {"x": 1}}, 7]}
    df = spark.createDataFrame([(json.dumps(record, ensure_ascii=False),)], "text string")
    out = json.loads(df.select(shape2.sanitize(F.col("text"))).first()[0])
    assert out["content"][0]["inlineData"]["data"] == "é" * 256 + "…[truncated 600 bytes]"
    assert out["content"][1:] == record["content"][1:]
    assert out["content"][0]["inlineData"]["mimeType"] == "m"
    assert out["toolCalls"] == [{"name": "n"}, 7]
    assert out["other"] == record["other"]


def test_folding_is_the_same_in_any_chunk_size(spark):
    text = ["lead", "2026-01-01 a", " b", "2026-01-02 c", " d", " e", "2026-01-03 f"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, offset bigint, line string")
    want = ["lead", "2026-01-01 a\n b", "2026-01-02 c\n d\n e", "2026-01-03 f"]
    for chunk in (1, 2, 3, 100):
        rows = logs.fold(logs.number_records(df, chunk=chunk)).orderBy("offset").collect()
        assert [r.text for r in rows] == want


def test_whole_line_json_only(spark):
    df = spark.createDataFrame([('{"a":1}}',), ('{"a":1} x',), ('{"a":1},{"b":2}',), ('{"a":1}',), ("5",), ("",), ('1],[2',)], "line string")
    rows = lines.parsed(df.withColumns({"file": F.lit("f"), "offset": F.lit(0)}))
    ok = [r.text for r in rows.where("json is not null").collect()]
    assert sorted(ok) == ["5", '{"a":1}']


def test_disabled_adapters_are_left_out(spark):
    sources = spark.createDataFrame([("p1", "one"), ("p2", "two"), ("p3", "three")], "name string, adapter string")
    modules = spark.createDataFrame([("one", "m1"), ("two", "m2")], "name string, id string")
    ledger = spark.sql("""select * from values
      ('1','m1','attr_module_status','{"status":"disabled"}', timestamp'2024-01-01'),
      ('2','m1','attr_module_status','{"status":"enabled"}', timestamp'2024-01-02'),
      ('3','m2','attr_module_status','{"status":"disabled"}', timestamp'2024-01-02')
      t(id, target, type, payload, valid_from)""")
    kept = capture.enabled_sources(sources, modules, ledger)
    assert sorted(r.name for r in kept.collect()) == ["p1", "p3"]


class Broken(adapters.BlockTranscripts):
    def route(self, lines, headers=None, seen=None, hold=None):
        raise ValueError("cannot route")


def test_one_failing_adapter_leaves_the_others(spark, project):
    root, _ = project
    store = Store(spark, str(root / "store"))
    good = adapters.BlockTranscripts(str(root / "projects"), "agent_b", "good")
    bad = Broken(str(root / "projects"), "agent_x", "bad")
    errors = run_once([bad, good], store, str(root / "cp"))
    assert list(errors) == ["bad"] and "cannot route" in errors["bad"]
    assert store.read("message").count() == 4
    assert kinds(store)["capture_error"] == 1
    # The failed lines are read again once the adapter works.
    mended = adapters.BlockTranscripts(str(root / "projects"), "agent_x", "bad")
    assert run_once([mended], store, str(root / "cp")) == {}
    assert store.read("message").count() == 8


def test_disabled_adapter_is_not_run(spark, project):
    import datetime as dt

    root, _ = project
    store = Store(spark, str(root / "store"))
    now = dt.datetime(2026, 1, 1)
    store.append("state_ledger", spark.createDataFrame([
        ("1", "mod", "attr_module_descriptor", '{"name":"block_transcripts"}', now),
        ("2", "mod", "attr_module_status", '{"status":"disabled"}', now),
    ], store.schema("state_ledger")), "setup")
    source = adapters.BlockTranscripts(str(root / "projects"), "agent_b")
    assert run_once([source], store, str(root / "cp")) == {}
    assert store.read("message").count() == 0


def test_a_known_agent_keeps_its_id(spark, project):
    import datetime as dt

    root, _ = project
    store = Store(spark, str(root / "store"))
    store.append("state_ledger", spark.createDataFrame([
        ("1", "known", "attr_agent_descriptor", '{"name":"agent_b"}', dt.datetime(2026, 1, 1)),
    ], store.schema("state_ledger")), "setup")
    run_once([adapters.BlockTranscripts(str(root / "projects"), "agent_b")], store, str(root / "cp"))
    for table in ("message", "telemetry_stream"):
        assert {r.agent for r in store.read(table).select("agent").distinct().collect()} == {"known"}


def test_a_name_given_away_does_not_resolve(spark):
    ledger = spark.sql("""select id, target, 'attr_source_descriptor' as type, to_json(named_struct('name', name)) as payload,
      timestamp'2024-01-01' + make_dt_interval(0, 0, 0, n) as valid_from from values
      ('1', 'old', 'x', 1), ('2', 'new', 'x', 2), ('3', 'new', 'y', 3), ('4', 'old', 'x', 0) t(id, target, name, n)""")
    assert {(r.name, r.id) for r in capture.current_names(ledger).collect()} == {("y", "new")}
