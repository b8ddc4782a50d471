"""Table schemas and fixed vocabularies of the activity data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TYPE_DEFINITION = _table(
    uid=_S, category=_S, is_acyclic=_B, sch_json=_S, memory_tier=_S, valid_from=_TS
)
CURSOR_TYPE = _table(uid=_S, category=_S, description=_S, sch_json=_S, valid_from=_TS)
ENTITY = _table(id=_S, type=_S, valid_from=_TS)
RELATION = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("in", _S),
        T.StructField("out", _S),
        T.StructField("type", _S),
        T.StructField("is_acyclic", _B),
        T.StructField("valid_from", _TS),
    ]
)
STATE_LEDGER = _table(id=_S, target=_S, type=_S, payload=_S, valid_from=_TS)
CURSOR = _table(
    id=_S,
    subject=_S,
    cursor_type=_S,
    last_processed=_S,
    metadata=T.MapType(_S, _L),
    valid_from=_TS,
)
TELEMETRY = _table(id=_S, lifecycle_event=_S, payload=_S, subject=_S, agent=_S, valid_from=_TS)
MESSAGE = _table(
    id=_S,
    session=_S,
    agent=_S,
    role=_S,
    content=_S,
    raw=_S,
    seq=_L,
    emitted_at=_TS,
    valid_from=_TS,
)
MODULE = _table(id=_S, uid=_S, entity=_S, kind=_S, version=_S, provisioned=_B, valid_from=_TS)
ENTITY_TYPE = _table(name=_S, category=_S, description=_S, valid_from=_TS)
ANCHOR = _table(id=_S, entity_type=_S, created_at=_TS)
ENTITY_STATE = _table(id=_S, entity=_S, name=_S, content=_S, attributes=_S, valid_from=_TS)
EDGE = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("in", _S),
        T.StructField("out", _S),
        T.StructField("edge_uid", _S),
        T.StructField("rel_type", _S),
        T.StructField("active", _B),
        T.StructField("valid_from", _TS),
    ]
)
SCHEDULE = _table(
    id=_S, uid=_S, entity=_S, run_at=_TS, recurrence=_S, status=_S, valid_from=_TS
)
RUN = _table(
    id=_S,
    uid=_S,
    schedule=_S,
    firing=_S,
    task=_S,
    status=_S,
    instruct_version=_TS,
    output_ref=_S,
    detail=_S,
    valid_from=_TS,
)

TABLES = {
    "type_definition": TYPE_DEFINITION,
    "cursor_type": CURSOR_TYPE,
    "entity": ENTITY,
    "relation": RELATION,
    "state_ledger": STATE_LEDGER,
    "cursor": CURSOR,
    "telemetry_stream": TELEMETRY,
    "message": MESSAGE,
    "module": MODULE,
    "entity_type": ENTITY_TYPE,
    "anchor": ANCHOR,
    "entity_state": ENTITY_STATE,
    "edge": EDGE,
    "schedule": SCHEDULE,
    "run": RUN,
}

# ---------------------------------------------------------------------------
# Results are only right when these equal the established ones.
# ---------------------------------------------------------------------------

# Enumerations.
TYPE_CATEGORIES = ["node", "edge", "attribute"]
MEMORY_TIERS = ["core", "working", "archival", "recall"]
CURSOR_CATEGORIES = ["workload", "telemetry"]
MODULE_KINDS = ["kernel_module", "adapter"]
GRAPH_CATEGORIES = ["entity", "relation"]
SCHEDULE_STATUSES = ["scheduled", "fired", "cancelled"]
RUN_STATUSES = ["dispatched", "done", "failed", "cancelled"]
MODULE_INTENTS = ["enabled", "disabled"]
VOCABULARIES = {
    "type_definition": {"category": TYPE_CATEGORIES, "memory_tier": MEMORY_TIERS},
    "cursor_type": {"category": CURSOR_CATEGORIES},
    "module": {"kind": MODULE_KINDS},
    "entity_type": {"category": GRAPH_CATEGORIES},
    "schedule": {"status": SCHEDULE_STATUSES},
    "run": {"status": RUN_STATUSES},
}
LIFECYCLE_TAGS = ["enabled", "starting", "active", "failed", "skipped", "disabled"]

# Kernel types: uid, category, memory tier.
KERNEL_TYPES = [
    ("node_agent", "node", "core"),
    ("node_source", "node", "core"),
    ("node_session", "node", "core"),
    ("node_kernel_module", "node", "core"),
    ("node_adapter", "node", "core"),
    ("attr_module_descriptor", "attribute", "working"),
    ("attr_module_status", "attribute", "working"),
    ("attr_lifecycle_state", "attribute", "working"),
    ("attr_agent_descriptor", "attribute", "working"),
    ("attr_source_descriptor", "attribute", "working"),
    ("attr_session_descriptor", "attribute", "working"),
]

# Graph types: name, category.
GRAPH_TYPES = [
    ("product", "entity"),
    ("task", "entity"),
    ("rag", "entity"),
    ("model", "entity"),
    ("document", "entity"),
    ("repo", "entity"),
    ("credential", "entity"),
    ("text", "entity"),
    ("contains", "relation"),
    ("linked", "relation"),
    ("attached", "relation"),
    ("consults", "relation"),
    ("describes", "relation"),
    ("comments", "relation"),
    ("instructs", "relation"),
    ("authenticates", "relation"),
    ("depends_on", "relation"),
    ("produced", "relation"),
]

# Relations that hang text on a node, and the preference among parents.
TEXT_ROLES = ["describes", "comments", "instructs"]
PARENT_PRIORITY = ["contains", "attached", "describes", "instructs", "comments", "produced"]

# Tools whose input counts as written lines.
WRITE_TOOLS = ["Write", "Edit", "MultiEdit", "NotebookEdit"]

# Input fields that can hint at what a tool call does, best first.
HINT_FIELDS = ["description", "command", "file_path", "prompt", "pattern", "query"]

# Payload fields a keyword search looks at.
SEARCHED_FIELDS = [
    "tool", "name", "file", "line", "session", "error", "source", "kind",
    "url", "detail", "snippet", "adapter", "reason", "status",
]

# A folded log record is kept when it contains one of these.
LOG_SIGNALS = [
    "[MCP]",
    "[Chrome Extension MCP]",
    "[Claude in Chrome]",
    "[CCD]",
    "MCP Server connection",
    "Starting app",
    "beforeQuit",
    "willQuit",
    "onQuitCleanup",
    "account active and logged in",
    "No persisted sessions",
    "[error]",
]

# File extension to MIME type.
MIME_TYPES = {
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "log": "text/plain",
    "json": "application/json",
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "html": "text/html",
    "htm": "text/html",
    "csv": "text/csv",
    "rs": "text/x-rust",
    "surql": "application/sql",
    "sql": "application/sql",
}
OTHER_MIME = "application/octet-stream"

# Sizes and defaults.
SNIPPET_CHARS = 500
INLINE_DATA_MAX = 256
BACKFILL_MAX_BYTES = 8_388_608
STATS_WINDOW = 500
EVENT_WINDOW = 2000
STARTUP_SCAN = 400
ACTIVE_SECONDS = 300
RECENT_SECONDS = 3600
CONTEXT_WINDOW = 1_000_000
FEED_DEFAULT, FEED_MAX = 500, 2000
TRANSCRIPT_LIMIT = 10_000
LIVE_CAP = 500
HISTORY_PAGE = 300
ANCESTOR_DEPTH = 12
GRAPH_DEPTH_CEILING = 5
PLAN_DEPTH = 20
PARALLEL_RUNS = 2
