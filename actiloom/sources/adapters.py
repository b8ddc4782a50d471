"""Source adapters: where an agent's files are and how its lines become rows.

An adapter gives a glob, names the source a file belongs to, and routes lines
to messages and events. New formats are added by writing one more adapter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs, shape1, shape2, tail
from . import lines as L


@dataclass(frozen=True)
class Adapter:
    root: str
    agent: str
    name: str
    pattern: str
    max_backfill_bytes: int | None = None
    # Which chat records of an earlier batch make a later copy redundant.
    grow_only: bool = False
    # Whether a header line names the session of the lines behind it.
    has_headers = False

    def glob(self) -> str:
        return f"{self.root.rstrip('/')}/{self.pattern}"

    def source_name(self, file: Column) -> Column:
        raise NotImplementedError

    def accepts(self, file: Column) -> Column:
        return F.lit(True)

    def locator(self, file: Column) -> Column:
        """Folder of the source a file belongs to."""
        return F.regexp_replace(file, "/[^/]*$", "")

    def route(self, lines: DataFrame, headers=None, seen=None):
        """(messages, events, headers to remember or None)."""
        raise NotImplementedError


def part_from_end(file: Column, n: int) -> Column:
    return F.try_element_at(F.split(file, "/"), F.lit(-n))


class BlockTranscripts(Adapter):
    """``<root>/<project>/<session>.jsonl`` in shape 1."""

    def __init__(self, root: str, agent: str, name: str = "block_transcripts"):
        super().__init__(root, agent, name, "*/*.jsonl")

    def source_name(self, file):
        return part_from_end(file, 2)

    def route(self, lines, headers=None, seen=None, hold=lambda df: df):
        return shape1.route(lines)


class ChatTranscripts(Adapter):
    """``<root>/tmp/<project>/chats/*.jsonl`` in shape 2.

    ``max_backfill_bytes`` skips all but the end of a file met for the first
    time; without it every file is read from its start.
    """

    has_headers = True

    def __init__(
        self,
        root: str,
        agent: str,
        name: str = "chat_transcripts",
        max_backfill_bytes: int | None = None,
        grow_only: bool = False,
    ):
        super().__init__(root, agent, name, "tmp/*/chats/*.jsonl", max_backfill_bytes, grow_only)

    def source_name(self, file):
        return part_from_end(file, 3)

    def accepts(self, file):
        return self.source_name(file) != "background-processes"

    def locator(self, file):
        return F.regexp_replace(file, "/[^/]*/[^/]*$", "")

    def route(self, lines, headers=None, seen=None, hold=lambda df: df):
        return shape2.route(lines, headers, seen, hold)


class AppLogs(Adapter):
    """``<root>/*.log``, active generations only; every file is a source."""

    def __init__(self, root: str, agent: str, name: str = "app_logs"):
        super().__init__(root, agent, name, "*.log")

    def source_name(self, file):
        return part_from_end(file, 1)

    def accepts(self, file):
        return logs.is_source(self.source_name(file))

    def locator(self, file):
        return file

    def route(self, lines, headers=None, seen=None, hold=lambda df: df):
        return logs.route(lines, self.agent)


def list_files(spark: SparkSession, adapter: Adapter) -> DataFrame:
    """Files of an adapter with their size; nothing is opened. No root, no rows."""
    found = tail.read_file_list(spark, adapter.glob())
    return found.where(adapter.accepts(F.col("file"))).orderBy("file")


def discover(spark: SparkSession, adapter: Adapter) -> DataFrame:
    """Sources (name, locator) of an adapter, by name."""
    file = F.col("file")
    return (
        list_files(spark, adapter)
        .select(adapter.source_name(file).alias("name"), adapter.locator(file).alias("locator"))
        .distinct()
        .orderBy("name")
    )


def announcements(files: DataFrame) -> DataFrame:
    """One event per file whose older part was skipped at first contact."""
    skipped = files.where("skipped is not null")
    body = L.payload(file=F.col("file"), skipped_bytes=F.col("skipped"))
    return skipped.select(
        "file",
        "offset",
        F.lit(None).cast("string").alias("session_key"),
        F.inline(F.array(L.event("backfill_capped", body, "source"))),
    )


def capped_lines(lines: DataFrame, cap: int, chunk: int = L.CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Batch form of the cap on whole files: (kept lines, skipped bytes per file).

    A line is kept when it and everything after it fit into ``cap`` bytes.
    The position of a line already says how many bytes come before it, so the
    file's length is all that has to be aggregated.
    """
    size = lines.groupBy("file").agg(F.max("next").alias("_size"))
    start = F.greatest(F.col("_size") - F.lit(cap), F.lit(0))
    judged = lines.join(size, "file").withColumn("_keep", (start == 0) | (F.col("offset") > start))
    kept = judged.where("_keep").select(*lines.columns)
    skipped = (
        judged.where("not _keep").groupBy("file").agg(F.max("next").alias("skipped_bytes"))
    )
    return kept, skipped
