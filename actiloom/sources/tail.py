"""A Spark data source for growing line files: batch and streaming.

``spark.read.format("line_tail").option("path", glob).load()`` gives one row
per complete line: ``file``, ``offset`` (byte position of the line, which is
its order in the file), ``line`` and ``next`` (where the next line begins). As a stream it delivers what was appended
since the last batch. The stream offset is the length of every file.

A byte range delivers the lines whose newline lies inside it and looks back
for where the first of them begins. So a partial last line waits for its
newline, large files split anywhere, and nothing is read by the driver. Small
ranges and small files share a task.

Options
    path             glob; each part between slashes may hold wildcards
    splitBytes       largest byte range read at once (default 64 MiB)
    maxBackfillBytes cap on a file met for the first time (stream only); the
                     lines before it are skipped and a row with ``skipped``
                     (bytes) and no line announces that

A file shorter than its stored offset was replaced and is read from the start.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

NAME = "line_tail"
SCHEMA = "file string, offset bigint, line string, next bigint, skipped bigint"
_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("line", pa.string()),
        ("next", pa.int64()),
        ("skipped", pa.int64()),
    ]
)
SPLIT_BYTES = 64 * 1024 * 1024
#: Ranges up to this many bytes are read by one task, an opened file counting as some bytes.
TASK_BYTES, OPEN_BYTES = 8 * 1024 * 1024, 256 * 1024
_BLOCK, _LOOK_BACK = 1024 * 1024, 4096
_BATCH_ROWS, _BATCH_BYTES = 8192, 8 * 1024 * 1024


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int
    floor: int = 0
    last: bool = True


@dataclass
class Ranges(InputPartition):
    """What one task reads, range after range."""

    parts: list[ByteRange]


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_files(pattern: str) -> dict[str, int]:
    """Files matching a glob with their sizes. Folders are listed one level per
    pattern part; missing ones give nothing."""
    system, path = open_filesystem(pattern)
    scheme = pattern[: len(pattern) - len(path)]
    parts = [p for p in path.split("/") if p]
    folders = ["/" if path.startswith("/") else ""]
    for depth, part in enumerate(parts):
        final = depth == len(parts) - 1
        found: dict[str, int] = {}
        for folder in folders:
            if not final and not any(ch in part for ch in "*?["):
                found[f"{folder.rstrip('/')}/{part}" if folder else part] = 0
                continue
            selector = fs.FileSelector(folder or ".", allow_not_found=True)
            try:
                entries = system.get_file_info(selector)
            except NotADirectoryError:
                continue
            wanted = fs.FileType.File if final else fs.FileType.Directory
            for entry in entries:
                if entry.type == wanted and fnmatchcase(entry.base_name, part):
                    found[entry.path] = entry.size or 0
        if final:
            return {scheme + file: size for file, size in sorted(found.items())}
        folders = sorted(found)
    return {}


def split(file: str, begin: int, end: int, size: int, floor: int = 0) -> list[ByteRange]:
    cuts = list(range(begin, end, size))
    return [
        ByteRange(file, cut, min(cut + size, end), floor, cut + size >= end) for cut in cuts
    ]


def packed(parts: list[ByteRange]) -> list[Ranges]:
    """The ranges dealt to tasks: neighbours together, up to ``TASK_BYTES``."""
    tasks: list[Ranges] = []
    file, held = None, 0
    for part in parts:
        cost = part.end - part.begin + (0 if part.file == file else OPEN_BYTES)
        if not tasks or held + cost > TASK_BYTES:
            tasks.append(Ranges([]))
            held = 0
        tasks[-1].parts.append(part)
        file, held = part.file, held + cost
    return tasks


def line_start(stream, position: int) -> int:
    """Where the line holding the byte at ``position`` begins."""
    size = _LOOK_BACK
    while position > 0:
        begin = max(0, position - size)
        stream.seek(begin)
        found = stream.read(position - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        position, size = begin, min(2 * size, _BLOCK)
    return 0


def complete_lines(stream, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the lines whose newline lies in the range.

    A range without newline, inside a long line, does not look back.
    """
    stream.seek(part.begin)
    held: list[bytes] = []
    at, position = part.begin, None
    while at < part.end:
        block = stream.read(min(_BLOCK, part.end - at))
        if not block:
            return
        at += len(block)
        pieces = block.split(b"\n")
        if position is None and len(pieces) > 1:
            position = line_start(stream, part.begin)
            stream.seek(position)
            held.insert(0, stream.read(part.begin - position))
            stream.seek(at)
        for piece in pieces[:-1]:
            held.append(piece)
            line = b"".join(held)
            held = []
            yield position, line
            position += len(line) + 1
        held.append(pieces[-1])


def rows(task: Ranges) -> Iterator[tuple]:
    for part in task.parts:
        yield from _range_rows(part)


def _range_rows(part: ByteRange) -> Iterator[tuple]:
    system, path = open_filesystem(part.file)
    try:
        stream = system.open_input_file(path)
    except FileNotFoundError:
        return
    with stream:
        # Under a cap, the line the floor falls into is skipped as a whole.
        open_ended = part.last and part.floor > 0 and line_start(stream, part.begin) <= part.floor
        for position, line in complete_lines(stream, part):
            if part.floor > 0 and position <= part.floor:
                after = position + len(line) + 1
                yield part.file, position, None, after, after
                open_ended = False
                continue
            text = line.decode("utf-8", errors="replace")
            yield part.file, position, text, position + len(line) + 1, None
        if open_ended:
            yield part.file, part.end, None, part.end, part.end


def batches(task: Ranges) -> Iterator[pa.RecordBatch]:
    pending: list[tuple] = []
    size = 0
    for row in rows(task):
        pending.append(row)
        size += len(row[2] or "")
        if len(pending) >= _BATCH_ROWS or size >= _BATCH_BYTES:
            yield _record_batch(pending)
            pending, size = [], 0
    if pending:
        yield _record_batch(pending)


def _record_batch(pending: list[tuple]) -> pa.RecordBatch:
    columns = zip(*pending, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        found = list_files(self.path)
        return packed([r for f, n in found.items() for r in split(f, 0, n, self.size)])

    def read(self, partition):
        # Spark asks for one empty partition when no file matches.
        return batches(partition) if isinstance(partition, Ranges) else iter(())


class LineStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("splitBytes", SPLIT_BYTES))
        cap = options.get("maxBackfillBytes")
        self.cap = None if cap is None else int(cap)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return list_files(self.path)

    def partitions(self, start, end):
        out: list[ByteRange] = []
        for file, length in end.items():
            begin, floor = start.get(file), 0
            if begin is None:
                begin = 0
                if self.cap is not None and length > self.cap:
                    begin = floor = length - self.cap
            elif begin > length:
                begin = 0
            out.extend(split(file, begin, length, self.size, floor))
        return packed(out)

    def read(self, partition):
        return batches(partition) if isinstance(partition, Ranges) else iter(())


class LineTail(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineReader(self.options)

    def streamReader(self, schema):
        return LineStreamReader(self.options)


@dataclass
class FileNames(InputPartition):
    found: list[tuple[str, int]]


class FileListReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        found = list(list_files(self.path).items())
        return [FileNames(found[i : i + 10_000]) for i in range(0, len(found), 10_000)]

    def read(self, partition):
        return iter(partition.found if isinstance(partition, FileNames) else ())


class FileList(DataSource):
    """Names and sizes of files, empty ones too; no file is opened."""

    @classmethod
    def name(cls):
        return "file_list"

    def schema(self):
        return "file string, bytes bigint"

    def reader(self, schema):
        return FileListReader(self.options)


def register(spark: SparkSession) -> None:
    # Workers get the classes themselves, so they need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LineTail)
    spark.dataSource.register(FileList)


def read_file_list(spark: SparkSession, path: str):
    register(spark)
    return spark.read.format("file_list").options(path=path).load()


def read_lines(spark: SparkSession, path: str, **options):
    """Every complete line of the files now there."""
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()


def stream_lines(spark: SparkSession, path: str, **options):
    """Lines as they are appended."""
    register(spark)
    return spark.readStream.format(NAME).options(path=path, **options).load()
