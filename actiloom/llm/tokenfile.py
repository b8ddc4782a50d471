"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of
every id that has one, and a bitmap that says which of them go on at level k + 1.
The place of a chunk on the next level is the number of set bits before it, which
a rank directory gives to the nearest block of bits. Any id is so read by as many
steps as it has chunks, without decoding its neighbours.

A file: magic, header length, JSON header (document and token counts, and each
section's place, size), then the sections: doc_ids (with a mask of nulls), ends of
the documents in tokens, and per level chunks, bitmap (64-bit words, lowest bit
first) and ranks (64-bit, one per ``RANK_WORDS`` words).

Files are written by the tasks through the file system that the folder's URI
names; only files that a finished task reports are in the list, so a lost task's
half-written file is never read.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actiloom.llm.encoder import encoder
from actiloom.llm.frames import pick, portions, written
from actiloom.session import scratch_path

MAGIC = b"DACTOK01"
RANK_WORDS = 8
#: Tokens after which a task begins its next file.
FILE_TOKENS = 16_000_000


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and ranks of each level."""
    levels = []
    while True:
        more = ids >> np.uint32(8)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        counts = np.bitwise_count(words).astype(np.uint64)
        before = np.cumsum(counts, dtype=np.uint64) - counts
        levels.append(((ids & np.uint32(255)).astype(np.uint8), words, before[::RANK_WORDS]))
        ids = more[goes_on]
        if not len(ids):
            return levels


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    sections = {
        "doc_ids": np.array([0 if d is None else d for d in doc_ids], "<i8"),
        "nulls": np.array([d is None for d in doc_ids], np.uint8),
        "ends": np.cumsum(sizes, dtype="<i8") if sizes else np.zeros(0, "<i8"),
    }
    levels = encode_levels(ids)
    for k, (chunks, words, ranks) in enumerate(levels):
        sections |= {f"chunks{k}": chunks, f"bits{k}": words, f"ranks{k}": ranks.astype("<u8")}
    places, at = {}, 0
    for name, section in sections.items():
        places[name] = [at, section.nbytes]
        at += section.nbytes
    header = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "levels": len(levels), "sections": places}).encode()
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), header, *(s.tobytes() for s in sections.values())])


class TokenFile:
    """Random access to the documents and tokens of one file."""

    def __init__(self, uri: str) -> None:
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        length = int.from_bytes(head[8:], "little")
        self.header = json.loads(self.file.read_at(length, 16))
        self.base = 16 + length
        self.levels = self.header["levels"]
        nulls = self._section("nulls", np.uint8)
        self.doc_ids = [None if null else int(d) for d, null in zip(self._section("doc_ids", "<i8"), nulls, strict=True)]
        self.ends = self._section("ends", "<i8")

    def _section(self, name: str, kind, first: int = 0, last: int | None = None) -> np.ndarray:
        """Entries [first, last) of a section; nothing else is read."""
        at, size = self.header["sections"][name]
        width = np.dtype(kind).itemsize
        last = size // width if last is None else min(last, size // width)
        return np.frombuffer(self.file.read_at(max(0, last - first) * width, self.base + at + first * width), kind)

    def _rank(self, level: int, place: int) -> int:
        """Set bits before a place of a level's bitmap."""
        word = place // 64
        block = word // RANK_WORDS
        words = self._section(f"bits{level}", "<u8", block * RANK_WORDS, word + 1)
        if block * RANK_WORDS >= self.header["sections"][f"bits{level}"][1] // 8:  # the place behind the last bit
            return self.header["sections"][f"chunks{level + 1}"][1] if level + 1 < self.levels else 0
        inside = words.copy()
        if len(inside) == word - block * RANK_WORDS + 1:
            inside[-1] &= np.uint64((1 << place % 64) - 1)
        return int(self._section(f"ranks{level}", "<u8", block, block + 1)[0]) + int(np.bitwise_count(inside).sum())

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places [first, last)."""
        out = np.zeros(last - first, np.uint32)
        where = np.arange(last - first)
        for level in range(self.levels):
            if last <= first:
                break
            chunks = self._section(f"chunks{level}", np.uint8, first, last)
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            words = self._section(f"bits{level}", "<u8", first // 64, (last + 63) // 64)
            goes_on = np.unpackbits(words.view(np.uint8), bitorder="little")[first % 64 :][: last - first].astype(bool)
            where = where[goes_on]
            first = self._rank(level, first) if level + 1 < self.levels else 0
            last = first + len(where)
        return out

    def token(self, place: int) -> int:
        return int(self.ids(place, place + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_files(docs: DataFrame, folder: str, tokenizer: str, cut: str | None, end: int | None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the ids of all texts in order of doc_id; returns the list of files.

    ``part``, ``nth``: the order of files; ``path``, ``n_docs``, ``n_tokens``.
    """
    # Ranges go on inside an id, and inside equal rows, so no id is one task.
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("nth")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        task, tail = TaskContext.get().partitionId(), np.array([] if end is None else [end], np.uint32)
        doc_ids, sizes, parts, nth = [], [], [], 0

        def flush():
            nonlocal doc_ids, sizes, parts, nth
            name = f"part-{task:06d}-{nth:05d}-{uuid.uuid4().hex}.dac"
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(file_bytes(doc_ids, sizes, ids))
            row = {"part": [task], "nth": [nth], "path": [f"{folder.rstrip('/')}/{name}"], "n_docs": [len(sizes)], "n_tokens": [len(ids)]}
            doc_ids, sizes, parts, nth = [], [], [], nth + 1
            return pa.RecordBatch.from_pydict(row)

        held = 0
        for batch in portions(batches, "text", 1 << 20):
            flat, offsets = encoder(tokenizer, cut).encode(batch["text"].to_pylist())
            for k, doc_id in enumerate(batch["doc_id"].to_pylist()):
                own = flat[offsets[k] : offsets[k + 1]]
                doc_ids.append(doc_id)
                sizes.append(len(own) + len(tail))
                parts += [own, tail]
                held += sizes[-1]
                if held >= file_tokens:
                    yield flush()
                    held = 0
        if sizes:
            yield flush()

    return written(ordered.mapInArrow(write, "part long, nth long, path string, n_docs long, n_tokens long"), "files")


def read_files(files: DataFrame) -> DataFrame:
    """Per document, read back from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    order = Window.orderBy("part", "nth")  # one narrow row per file
    files = files.withColumn("before", F.sum("n_tokens").over(order) - F.col("n_tokens"))

    def read(batches):
        for batch in batches:
            for path, before in zip(batch["path"].to_pylist(), batch["before"].to_pylist(), strict=True):
                file = TokenFile(path)
                starts = np.concatenate([[0], file.ends[:-1]]) if len(file.ends) else file.ends
                for at in range(0, len(file.ends), 1000):
                    last = min(at + 1000, len(file.ends))
                    ids = file.ids(int(starts[at]), int(file.ends[last - 1])) - 0
                    own = [ids[a - starts[at] : b - starts[at]] for a, b in zip(starts[at:last], file.ends[at:last], strict=True)]
                    yield pa.record_batch(
                        {
                            "doc_id": pa.array(file.doc_ids[at:last], pa.int64()),
                            "start": pa.array(starts[at:last] + before, pa.int64()),
                            "n_tokens": pa.array([len(x) for x in own], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                        }
                    )

    each = files.select("path", "before").repartition(max(1, files.count()))
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, tokenizer: str, cut: str | None, end: int | None) -> DataFrame:
    """Writes all texts as token files in the shared folder and reads them back.

    A null text is empty. Each row is a document of its own; rows that share a
    doc_id follow each other, those without one come first. An empty table
    writes no file and gives no rows. Other columns are not looked at.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_files(write_files(docs, shared_uri(docs.sparkSession, folder), tokenizer, cut, end))


def shared_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark resolves it by: without one, that of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and "://" not in uri else uri
