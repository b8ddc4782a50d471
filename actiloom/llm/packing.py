"""Best-fit packing of token sequences by minimum bin slack.

A bin starts with the longest piece that is left; subset sums over the lengths
that are left, as bits of one integer, then find the fullest feasible bin, and
its pieces are removed. Pieces of one length are alike, so the search runs on
the counts per length, of which there are at most as many as a bin has tokens,
and a bin found is repeated as often as the counts allow. What the driver holds
depends on the bin size alone. Each piece finds its bin from its number among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actiloom.llm.encoder import KEPT, encoder
from actiloom.llm.frames import pick, portions, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """Lengths and how many of each: the subset with the largest sum of at most ``room``.

    ``counts`` goes from long to short; of equal sums the one of longer pieces wins.
    """
    bits, within, steps = 1, (1 << room + 1) - 1, []
    for length, count in counts.items():
        count, chunk = min(count, room // length), 1
        while count > 0 and not bits >> room & 1:
            chunk = min(chunk, count)
            steps.append((length, chunk, bits))
            bits |= bits << length * chunk & within
            count -= chunk
            chunk *= 2
        if bits >> room & 1:
            break
    total, found = bits.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> total & 1:
            total -= length * chunk
            found[length] = found.get(length, 0) + chunk
    return found


@dataclass
class Plan:
    """Rows sorted by length and first number; ``keys`` joins both."""

    keys: np.ndarray
    first: np.ndarray
    length: np.ndarray
    repeats: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of pieces by length and number among its like."""
        row = np.searchsorted(self.keys, (length << 44) + number, "right") - 1
        nth = number - self.first[row]
        repeats = self.repeats[row]
        return self.bin[row] + nth % repeats, self.offset[row] + nth // repeats * self.length[row]


def plan(counts: dict[int, int], size: int) -> Plan:
    left = {length: counts[length] for length in sorted(counts, reverse=True)}
    taken = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        found = fullest(size - longest, {x: n for x, n in left.items() if n})
        left[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        repeats = min(left[length] // n for length, n in found.items())
        offset = 0
        for length in sorted(found, reverse=True):
            n = found[length]
            rows.append((length, taken[length], repeats, bins, offset))
            offset += n * length
            taken[length] += n * repeats
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
        bins += repeats
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan((rows[:, 0] << 44) + rows[:, 1], rows[:, 1], rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], bins)


def pieces(
    docs: DataFrame, tokenizer: str, cut: str | None, size: int, end: int | None, ids: bool = False, kept: int = KEPT
) -> DataFrame:
    """Per piece of at most ``size`` ids: where it is, a checksum, its ``ids`` if asked for.

    ``nth`` numbers the pieces of one length within a task.
    """

    def split(batches):
        task, seen = TaskContext.get().partitionId(), {}
        tail = np.array([] if end is None else [end], np.uint32)
        for batch in portions(batches, "text", 1 << 20):
            flat, offsets = encoder(tokenizer, cut, kept).encode(batch["text"].to_pylist())
            rows, held = [], []
            for k, doc_id in enumerate(batch["doc_id"].to_pylist()):
                own = np.concatenate([flat[offsets[k] : offsets[k + 1]], tail])
                for piece, start in enumerate(range(0, len(own), size)):
                    part = own[start : start + size]
                    nth = seen[len(part)] = seen.get(len(part), -1) + 1
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), task, nth))
                    held.append(part)
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in held], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names)

    return pick(docs, "doc_id", "text").mapInArrow(split, PIECES + (", ids array<int>" if ids else ""))


def pack(
    docs: DataFrame,
    tokenizer: str,
    cut: str | None,
    size: int = 2048,
    end: int | None = 0,
    ids: bool = False,
    kept: int = KEPT,
) -> DataFrame:
    """Per piece ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its ids and the id ``end``; longer ones are cut into pieces of
    ``size``, the last one shorter. Sequences hold at most ``size`` ids without
    gaps. A null text is empty and has the end id alone; without an end id such
    a document has no piece. Each row is packed for itself, so equal rows and
    rows that share a doc_id or have none are all there. An empty table gives no
    rows; other columns are not looked at. ``kept`` bounds what a worker
    remembers of the tokenizer's work; it changes speed and memory alone.
    """
    cuts = written(pieces(docs, tokenizer, cut, size, end, ids, kept), "pieces")
    each = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    each = written(each.withColumn("before", before), "lengths")
    # At most ``size`` rows, whatever the corpus.
    counts = {row.length: row.n for row in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = docs.sparkSession.sparkContext.broadcast(plan(counts, size))
    numbered = cuts.join(each.select("task", "length", "before"), ["task", "length"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"] + ["ids"] * ids

    def place(batches):
        for batch in batches:
            sequence, offset = bins.value.place(batch["length"].to_numpy(), batch["number"].to_numpy())
            out = {name: batch[name] for name in names if name != "number"}
            yield pa.record_batch(out | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return numbered.select(names).mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence its ``ids``, from pieces packed with ``ids=True``; a group is at most one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda part: part["ids"])).alias("ids"))
