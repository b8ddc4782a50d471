"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``width`` words of a benchmark text is a test string; a shorter text
is one string. Strings of one length m make a group with its own tables over
blocks of two words (one, for one-word strings):

* the shift table says, by a block's hash, how far the block can lie from the end
  of a string at most; a block that is in no string lets a search move on by
  m - 1 words;
* a shift of 0 is the last block of some string: its suffix bucket lists the
  strings that end so;
* each of those is compared with the document word by word.

Documents are cut into stretches that overlap by m - 1 words, and the cursors of
all stretches of a batch move together in numpy, so a step costs the same for
one document as for thousands.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import pick, portions, written
from actiloom.llm.words import LETTERED, Words, windows, words_of

SLOTS = 1 << 20
#: Words of a stretch that one cursor searches.
STRETCH = 256
#: Characters of benchmark texts that are searched for in one pass; more take more passes.
PASS_CHARS = 1_000_000


class Strings:
    """The test strings of one length and their tables."""

    def __init__(self, length: int, rows: list[np.ndarray], items: list[np.ndarray], texts: list[bytes]) -> None:
        self.length, self.block = length, min(2, length)
        self.items, self.texts = items, texts
        words = np.stack(rows)
        self.words = words
        blocks = np.stack([windows(row, self.block) for row in words])
        far = length - self.block
        self.shifts = np.full(SLOTS, max(1, far + 1), np.int64)
        for at in range(far + 1):
            slots = _slot(blocks[:, at])
            self.shifts[slots] = np.minimum(self.shifts[slots], far - at)
        # Suffix buckets: strings sorted by their last block.
        order = np.argsort(blocks[:, far], kind="stable")
        self.order, self.suffixes = order, blocks[order, far]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places (first word in the batch) and string numbers of all occurrences."""
        m, far = self.length, self.length - self.block
        blocks = windows(words.hashes, self.block)
        cursor, stop = _stretches(words.first, m)
        at, which = [], []
        while len(cursor):
            ends = blocks[cursor + far]
            shift = self.shifts[_slot(ends)]
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                low = np.searchsorted(self.suffixes, ends[hit], "left")
                high = np.searchsorted(self.suffixes, ends[hit], "right")
                for k in range(int((high - low).max())):
                    more = low + k < high
                    place, string = cursor[hit[more]], self.order[low[more] + k]
                    same = np.ones(len(place), bool)
                    for j in range(m):
                        same &= words.hashes[place + j] == self.words[string, j]
                    at.append(place[same])
                    which.append(string[same])
            cursor = cursor + np.maximum(shift, 1)
            alive = cursor < stop
            cursor, stop = cursor[alive], stop[alive]
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = np.concatenate(at), np.concatenate(which)
        sure = [_text(words, a, a + m) == self.texts[w] for a, w in zip(at, which, strict=True)]
        return at[sure], which[sure]


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (blocks >> np.uint64(44)).astype(np.int64)


def _text(words: Words, a: int, b: int) -> bytes:
    return b" ".join(bytes(words.data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)).lower()


def _stretches(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each stretch and the place behind its last one."""
    places = np.maximum(0, np.diff(first) - length + 1)
    counts = -(-places // STRETCH)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(first[:-1], counts) + nth * STRETCH
    return start, np.minimum(start + STRETCH, np.repeat(first[:-1] + places, counts))


def test_strings(items: list[tuple[int, str]], width: int) -> list[Strings]:
    """Groups of the distinct windows of the items, each with the ids of its items."""
    found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
    words = words_of(pa.array([text for _, text in items], pa.string()), LETTERED)
    for k, (item, _) in enumerate(items):
        a, b = int(words.first[k]), int(words.first[k + 1])
        for s in range(a, max(a + 1, b - width + 1)):
            if e := min(s + width, b) - s:
                found.setdefault(_text(words, s, s + e), (words.hashes[s : s + e], set()))[1].add(item)
    groups = defaultdict(list)
    for text, (hashes, ids) in found.items():
        groups[len(hashes)].append((hashes, np.array(sorted(ids)), text))
    return [Strings(m, *map(list, zip(*rows, strict=True))) for m, rows in sorted(groups.items())]


def hits(column: pa.Array, groups: list[Strings]) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Per text: number of words, the spans (first, behind last) that are hit, and the items."""
    words = words_of(column, LETTERED)
    first = words.first
    spans, items = defaultdict(list), defaultdict(set)
    for group in groups:
        at, which = group.find(words)
        owner = np.searchsorted(first, at, "right") - 1
        for text, place, string in zip(owner.tolist(), at.tolist(), which.tolist(), strict=True):
            spans[text].append((place - int(first[text]), place - int(first[text]) + group.length))
            items[text].update(group.items[string].tolist())
    for k in range(len(first) - 1):
        yield int(first[k + 1] - first[k]), _joined(spans.get(k, [])), sorted(items.get(k, ()))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passes(benchmark: DataFrame, most: int = PASS_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in portions of about ``most`` characters; one is on the driver at a time."""
    rows = pick(benchmark, "item_id", "text").filter("item_id is not null and text is not null")
    portion, held = [], 0
    for row in rows.toLocalIterator():
        portion.append((row.item_id, row.text))
        held += len(row.text)
        if held >= most:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<long>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: int = PASS_CHARS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``spans`` (runs of hit words), ``items`` with hits.

    Words are runs of digits, letters and characters beyond ASCII, letters A-Z
    lower-cased. A null or wordless text has no words, spans or items. Benchmark
    rows without id, text or words test for nothing; rows that share an item_id
    are one item. An empty benchmark hits nothing, empty ``docs`` give no rows,
    equal rows are judged alike, and other columns are not looked at. A benchmark
    of more than ``most`` characters takes several passes, each written to the
    shared folder, so that tables stay bounded.
    """
    context = docs.sparkSession.sparkContext
    docs = pick(docs, "doc_id", "text").select(
        "doc_id", "text", F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"), F.lit(None).cast("array<long>").alias("items")
    )
    tables = context.broadcast([])
    for k, portion in enumerate(passes(benchmark, most)):
        if k:
            docs = written(docs.mapInArrow(_search(tables, True), SPANS + ", text string"), "hits")
        tables = context.broadcast(test_strings(portion, width))
    return docs.mapInArrow(_search(tables, False), SPANS)


def _search(tables, again: bool):
    """Adds the hits of the tables to what is there; ``again``: the text is kept for a further pass."""

    def search(batches):
        for batch in portions(batches, "text"):
            rows = list(hits(batch["text"], tables.value))
            spans = [[{"first": a, "last": b} for a, b in s] for _, s, _ in rows]
            items = [i for _, _, i in rows]
            if batch["items"].null_count < len(batch):
                earlier = ([(x["first"], x["last"]) for x in old] for old in batch["spans"].to_pylist())
                spans = [_joined([(x["first"], x["last"]) for x in new] + old) for new, old in zip(spans, earlier, strict=True)]
                spans = [[{"first": a, "last": b} for a, b in s] for s in spans]
                items = [sorted({*new, *old}) for new, old in zip(items, batch["items"].to_pylist(), strict=True)]
            out = {
                "doc_id": batch["doc_id"],
                "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                "spans": pa.array(spans, SPAN_TYPE),
                "items": pa.array(items, pa.list_(pa.int64())),
            }
            yield pa.record_batch(out | ({"text": batch["text"]} if again else {}))

    return search


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows that contain a test string; all columns, row by row.

    A row with a null text stays. The limits of ``benchmark_hits`` hold; each
    further pass reads what the one before kept.
    """
    context = docs.sparkSession.sparkContext
    for k, portion in enumerate(passes(benchmark)):
        docs = written(docs, "clean") if k else docs
        docs = docs.mapInArrow(_without(context.broadcast(test_strings(portion, width))), docs.schema)
    return docs


def _without(tables):
    def keep(batches):
        for batch in portions(batches, "text"):
            yield batch.filter(pa.array([not items for _, _, items in hits(batch["text"], tables.value)], pa.bool_()))

    return keep
