"""Ranked lexical search by per-term geometric blocking.

A document is a vector with one impact per term, an item one with its terms'
weights; the score is their inner product in whole numbers. Documents are held in
shards of bounded size. A shard's documents are laid out by similarity: each goes
to the nearest of some pivots, and pivots follow each other by nearness. Every
posting list, so clustered, is cut into blocks, and of each block is stored the
coordinatewise maximum of its documents, over all terms. An item visits its
lists in falling order of what they can add. It leaves the rest when even all of
them together stay below its threshold, and skips a block when the block's summary
does: both bounds are exact, so no document that belongs in the result is missed.
Of what is not skipped whole scores are computed from the documents' vectors.

The threshold is the k-th best score met so far. A first round over a share of the
documents gives it to the second, which searches all others. Vectors hold the terms
that items ask for, and are written once for all items of a portion; summaries
belong to a shard and live in the task that holds it, since written down they would
take several times the room of the postings. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actiloom.llm.encoder import release
from actiloom.llm.frames import pick, portions, written
from actiloom.llm.words import LETTERED, words_of

#: Bytes of items that are searched for in one portion; each portion reads the documents once.
PORTION = 16 << 20
#: A shard ends when it has as many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
#: Distinct terms of the items that one blocking of a shard serves.
QUERY_TERMS = 8192
BLOCK = 32
PIVOTS = 64
#: One document in so many is searched first, for thresholds.
FIRST = 16
#: Cells of the table in which summaries are gathered.
CELLS = 1 << 22
#: Blocks of a list that are scored before the threshold is looked at again.
STEP = 8


@dataclass
class Items:
    """``nth``, ``item_id``, and of each item the terms (places in ``vocabulary``) with their numbers of repeats."""

    nth: list[int]
    item_id: list[int | None]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: np.ndarray

    def groups(self, most: int = QUERY_TERMS) -> list[tuple[list[int], np.ndarray]]:
        """Items and their terms, at most ``most`` terms in a group, or those of one item."""
        out, some, terms = [], [], np.zeros(0, np.int64)
        for k, own in enumerate(self.terms):
            both = np.union1d(terms, own)
            if some and len(both) > most:
                out.append((some, terms))
                some, both = [], own
            some, terms = [*some, k], both
        return [*out, (some, terms)] if some else out


def read_items(rows: pa.Table) -> Items:
    words = words_of(rows["text"].combine_chunks(), LETTERED)
    vocabulary, places = np.unique(words.hashes, return_inverse=True)
    counted = [np.unique(places[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    kept = [k for k, (terms, _) in enumerate(counted) if len(terms)]
    nth, item_id = rows["nth"].to_pylist(), rows["item_id"].to_pylist()
    return Items([nth[k] for k in kept], [item_id[k] for k in kept], [counted[k][0] for k in kept], [counted[k][1] for k in kept], vocabulary)


@dataclass
class Vectors:
    """Rows of (term, impact) one after the other; ``ptr``: n + 1 places."""

    ptr: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of some rows, and the rows' sizes."""
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.ptr[rows] - (ends - sizes), sizes) + np.arange(total), sizes

    def taken(self, rows: np.ndarray) -> Vectors:
        places, sizes = self.entries(rows)
        return Vectors(np.concatenate([[0], np.cumsum(sizes)]), self.term[places], self.impact[places])

    def narrowed(self, terms: np.ndarray) -> Vectors:
        """With the sorted ``terms`` alone, by their places in it."""
        if not len(terms):
            return Vectors(np.zeros_like(self.ptr), self.term[:0], self.impact[:0])
        place = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        kept = terms[place] == self.term
        before = np.concatenate([[0], np.cumsum(kept)])
        return Vectors(before[self.ptr], place[kept], self.impact[kept])

    def scores(self, rows: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
        """Inner products of rows, none of them empty, with a dense vector."""
        places, sizes = self.entries(rows)
        if not len(sizes):
            return np.zeros(0, np.int64)
        products = self.impact[places] * coefficients[self.term[places]]
        return np.add.reduceat(products, np.cumsum(sizes) - sizes)


def similarity_order(vectors: Vectors, weights: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The rows, each with the others of its nearest pivot, near pivots in a row."""
    n = len(vectors)
    count = min(pivots, n)
    values = (vectors.impact * weights[vectors.term]).astype(np.float32)
    row = np.repeat(np.arange(n), np.diff(vectors.ptr))
    lengths = np.sqrt(np.bincount(row, values.astype(np.float64) ** 2, n)).astype(np.float32)
    chosen = np.linspace(0, n - 1, count).astype(np.int64)
    places, sizes = vectors.entries(chosen)
    table = np.zeros((len(weights), count), np.float32)
    own = np.repeat(np.arange(count), sizes)
    table[vectors.term[places], own] = values[places] / np.maximum(lengths[chosen], 1e-9)[own]
    near = np.zeros((n, count), np.float32)
    step = max(1, CELLS // count)
    at = 0
    while at < n:
        last = max(at + 1, int(np.searchsorted(vectors.ptr, vectors.ptr[at] + step, "right")) - 1)
        part = slice(vectors.ptr[at], vectors.ptr[last])
        near[at:last] = np.add.reduceat(table[vectors.term[part]] * values[part, None], vectors.ptr[at:last] - vectors.ptr[at])
        at = last
    best = near.argmax(axis=1)
    alike = near[chosen] / np.maximum(lengths[chosen], 1e-9)[:, None]
    np.fill_diagonal(alike, -1)
    chain, left = [0], set(range(1, count))
    while left:
        chain.append(max(left, key=lambda k: (alike[chain[-1], k], -k)))
        left.remove(chain[-1])
    place = np.empty(count, np.int64)
    place[chain] = np.arange(count)
    return np.lexsort((-near[np.arange(n), best] / np.maximum(lengths, 1e-9), place[best]))


class Blocks:
    """The posting lists of a shard's vectors, cut into blocks with their summaries."""

    def __init__(self, vectors: Vectors, weights: np.ndarray, block: int = BLOCK) -> None:
        width = len(weights)
        self.order = similarity_order(vectors, weights)
        self.vectors = vectors = vectors.taken(self.order)
        by_term = np.argsort(vectors.term, kind="stable")
        self.docs = np.repeat(np.arange(len(vectors)), np.diff(vectors.ptr))[by_term]
        sizes = np.bincount(vectors.term, minlength=width)
        lists = np.concatenate([[0], np.cumsum(sizes)])
        #: Blocks [first[t], first[t + 1]) are those of the list of term t.
        self.first = np.concatenate([[0], np.cumsum(-(-sizes // block))])
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], np.diff(self.first))
        self.start = np.repeat(lists[:-1], np.diff(self.first)) + nth * block
        self.stop = np.minimum(self.start + block, np.repeat(lists[1:], np.diff(self.first)))
        self.most = np.zeros(width, np.int64)
        np.maximum.at(self.most, vectors.term, vectors.impact)
        self._summarise(width, block)

    def _summarise(self, width: int, block: int) -> None:
        n, step = len(self.start), max(1, CELLS // max(1, width))
        terms, values, counts = [], [], [np.zeros(1, np.int64)]
        impact, term = self.vectors.impact.astype(np.int32), self.vectors.term.astype(np.int32)
        for low in range(0, n, step):
            start, stop = self.start[low : low + step], self.stop[low : low + step]
            table = np.zeros(len(start) * width, np.int32)
            for k in range(block):
                some = np.flatnonzero(start + k < stop)
                if not len(some):
                    break
                # One document of each block: no cell comes twice.
                places, sizes = self.vectors.entries(self.docs[start[some] + k])
                cells = np.repeat(some * width, sizes) + term[places]
                table[cells] = np.maximum(table[cells], impact[places])
            filled = np.flatnonzero(table)
            terms.append((filled % width).astype(np.int32))
            values.append(table[filled])
            counts.append(np.bincount(filled // width, minlength=len(start)))
        self.summary_ptr = np.cumsum(np.concatenate(counts))
        self.summary_term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        self.summary_value = np.concatenate(values) if values else np.zeros(0, np.int32)

    def bounds(self, term: int, coefficients: np.ndarray) -> np.ndarray:
        """What a document of each block of a list can score at most; no summary is empty."""
        ptr = self.summary_ptr[self.first[term] : self.first[term + 1] + 1]
        part = slice(ptr[0], ptr[-1])
        return np.add.reduceat(self.summary_value[part] * coefficients[self.summary_term[part]], ptr[:-1] - ptr[0])

    def search(self, terms: np.ndarray, coefficients: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best rows of at least the score ``least``, their scores, and how many blocks were scored.

        ``coefficients``: repeats times weights over all terms; ``ids``: what orders equal scores.
        """
        adds = self.most[terms] * coefficients[terms]
        falling = np.argsort(-adds, kind="stable")
        left = np.cumsum(adds[falling][::-1])[::-1]
        met = np.zeros(len(self.vectors), bool)
        rows, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        threshold = max(1, least)
        for rest, term in zip(left.tolist(), terms[falling].tolist(), strict=True):
            if rest < threshold:
                break
            bounds = self.bounds(term, coefficients)
            best = np.argsort(-bounds, kind="stable")
            for at in range(0, len(best), STEP):
                some = best[at : at + STEP]
                some = some[bounds[some] >= threshold]
                if not len(some):
                    break
                scored += len(some)
                some = some + self.first[term]
                found = np.concatenate([self.docs[a:b] for a, b in zip(self.start[some].tolist(), self.stop[some].tolist(), strict=True)])
                found = np.unique(found[~met[found]])
                met[found] = True
                own = self.vectors.scores(found, coefficients)
                good = own >= threshold
                rows, scores = np.concatenate([rows, found[good]]), np.concatenate([scores, own[good]])
                if len(rows) >= k:
                    kept = np.lexsort((ids[rows], -scores))[:k]
                    rows, scores = rows[kept], scores[kept]
                    threshold = max(threshold, int(scores[-1]))
        return rows, scores, scored


def search_shard(vectors: Vectors, doc_ids: pa.Array, items: Items, weights: np.ndarray, k: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each item's k best documents of a shard, those below the item's ``least`` left out."""
    ids = doc_ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    for group, terms in items.groups():
        narrow = vectors.narrowed(terms)
        used = np.flatnonzero(np.diff(narrow.ptr))
        if not len(used):
            continue
        blocks = Blocks(narrow.taken(used), weights[terms])
        place = used[blocks.order]
        own_ids = ids[place]
        nth, rows, scores = [], [], []
        coefficients = np.zeros(len(terms), np.int64)
        for item in group:
            own = np.searchsorted(terms, items.terms[item])
            coefficients[own] = items.repeats[item] * weights[items.terms[item]]
            present = own[(blocks.most[own] > 0) & (coefficients[own] > 0)]
            found, score, _ = blocks.search(present, coefficients, own_ids, k, int(least[item]))
            coefficients[own] = 0
            nth += [item] * len(found)
            rows.append(place[found])
            scores.append(score)
        if nth:
            yield pa.record_batch(
                {
                    "nth": pa.array([items.nth[item] for item in nth], pa.int64()),
                    "item_id": pa.array([items.item_id[item] for item in nth], pa.int64()),
                    "doc_id": doc_ids.take(pa.array(np.concatenate(rows))),
                    "score": pa.array(np.concatenate(scores), pa.int64()),
                }
            )


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document ``doc_id``, ``n`` (its terms with repeats), and the terms of the vocabulary it holds with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        release()
        terms = shared.value
        for batch in portions(batches, "text"):
            words = words_of(batch["text"], LETTERED)
            place = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
            known = np.flatnonzero(terms[place] == words.hashes)
            doc = np.searchsorted(words.first, known, "right") - 1
            keys, counts = np.unique(doc << 32 | place[known], return_counts=True)
            ends = pa.array(np.searchsorted(keys >> 32, np.arange(len(batch) + 1)), pa.int32())
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n": pa.array(np.diff(words.first), pa.int64()),
                    "terms": pa.ListArray.from_arrays(ends, pa.array(keys & 0xFFFFFFFF, pa.int32())),
                    "occurrences": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                }
            )

    found = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, occurrences array<int>")
    return written(found, "forward")


def _search(forward: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int, least: np.ndarray) -> DataFrame:
    """Each item's k best documents of every shard that a task makes of its rows."""
    shared = forward.sparkSession.sparkContext.broadcast((items, weights, least))

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, least = shared.value
        rows = pa.Table.from_batches(held).combine_chunks()
        terms, counts = rows["terms"].combine_chunks(), rows["occurrences"].combine_chunks()
        ptr = terms.offsets.to_numpy().astype(np.int64)
        n = np.repeat(rows["n"].to_numpy(), np.diff(ptr))
        tf = counts.flatten().to_numpy().astype(np.int64)
        mild = 25 + 75 * n * documents // length
        vectors = Vectors(ptr - ptr[0], terms.flatten().to_numpy().astype(np.int64), 1_000_000_000 * tf // (1000 * tf + 8 * mild))
        yield from search_shard(vectors, rows["doc_id"].combine_chunks(), items, weights, k, least)

    def run(batches):
        release()
        held, docs, postings = [], 0, 0
        for batch in batches:
            while len(batch):
                ends = batch["terms"].offsets.to_numpy()
                fits = int(np.searchsorted(ends, ends[0] + SHARD_POSTINGS - postings, "right")) - 1
                fits = max(min(fits, SHARD_DOCS - docs, len(batch)), 0 if held else 1)
                if fits:
                    held.append(batch.slice(0, fits))
                    docs, postings = docs + fits, postings + int(ends[fits] - ends[0])
                    batch = batch.slice(fits)
                if len(batch):
                    yield from shard(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield from shard(held)

    return forward.filter(F.size("terms") > 0).mapInArrow(run, "nth long, item_id long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("nth").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, portion: int = PORTION) -> DataFrame:
    """Per row of ``items`` its ``k`` best rows of ``docs``: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms, weights and scores are those of the scoring rule: of N documents with a
    term, L terms in all and df documents with this one, a term weighs
    floor(1000 * ln((2 N + 2) / (2 df + 1))); a document of n terms with tf of it adds
    weight * (10^9 tf div (1000 tf + 8 m)) for each repeat in the item, m being
    25 + 75 n N div L. Only scores above 0 count; equal ones ascend by doc_id, a null
    one last. Null and empty texts have no terms: such an item gives no rows, such
    a document is in none. Repeated rows of either table stand for themselves. An
    empty table on either side gives no rows. Other columns are not looked at.
    """
    asked = written(pick(items, "item_id", "text").withColumn("nth", F.monotonically_increasing_id()), "items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if size <= portion else 2 * size // portion
    out = None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("nth"), F.lit(parts)) == part)
        found = _portion(docs, read_items(rows.toArrow()), k)
        out = found if out is None or found is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def _portion(docs: DataFrame, items: Items, k: int) -> DataFrame:
    spark = docs.sparkSession
    if not items.nth:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    forward = forward_index(docs, items.vocabulary)
    documents, length = forward.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(items.vocabulary), np.int64)
    # At most one row per term of the portion.
    holding = forward.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    for term, df in zip(holding["term"].to_pylist(), holding["count"].to_pylist(), strict=True):
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    first = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(FIRST)) == 0
    least = np.zeros(len(items.nth), np.int64)
    start = written(_best(_search(forward.filter(first), items, weights, documents, length or 1, k, least), k), "first")
    place = {nth: n for n, nth in enumerate(items.nth)}
    for nth, score in start.filter(F.col("rank") == k).select("nth", "score").toLocalIterator():
        least[place[nth]] = score
    rest = _search(forward.filter(~first), items, weights, documents, length or 1, k, least)
    return _best(start.drop("rank").unionAll(rest), k).select("item_id", "rank", "doc_id", "score")
