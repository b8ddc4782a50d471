"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash to the pieces of a bit sketch; each
shingle flips one bit of its piece, so a bit is the parity of the shingles that
hash to it. Two sketches differ in at most as many bits, and so in at most as
many pieces, as the sets differ in shingles. A link of similarity t between sets
of n and m shingles allows d = (1 - t)(n + m) / (1 + t) differences; with more
than d pieces at least one is equal (the pigeonhole).

* Sets are compared within size bands, each with its own number of pieces; a set
  close enough to the next band's sizes is entered there as well.
* Of its pieces a set enters only the d + 1 fullest, in an order that depends on
  a piece's content alone. The fullest piece that two linked sets share has at
  most d others before it in either, so it is entered by both; nearly empty
  pieces, which anything could share, are not entered.
* Equal sets are one node: only the first of them is entered.
* The pieces in which several sets meet are gathered under the first set they
  hold, so that a set comes to a meeting once, however many pieces it shares there.
* A first meeting compares whole sketches and lets those sets go on that have some
  other within the Hamming distance of a link. A second one, of these alone,
  compares the sets themselves. It holds a union-find: two sets already connected
  are not compared, and a meeting tells no more links than connect its sets. A
  group of copies so costs a few rows per copy, and no link between components is lost.
* A meeting with more bytes than a block is dealt to blocks; every two of them meet.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.encoder import release
from actiloom.llm.frames import pick, portions, written
from actiloom.llm.graph import components
from actiloom.llm.words import BASE, SPACED, mixed, windows, words_of

U = np.uint64
#: A band's largest set has about this many times the shingles of its smallest.
BAND_RATIO = 2.0
#: A piece has two to this many bits, so that different sets hardly share a filled piece by chance.
PIECE_BITS = 16
#: Pieces of a band over what its largest sets must enter.
SPARE = 1.25
#: Bytes of sketches or sets that one block of a meeting holds.
BLOCK = 16 << 20
#: Bits, as a power of two, of the map that says which sets are still wanted; more bits only save work.
WANTED = 23


class Sketch:
    """Sizes of bands and pieces for a similarity of ``percent`` in a hundred."""

    def __init__(self, percent: int) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("the similarity must be from 50 to 100 in a hundred")
        self.percent = percent
        least = 1
        while self.differences(least) < 1 and least < 1000:
            least += 1
        self.bands = [least]
        ratio = max(BAND_RATIO, 100 / percent + 0.1)
        while self.bands[-1] < 1 << 40:
            self.bands.append(int(self.bands[-1] * ratio) + 1)

    def differences(self, n: int) -> int:
        """The most shingles in which a set of n can differ from one it links with."""
        most = n + n * 100 // self.percent
        return (100 - self.percent) * most // (100 + self.percent)

    def entries(self, shingles: np.ndarray) -> np.ndarray:
        """The keys under which a sorted set of hashes is entered."""
        n = len(shingles)
        if self.percent == 100 or n < self.bands[0]:
            return np.zeros(0, U)
        band = bisect_right(self.bands, n) - 1
        keys = [self._keys(shingles, band)]
        if 100 * n >= self.percent * self.bands[band + 1]:
            keys.append(self._keys(shingles, band + 1))
        return np.concatenate(keys)

    def _keys(self, shingles: np.ndarray, band: int) -> np.ndarray:
        kept = self.differences(len(shingles)) + 1
        count = int(SPARE * (self.differences(self.bands[band + 1] - 1) + 1)) + 1
        # Place and bit of each shingle; a bit that an even number of them flips is unset.
        bits = (((shingles >> U(32)) * U(count)) >> U(32)) << U(PIECE_BITS) | shingles & U((1 << PIECE_BITS) - 1)
        bits.sort()
        first = np.flatnonzero(np.concatenate([[True], bits[1:] != bits[:-1]]))
        bits = bits[first[np.diff(first, append=len(bits)) % 2 == 1]]
        place = (bits >> U(PIECE_BITS)).astype(np.int64)
        set_bits = np.bincount(place, minlength=count)
        # A piece's content as the xor of its set bits' hashes; an empty one is 0.
        sketch = np.zeros(count, U)
        if len(bits):
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sketch[place[first]] = np.bitwise_xor.reduceat(mixed(bits + U(BASE)), first)
        where = np.arange(band << 32, (band << 32) + count, dtype=U) * U(BASE)
        keys = mixed(sketch ^ mixed(where))
        full = np.minimum(set_bits, 31).astype(U) << U(59) | keys >> U(5)
        return keys[np.argpartition(full, count - kept)[count - kept :]]


def whole_sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by their low hash bits: two to four bits for each."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    return np.packbits(np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with ``size`` bytes: halves are laid over each other."""
    out = np.frombuffer(sketch, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct runs of ``width`` words, hashed and sorted.

    A text of fewer words has its whole sequence as the only one; a null text or
    one without words has none.
    """
    words = words_of(column, SPACED)
    runs = windows(words.hashes, width)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield windows(words.hashes[a:b], int(b - a)) if b > a else np.zeros(0, U)


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row its set's size, a digest of the set, its entries and its whole sketch; of equal sets in one task the first alone enters."""

    def sign(batches):
        release()
        sketch, met = Sketch(percent), set()
        for batch in portions(batches, "text"):
            sizes, digests, entries, sketches = [], [], [], []
            for shingles in shingle_sets(batch["text"], width):
                sizes.append(len(shingles))
                digests.append(_digest(shingles))
                entries.append(np.zeros(0, np.int64) if digests[-1] in met else sketch.entries(shingles).view(np.int64))
                sketches.append(whole_sketch(shingles))
                met.add(digests[-1])
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "entries": _lists(entries),
                    "sketch": pa.array(sketches, pa.binary()),
                }
            )

    return pick(docs, "doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, entries array<long>, sketch binary")


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of ``wanted`` (``row``, ``doc_id``, ``digest``) from the texts: ``row``, ``data``."""

    def sets(batches):
        release()
        met = set()
        for batch in portions(batches, "text"):
            found = {}
            for shingles in shingle_sets(batch["text"], width):
                digest = _digest(shingles)
                if digest is not None and digest not in met:
                    met.add(digest)
                    found[digest] = shingles.tobytes()
            yield pa.record_batch({"digest": pa.array(list(found), pa.binary()), "data": pa.array(list(found.values()), pa.binary())})

    texts = _maybe_among(pick(docs, "doc_id", "text"), wanted, "doc_id")
    found = texts.mapInArrow(sets, "digest binary, data binary").join(wanted.select("row", "digest"), "digest")
    return found.groupBy("row").agg(F.min("data").alias("data"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of at least ``percent`` in a hundred; ``component_id`` is the
    smallest doc_id that links reach, the document's own included. A null or
    wordless text has no shingles and is alone. Rows that share a doc_id are one
    document, linked by each of its texts. A row without a doc_id links like any
    other; its component is null where links reach no id. An empty table gives
    no rows. Other columns are not looked at.
    """
    # Rows are told apart by a number from here on, so that no id gathers many texts.
    signed = written(signatures(docs, width, percent).withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min(order).alias("first"))
    classes = written(classes.select("digest", F.col("first.row").alias("row"), F.col("first.doc_id").alias("node")), "classes")
    # Both reads of this exchange share one shuffle.
    entries = signed.select(F.explode("entries").alias("entry"), "row").repartition("entry")
    shared = entries.groupBy("entry").agg(F.min("row").alias("hub"), F.max("row").alias("most")).filter("hub < most")
    members = entries.join(shared.select("entry", "hub"), "entry")
    members = written(members.groupBy("hub", "row").agg(F.collect_list("entry").alias("entries")), "members")
    # Copies of other tasks go here: any earlier, the two reads would differ and each be shuffled by itself.
    members = members.join(classes.select("row"), "row", "left_semi")
    sizes = signed.select("row", F.col("n_shingles").alias("n"))
    # A sketch has up to half a byte for a shingle, a set eight bytes.
    near = _met(members.join(sizes, "row"), signed.select("row", F.col("sketch").alias("data")), 1, percent, _hopeful)
    near = written(near.distinct(), "near")
    close = members.join(near, ["hub", "row"], "left_semi").join(sizes, "row")
    wanted = classes.join(near.select("row").distinct(), "row").select("row", F.col("node").alias("doc_id"), "digest")
    links = _met(close, _sets(docs, written(wanted, "wanted"), width), 8, percent, _forest)
    links = links.select(F.col("hub").alias("a"), F.col("row").alias("b"))
    # An id with several texts links their classes, whichever row names them.
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x < y").select("doc_id")
    shown = named.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes, "digest")
    least = shown.groupBy("doc_id").agg(F.min("row").alias("b"))
    shown = shown.select("doc_id", F.col("row").alias("a")).join(least, "doc_id").select("a", "b")
    reached = written(components(links.unionAll(shown)), "reached").withColumnRenamed("node", "row")
    linked = reached.join(classes, "row")
    linked = linked.select("digest", "component").join(linked.groupBy("component").agg(F.min("node").alias("least")), "component")
    found = classes.join(linked.select("digest", "least"), "digest", "left").select("digest", F.coalesce("least", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _met(members: DataFrame, data: DataFrame, scale: int, percent: int, judge) -> DataFrame:
    """What ``judge`` says of every meeting, (``hub``, ``row``).

    ``members``: ``hub``, ``row``, ``entries``, ``n``. A hub whose members have
    more bytes than a block is dealt to blocks, and every two of its blocks meet.
    """
    weight = F.sum(F.lit(scale) * F.col("n") + 8 * F.size("entries") + 64)
    totals = members.groupBy("hub").agg(F.count("*").alias("many"), F.ceil(weight / BLOCK).alias("blocks")).filter("many > 1")
    rows = members.join(totals.drop("many"), "hub").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meeting = F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other")).alias("meeting")
    across = (F.col("block") != F.col("other")).alias("across")
    rows = written(rows.select(meeting, "hub", "row", "block", across, "n", "entries"), "meetings")
    rows = rows.join(_maybe_among(data, rows, "row"), "row")
    rows = rows.select("meeting", "hub", "row", "block", "across", "n", "entries", "data")
    rows = rows.repartition("meeting").sortWithinPartitions("meeting")

    def judged(part: pa.Table) -> pa.RecordBatch:
        meeting = part["meeting"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]])) if len(meeting) else np.zeros(1, int)
        found = [judge(Meeting(part.slice(a, b - a), percent)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.record_batch({"hub": pa.array(found[:, 0]), "row": pa.array(found[:, 1])})

    def compare(batches):
        release()
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            meeting = part["meeting"].to_numpy()
            last = int(np.searchsorted(meeting, meeting[-1])) if len(meeting) else 0
            held = part.slice(last)
            if last:
                yield judged(part.slice(0, last).combine_chunks())
        if held is not None:
            yield judged(held.combine_chunks())

    return rows.mapInArrow(compare, "hub long, row long")


def _maybe_among(data: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``data`` without most of what is not among ``rows``: a bitmap of fixed size leaves it out before it moves."""
    slot = (F.pmod(F.xxhash64(key), F.lit(1 << WANTED)) + 1).alias("slot")
    maps = rows.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("nth"))
    maps = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    placed = data.select("*", slot).withColumn("nth", F.bitmap_bucket_number("slot")).withColumn("place", F.bitmap_bit_position("slot"))
    byte = "cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)"
    kept = placed.join(F.broadcast(maps), "nth").filter(f"(shiftright({byte}, cast(place % 8 as int)) & 1) = 1")
    return kept.select(*data.columns)


class Meeting:
    """The sets that one meeting holds; ``others`` gives each pair with a common entry once."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        self.percent = percent
        self.hub, self.row, self.n = (rows[c].to_numpy() for c in ("hub", "row", "n"))
        self.data = rows["data"].to_pylist()
        block = rows["block"].to_numpy()
        self.block = block if rows["across"][0].as_py() else None
        entries = rows["entries"].combine_chunks()
        self.ptr = entries.offsets.to_numpy().astype(np.int64)
        self.ptr -= self.ptr[0]
        keys = entries.flatten().to_numpy()
        owner = np.repeat(np.arange(len(rows)), np.diff(self.ptr))
        order = np.argsort(keys, kind="stable")
        _, key = np.unique(keys, return_inverse=True)
        self.key, self.owner = key, owner[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(key))])

    def others(self, k: int) -> np.ndarray:
        """Later sets that share an entry with set k, were not met in another block and have a size that allows a link."""
        own = self.key[self.ptr[k] : self.ptr[k + 1]]
        found = np.concatenate([self.owner[self.first[e] : self.first[e + 1]] for e in own.tolist()])
        found = np.unique(found[found > k])
        if self.block is not None:
            found = found[self.block[found] != self.block[k]]
        return found[np.abs(self.n[found] - self.n[k]) <= self.allowed(k, found)]

    def allowed(self, k: int, others: np.ndarray) -> np.ndarray:
        """The most differences that a link leaves."""
        return (100 - self.percent) * (self.n[k] + self.n[others]) // (100 + self.percent)


def _hopeful(meeting: Meeting) -> np.ndarray:
    """The sets that have another one within the Hamming distance of a link."""
    sizes = np.array([len(x) for x in meeting.data])
    by_size, hopeful = {}, np.zeros(len(sizes), bool)
    for size in np.unique(sizes).tolist():
        # Neighbours differ by a factor of two or three, so a sketch is folded once or twice.
        some = np.flatnonzero((sizes >= size) & (sizes <= 8 * size))
        place = np.full(len(sizes), -1)
        place[some] = np.arange(len(some))
        by_size[size] = place, np.stack([_folded(meeting.data[k], size) for k in some.tolist()]).view(np.uint64)
    for k in range(len(sizes) - 1):
        others = meeting.others(k)
        others = others[~hopeful[others]] if hopeful[k] else others
        smaller = np.minimum(sizes[others], sizes[k])
        for size in np.unique(smaller).tolist():
            some = others[smaller == size]
            place, matrix = by_size[size]
            apart = np.bitwise_count(matrix[place[some]] ^ matrix[place[k]]).sum(axis=1, dtype=np.int64)
            some = some[apart <= meeting.allowed(k, some)]
            hopeful[some] = True
            hopeful[k] |= len(some) > 0
    return np.stack([meeting.hub[hopeful], meeting.row[hopeful]], axis=1)


def _forest(meeting: Meeting) -> np.ndarray:
    """Links that connect what links connect in this meeting, at most one for each set."""
    n = len(meeting.data)
    ptr = np.cumsum([0, *(len(x) // 8 for x in meeting.data)])
    flat = np.unique(np.frombuffer(b"".join(meeting.data), U), return_inverse=True)[1]
    marked = np.zeros(int(flat.max()) + 1, bool)
    root, links = np.arange(n), []
    for k in range(n - 1):
        others = meeting.others(k)
        others = others[root[others] != root[k]]
        if not len(others):
            continue
        own = flat[ptr[k] : ptr[k + 1]]
        marked[own] = True
        sizes = ptr[others + 1] - ptr[others]
        ends = np.cumsum(sizes)
        places = np.repeat(ptr[others] - (ends - sizes), sizes) + np.arange(ends[-1])
        shared = np.add.reduceat(marked[flat[places]].astype(np.int64), ends - sizes)
        marked[own] = False
        close = others[100 * shared >= meeting.percent * (sizes + len(own) - shared)]
        for other in close.tolist():
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
                links.append((meeting.row[k], meeting.row[other]))
    return np.array(links, np.int64).reshape(-1, 2)
