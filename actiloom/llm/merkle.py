"""Merkle manifest of a dataset: a tree per partition value, and one over their roots.

Leaves stand in order; every two consecutive nodes become their parent, a last
one alone becomes the parent of itself only. A tree is cut into aligned blocks of
2 ** height leaves. A block is one row: its subtree's digests in van Emde Boas
order. The upper half of its levels is laid out first, then each subtree below
it, and each of these is laid out the same way, so that a path from a leaf to the
root stays within few neighbouring places whatever a page's size is. ``address``
is that layout as arithmetic; building a block and fetching siblings use nothing
else. The blocks' roots are the leaves of the next tier, until a tree has one
block. Only digests and bounded blocks move; a tree of any size is spread over
its blocks, and no task or the driver holds one whole.

A digest is the SHA-256 of its inputs' concatenation, children as lowercase hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actiloom.llm.frames import written

#: A block has at most two to this many leaves.
HEIGHT = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NUMBERS = ("doc_id", "n_chars")
_BLOCK = "tree string, block long, total long, n int, height int, nodes binary, digest binary"
_SIZE = 32
#: How a node meets its sibling: it has none, or it is the left or the right one of the two.
ALONE, LEFT, RIGHT = "A", "L", "R"


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at a depth (the root has 0) of a complete tree of so many levels."""
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower = levels - upper
        depth -= upper
        place += (1 << upper) - 1 + (index >> depth) * ((1 << lower) - 1)
        index = index & ((1 << depth) - 1)
        levels = lower
    return place


def parent(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def build(leaves: Sequence[bytes], height: int) -> list[str]:
    """Hex digests of a block in van Emde Boas order; places without a node are empty."""
    nodes = [""] * ((2 << height) - 1)
    places = address(height + 1, height, np.arange(len(leaves))).tolist()
    for place, leaf in zip(places, leaves, strict=True):
        nodes[place] = leaf.hex()
    for depth in range(height - 1, -1, -1):
        below, places = places, address(height + 1, depth, np.arange((len(places) + 1) // 2)).tolist()
        for k, place in enumerate(places):
            nodes[place] = parent(*(nodes[child] for child in below[2 * k : 2 * k + 2]))
    return nodes


def siblings(nodes: Sequence[str], n: int, height: int) -> tuple[list[str], list[str]]:
    """For each of a block's n leaves, from the lowest level up: the siblings, joined, and the node's sides."""
    index = np.arange(n)
    shown, sides = [[] for _ in range(n)], [[] for _ in range(n)]
    for depth in range(height, 0, -1):
        other = index ^ 1
        present = other <= index[-1]
        places = np.where(present, address(height + 1, depth, other), -1).tolist()
        for k, (place, right) in enumerate(zip(places, (index & 1).tolist(), strict=True)):
            if place < 0:
                sides[k].append(ALONE)
            else:
                shown[k].append(nodes[place])
                sides[k].append(RIGHT if right else LEFT)
        index = index >> 1
    return list(map("".join, shown)), list(map("".join, sides))


def fold(leaf: str, others: str, sides: str) -> str:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for side in sides:
        if side == ALONE:
            leaf = parent(leaf)
            continue
        other = others[at : at + 2 * _SIZE]
        at += 2 * _SIZE
        leaf = parent(leaf, other) if side == LEFT else parent(other, leaf)
    return leaf


@dataclass(frozen=True)
class Manifest:
    """``leaves``: a row per document with its tree and rank; ``tiers``: the blocks of all trees, leaves' first;
    ``top``: the blocks of the tree over their roots; ``names``: each tree's rank there; ``root``: hex, None of no rows."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    names: DataFrame
    root: str | None


def leaf_digest(columns: Mapping[str, Column]) -> Column:
    """Of each value its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [value.cast("string") for value in columns.values()]
    parts = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    by: str = "lang",
    order: str = "doc_id",
    later: Mapping[str, Column] | None = None,
    height: int = HEIGHT,
) -> Manifest:
    """Builds and writes the trees over ``docs``, one per value of ``by``, null being a value too.

    Leaves ascend by ``order``, a null one first, equal ones by digest. Trees
    ascend by the bytes of ``by``, null first. ``later`` replaces columns by what
    a second reading found: the leaf of that is kept beside the first. Null and
    empty values differ; repeated rows are a leaf each. No rows have no root.
    Other columns are not looked at.
    """
    first = {c: F.col(c).cast("long") if c in NUMBERS else F.col(c) for c in columns}
    second = first | {c: value.cast("long") if c in NUMBERS else value for c, value in (later or {}).items()}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("tree"),
        first[order].alias("doc_id"),
        leaf_digest(first).alias("digest"),
        (leaf_digest(second) if later else F.lit(None).cast("binary")).alias("later"),
    )
    # Sorting by ranges reads its input twice: of the digests, not of the texts.
    leaves = _ranked(written(rows, "digests"), F.col("doc_id").asc_nulls_first(), F.col("digest"))
    leaves = leaves.withColumn("later", F.coalesce("later", "digest"))
    tiers = _forest(leaves, height)
    roots = _roots(tiers, height)
    names = _ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), F.col("name"))
    top = _forest(names, height)
    last = top[-1].select("digest").first()
    return Manifest(leaves, tiers, top, names, last[0].hex() if last else None)


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` within their tree, from 0, and ``total``, the tree's rows.

    Sorted by ranges over all tasks, so a tree with most of the rows is spread
    like any other; ranks come from the counts of each tree in each task.
    """
    rows = rows.repartitionByRange(F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part")
    counts = counts.select(
        "tree",
        "part",
        (F.sum("n").over(earlier) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("total"),
    )
    ranked = rows.join(written(counts, "counts"), ["tree", "part"])
    return ranked.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _forest(rows: DataFrame, height: int) -> list[DataFrame]:
    """The tiers of blocks over rows with ``tree``, ``rank``, ``total``, ``digest``."""

    def block(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ranks = group["rank"].to_numpy()
        digests = group["digest"].to_pylist()
        total = group["total"][0].as_py()
        # A tree of one block ends at its root; a block of a larger tree goes all levels up.
        tall = height if total > 1 << height else (total - 1).bit_length()
        nodes = build([digests[k] for k in np.argsort(ranks).tolist()], tall)
        row = {"tree": key[0].as_py(), "block": key[1].as_py(), "total": total, "n": len(digests), "height": tall}
        row |= {"nodes": b"".join(bytes.fromhex(node) or bytes(_SIZE) for node in nodes), "digest": bytes.fromhex(nodes[0])}
        return pa.Table.from_pylist([row], _schema)

    _schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("n", pa.int32()), ("height", pa.int32())]
        + [("nodes", pa.binary()), ("digest", pa.binary())]
    )
    tiers = []
    while True:
        groups = rows.select("tree", F.shiftright("rank", height).alias("block"), "rank", "total", "digest").groupBy("tree", "block")
        tiers.append(written(groups.applyInArrow(block, _BLOCK), "tier"))
        more = tiers[-1].filter(F.col("total") > 1 << height)
        if more.isEmpty():
            return tiers
        above = F.shiftright(F.col("total") + ((1 << height) - 1), height)
        rows = more.select("tree", F.col("block").alias("rank"), above.alias("total"), "digest")


def _roots(tiers: list[DataFrame], height: int) -> DataFrame:
    ends = [tier.filter(F.col("total") <= 1 << height).select("tree", "digest") for tier in tiers]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionAll(end)
    return out


def _opened(tiers: list[DataFrame], ends: DataFrame, height: int) -> DataFrame:
    """The lowest tier's blocks with the way from their root upwards: ``sides``, ``others``, ``subroot``.

    ``ends``: the way on from each tree's own root, and that root as ``subroot``.
    """
    above = None
    for tier in reversed(tiers):
        whole = F.col("total") <= 1 << height
        blocks = tier.filter(whole).join(ends, "tree")
        if above is not None:
            blocks = blocks.unionByName(tier.filter(~whole).join(_paths(above, height), ["tree", "block"]))
        above = blocks
    return above


def _paths(blocks: DataFrame, height: int) -> DataFrame:
    """From blocks with their way upwards, the same for each of their leaves, which are blocks of the tier below."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shown, sides = siblings(_hex(row["nodes"]), row["n"], row["height"])
                yield pa.record_batch(
                    {
                        "tree": pa.array([row["tree"]] * row["n"], pa.string()),
                        "block": pa.array(range(row["block"] << height, (row["block"] << height) + row["n"]), pa.int64()),
                        "sides": pa.array([own + row["sides"] for own in sides], pa.string()),
                        "others": pa.array([own + row["others"] for own in shown], pa.string()),
                        "subroot": pa.array([row["subroot"]] * row["n"], pa.string()),
                    }
                )

    kept = blocks.select("tree", "block", "n", "height", "nodes", "sides", "others", "subroot")
    return kept.mapInArrow(run, "tree string, block long, sides string, others string, subroot string")


def _hex(nodes: bytes) -> list[str]:
    text = nodes.hex()
    return [text[at : at + 2 * _SIZE] for at in range(0, len(text), 2 * _SIZE)]


def proofs(made: Manifest, height: int = HEIGHT) -> DataFrame:
    """Per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``sides``, ``others`` (its siblings from the lowest
    level through the subroot to the root, joined as hex) and ``folded_root``, where the later leaf leads by them."""
    root = made.root
    start = made.top[0].sparkSession.createDataFrame([("", "", "", "")], "tree string, sides string, others string, subroot string")
    ends = _paths(_opened(made.top, start, height), height).join(made.names.select(F.col("rank").alias("block"), "name", "digest"), "block")
    ends = ends.select(F.col("name").alias("tree"), "sides", "others", F.lower(F.hex("digest")).alias("subroot"))
    blocks = _opened(made.tiers, written(ends, "ends"), height).select("tree", "block", "n", "height", "nodes", "sides", "others", "subroot")
    rows = made.leaves.select("tree", F.shiftright("rank", height).alias("block"), "rank", "doc_id", "digest", "later")
    names = ["doc_id", "leaf", "subroot", "root", "sides", "others", "folded_root"]

    def prove(key: tuple[pa.Scalar, ...], group: pa.Table, block: pa.Table) -> pa.Table:
        way = block.to_pylist()[0]
        shown, sides = siblings(_hex(way["nodes"]), way["n"], way["height"])
        out = []
        for rank, doc_id, digest, later in zip(*(group[c].to_pylist() for c in ("rank", "doc_id", "digest", "later")), strict=True):
            k = rank - (key[1].as_py() << height)
            others, ways = shown[k] + way["others"], sides[k] + way["sides"]
            out.append((doc_id, digest.hex(), way["subroot"], root, ways, others, fold(later.hex(), others, ways)))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] + [pa.string()] * 6
        return pa.table({name: pa.array(values, kind) for name, values, kind in zip(names, columns, kinds, strict=True)})

    both = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    return both.applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, sides string, others string, folded_root string")
