"""Exact top-k by inner product with an M-tree.

A vector x of squared length n gets one more coordinate, sqrt(N - n), N being the
largest n of all; a query gets 0 there. The squared distance of a query q to it
is then |q|^2 + N - 2 q.x, so the nearest vectors have the largest products, and
a metric tree finds them.

The root's routing objects are a bounded sample of the vectors, more of them for more
vectors. Every vector belongs to its nearest one, with its distance to it, and to a
page of those at about that distance. A query first searches its own page, which gives
a distance that its k-th result cannot exceed; then it goes to all pages whose covering
ring reaches nearer. Queries travel to the pages and stream through a page's tree, which
is built once for all of them (once for each ``BLOCK`` where more come). Inside a page the tree goes on: a node has a pivot, a covering
radius and the distance to its parent's pivot; nodes are visited best first, and
the triangle inequality on the stored distances skips nodes and vectors without
computing a distance.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actiloom.llm.frames import pick, written

#: Least routing objects of the root, vectors of a page, queries that one copy of a page answers, entries of a node.
ROUTES, PAGE, BLOCK, NODE = 64, 20_000, 200_000, 64
#: Steps of distance by which the pages of a routing object are told apart, for each page.
STEPS = 16


@dataclass
class Node:
    pivot: np.ndarray
    radius: float
    rows: np.ndarray | None = None  # of a leaf
    far: np.ndarray | None = None  # their distances to the pivot, or the children's
    children: list[Node] = field(default_factory=list)
    pivots: np.ndarray | None = None
    radii: np.ndarray | None = None


class MTree:
    """Over the rows of ``points``, vectors with their extra coordinate."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        self.points, self.ids = points, ids
        self.exact = points[:, :-1]
        # Rounding of distances, generously.
        self.slack = 1e-6 * (1.0 + float(np.abs(points).max(initial=0.0)) * math.sqrt(points.shape[1]))
        self.root = self._node(np.arange(len(points)), points[0]) if len(points) else None

    def _node(self, rows: np.ndarray, pivot: np.ndarray) -> Node:
        away = np.sqrt(np.maximum(0, ((self.points[rows] - pivot) ** 2).sum(axis=1)))
        if len(rows) <= NODE:
            return Node(pivot, float(away.max(initial=0.0)), rows, away)
        count = min(NODE, -(-len(rows) // NODE))
        chosen = np.unique(self.points[rows[np.linspace(0, len(rows) - 1, count).astype(int)]], axis=0)
        near = self.points[rows] @ chosen.T * -2 + (chosen**2).sum(axis=1)
        owner = np.argmin(near, axis=1)
        groups = [(rows[owner == k], chosen[k]) for k in range(len(chosen))]
        if len(groups) == 1 or max(len(g) for g, _ in groups) > 0.9 * len(rows):  # alike: cut by distance
            order = rows[np.argsort(away, kind="stable")]
            groups = [(part, self.points[part[0]]) for part in np.array_split(order, max(2, count))]
        children = [self._node(group, p) for group, p in groups if len(group)]
        pivots = np.stack([c.pivot for c in children])
        far = np.sqrt(((pivots - pivot) ** 2).sum(axis=1))
        return Node(pivot, float(away.max()), None, far, children, pivots, np.array([c.radius for c in children]))

    def search(self, query: np.ndarray, own: int, k: int, base: float, least: float) -> list[tuple[float, int]]:
        """The k best (score, id) but for ``own``, of scores of at least ``least``; ``base``: |q|^2 + N."""
        best: list[tuple[float, int]] = []  # a heap, worst first: (score, -id)
        if self.root is None:
            return []
        q = np.append(query, 0.0)
        reach = lambda score: math.sqrt(max(0.0, base - 2 * score)) + self.slack if score > -math.inf else math.inf
        most = reach(least)
        start = math.sqrt(((q - self.root.pivot) ** 2).sum())
        queue, serial = [(max(0.0, start - self.root.radius), 0, start, self.root)], 0
        while queue:
            bound, _, to_pivot, node = heapq.heappop(queue)
            if bound > most:
                break
            if node.rows is not None:
                rows = node.rows[np.abs(to_pivot - node.far) <= most]
                scores = self.exact[rows] @ query
                for score, found in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if found == own or score < least:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -found))
                    elif (score, -found) > best[0]:
                        heapq.heapreplace(best, (score, -found))
                if len(best) == k and best[0][0] > least:
                    least = best[0][0]
                    most = reach(least)
                continue
            open_ = np.flatnonzero(np.abs(to_pivot - node.far) - node.radii <= most)
            away = np.sqrt(((node.pivots[open_] - q) ** 2).sum(axis=1))
            for c, d in zip(open_.tolist(), away.tolist(), strict=True):
                if (low := max(0.0, d - node.children[c].radius)) <= most:
                    serial += 1
                    heapq.heappush(queue, (low, serial, d, node.children[c]))
        return [(score, -found) for score, found in sorted(best, reverse=True)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` numbers; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), size))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), pa.float64()))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k highest inner products with all others.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. Components are
    floor(scale * x). Equal scores go by smaller vec_id; with fewer others there
    are fewer rows. Vectors that are null, or hold a null or a non-finite
    component, and rows without id take no part. A shorter vector counts as
    followed by zeros. Rows that share a vec_id count as one vector each as
    candidates, are never a candidate of their own id, and as queries give the
    best of them all. An empty table gives no rows; other columns are not looked
    at. Products are exact while a vector's squared length is below 2**53.
    """
    spark = vectors.sparkSession
    cast = F.col("embedding").cast("array<double>")
    rows = pick(vectors.withColumn("embedding", cast), "vec_id", "embedding").filter(
        "vec_id is not null and embedding is not null"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    scaled = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    rows = written(rows.select("vec_id", scaled.alias("v"), F.monotonically_increasing_id().alias("nth")), "vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    size, largest, total = rows.agg(F.max(F.size("v")), F.max(squared), F.count("*")).first()
    none = "query_id long, rank int, vec_id long, score long"
    if size is None:
        return spark.createDataFrame([], none)
    # As many routing objects as each has pages, so neither level grows faster than the root of the table.
    count = max(ROUTES, math.isqrt(total // PAGE))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "nth").limit(count).select("v").toArrow()
    routes = np.unique(_points(_matrix(sample["v"].combine_chunks(), size), largest), axis=0)

    def assign(batches):
        for batch in batches:
            points = _points(_matrix(batch["v"], size), largest)
            cell = np.argmin(points @ routes.T * -2 + (routes**2).sum(axis=1), axis=1)
            far = np.sqrt(((points - routes[cell]) ** 2).sum(axis=1))
            held = {"vec_id": batch["vec_id"], "nth": batch["nth"], "v": _lists(points[:, :-1])}
            yield pa.record_batch(held | {"cell": pa.array(cell), "far": pa.array(far)})

    placed = written(rows.mapInArrow(assign, "vec_id long, nth long, v array<double>, cell long, far double"), "placed")
    rings = _rings(placed)

    def settle(batches):
        for batch in batches:
            cell, far, nth = (batch[name].to_numpy() for name in ("cell", "far", "nth"))
            page = np.zeros(len(cell), np.int64)
            for c in np.unique(cell).tolist():
                own, near = np.flatnonzero(cell == c), rings[c]["near"]
                ring = np.searchsorted(near, far[own], "right") - 1
                page[own] = rings[c]["first"][ring] + (nth[own] ^ nth[own] >> 33) % rings[c]["parts"][ring]
            yield pa.record_batch({"vec_id": batch["vec_id"], "v": batch["v"], "page": pa.array(page)})

    def paged(part: DataFrame) -> DataFrame:
        return part.mapInArrow(settle, "vec_id long, v array<double>, page long")

    queries = paged(placed.filter(F.col("vec_id") % every == 0)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "page")
    # The same vector under the same id is one query.
    queries = queries.groupBy("query_id", "q").agg(F.min("page").alias("page"))
    home = _searched(paged(placed), queries.withColumn("least", F.lit(None).cast("double")), k, largest, size)
    home = written(home, "home")
    # Of no more than k rows of each query: what its k-th result cannot fall below.
    least = home.distinct().groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    bounded = queries.join(least, "query_id", "left")

    def reach(batches):
        for batch in batches:
            q = _matrix(batch["q"], size)
            base = (q**2).sum(axis=1) + largest
            bound = np.array([-math.inf if x is None else x for x in batch["least"].to_pylist()])
            most = np.sqrt(np.maximum(0, base - 2 * np.maximum(bound, -1e300)))
            away = np.sqrt(np.maximum(0, base[:, None] - 2 * (q @ routes[:, :-1].T) - largest + (routes**2).sum(axis=1)))
            slack = 1e-6 * (1.0 + math.sqrt(largest) * math.sqrt(size + 1))
            own = batch["page"].to_pylist()
            pages: list[list[int]] = [[] for _ in own]
            for c, ring in rings.items():
                # Rings lie in order of distance, so those that a query reaches follow each other.
                begin = np.searchsorted(ring["far"], away[:, c] - most - slack)
                end = np.searchsorted(ring["near"], away[:, c] + most + slack, "right")
                for k_ in np.flatnonzero(begin < end).tolist():
                    first, last = int(ring["first"][begin[k_]]), int(ring["first"][end[k_] - 1] + ring["parts"][end[k_] - 1])
                    pages[k_] += [p for p in range(first, last) if p != own[k_]]
            out = {name: batch[name] for name in ("query_id", "q", "least")}
            yield pa.record_batch(out | {"pages": pa.array(pages, pa.list_(pa.int64()))})

    wide = bounded.select("query_id", "q", "least", "page").mapInArrow(reach, "query_id long, q array<double>, least double, pages array<long>")
    wide = wide.select("query_id", "q", "least", F.explode("pages").alias("page"))
    away = _searched(paged(placed), wide, k, largest, size)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = home.unionByName(away).distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _points(rows: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([rows, np.sqrt(np.maximum(0, largest - (rows**2).sum(axis=1)))])


def _rings(placed: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """Per routing object the rings of its vectors by distance, in order: ``near``, ``far``, ``first`` page and ``parts``.

    A ring holds about a page; where one distance has more, it has several pages.
    What comes to the driver is a row for each routing object and for each ring.
    """
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("a"), F.max("far").alias("b")).collect()
    spark = placed.sparkSession
    steps = spark.createDataFrame([(r.cell, r.a, STEPS * -(-r.n // PAGE) / max(r.b - r.a, 1e-300)) for r in cells], "cell long, a double, step double")
    stepped = placed.select("cell", "far").join(F.broadcast(steps), "cell").withColumn("bin", F.floor((F.col("far") - F.col("a")) * F.col("step")))
    bins = stepped.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("bin")) - F.col("n")
    ringed = bins.withColumn("ring", F.floor(before / PAGE)).groupBy("cell", "ring")
    found = ringed.agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).toArrow().sort_by([("cell", "ascending"), ("ring", "ascending")])
    cell, n, near, far = (found[name].to_numpy() for name in ("cell", "n", "near", "far"))
    parts = -(-n // PAGE)
    first = np.cumsum(parts) - parts
    held = {c: np.flatnonzero(cell == c) for c in np.unique(cell).tolist()}
    return {c: {"near": near[own], "far": far[own], "first": first[own], "parts": parts[own]} for c, own in held.items()}


def _searched(pages: DataFrame, queries: DataFrame, k: int, largest: float, size: int) -> DataFrame:
    """The k best of each query and page that it goes to.

    A page is held by one task, which streams the queries through its tree. Pages
    that no query goes to stay out; one to which more than ``BLOCK`` go has a copy
    for each ``BLOCK`` of them.
    """
    copies = queries.groupBy("page").agg(F.ceil(F.count("*") / BLOCK).alias("copies"))
    met = pages.join(copies, "page").select("page", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "vec_id", "v")
    met = met.withColumn("asks", F.lit(False)).withColumn("least", F.lit(None).cast("double"))
    copy = (F.pmod(F.xxhash64("query_id", "q"), "copies") + 1).alias("copy")
    asked = queries.join(copies, "page").select("page", copy, F.col("query_id").alias("vec_id"), F.col("q").alias("v"), F.lit(True).alias("asks"), "least")

    def search(batches):
        key, points, ids, tree = None, [], [], None
        for batch in batches:
            told = np.column_stack([batch[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in ("page", "copy", "asks")])
            cuts = [0, *(np.flatnonzero((told[1:] != told[:-1]).any(axis=1)) + 1).tolist(), len(told)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if key != tuple(told[low, :2]):
                    key, points, ids, tree = tuple(told[low, :2]), [], [], None
                part = batch.slice(low, high - low)
                rows, own = _matrix(part["v"], size), part["vec_id"].to_numpy()
                if not told[low, 2]:
                    points.append(_points(rows, largest))
                    ids.append(own)
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(points), np.concatenate(ids))
                out = []
                for row, query, least in zip(rows, own.tolist(), part["least"].to_pylist(), strict=True):
                    base = float((row**2).sum()) + largest
                    for score, found in tree.search(row, query, k, base, -math.inf if least is None else least):
                        out.append((query, found, int(score)))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    order = ["page", "copy", "asks"]
    both = met.unionByName(asked).repartition("page", "copy").sortWithinPartitions(*order)
    return both.mapInArrow(search, "query_id long, vec_id long, score long")
