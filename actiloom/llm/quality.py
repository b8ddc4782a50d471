"""Quality scores: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.encoder import release
from actiloom.llm.frames import pick, portions
from actiloom.llm.words import SPACED, words_of, windows

#: About so many labelled rows are fitted; a share of all, taken by a hash of doc_id.
FIT_ROWS = 50_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 5, 64, 0.15, 20.0
FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "beyond_ascii", "stops", "exclaims", "symbols", "bars", "other_marks",
    "distinct_words", "top_word", "repeats", "distinct_pairs", "log_lines", "distinct_lines", "line_words", "short_words", "long_words",
    "marked_words", "squeezed",
]
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", bytes(range(128, 256)), b".,;:", b"!?", b"#$%&*@^", b"|<>{}[]/\\_~`=+"]
_GROUP_OF = np.full(256, len(_GROUPS), np.uint8)
_GROUP_OF[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = len(_GROUPS) + 1
for _k, _group in enumerate(_GROUPS):
    _GROUP_OF[np.frombuffer(_group, np.uint8)] = _k
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"!#$%&*@^|<>{}[]\\_~`=+", np.uint8)] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; null is empty."""
    words = words_of(column, SPACED)
    pairs = windows(words.hashes, 2)
    texts = column.to_pylist()
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        a, b = int(words.first[k]), int(words.first[k + 1])
        if not raw:
            continue
        n, size = b - a, len(raw)
        groups = np.bincount(_GROUP_OF[np.frombuffer(raw, np.uint8)], minlength=len(_GROUPS) + 2) / size
        lines = [line for line in raw.split(b"\n") if line]
        row = [np.log1p(size), np.log1p(n), 0.0, *groups[: len(_GROUPS) + 1]]
        if n:
            lengths = words.ends[a:b] - words.starts[a:b]
            row[2] = lengths.mean()
            _, counts = np.unique(words.hashes[a:b], return_counts=True)
            row += [len(counts) / n, counts.max() / n, np.mean(words.hashes[a : b - 1] == words.hashes[a + 1 : b]) if n > 1 else 0.0]
            row.append(len(np.unique(pairs[a : b - 1])) / (n - 1) if n > 1 else 1.0)
            row += [np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines)]
            row += [np.mean(lengths <= 3), np.mean(lengths >= 15), np.mean(_MARK[words.data[words.ends[a:b] - 1]])]
            row.append(len(zlib.compress(raw, 1)) / size)
            out[k] = row
        else:
            out[k, : len(row)] = row
    return out


@dataclass
class Forest:
    """Trees as flat arrays: a node's feature, threshold, first child and value; leaves have child -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1, from 0 to 1."""
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(DEPTH):
                child = self.child[node]
                right = rows[every, self.feature[node]] > self.threshold[node]
                node = np.where(child < 0, node, child + right)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def boost(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Fits the trees. Without rows every score is 1/2, with one label alone it is near that label."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    feature, threshold, child, value, roots = [], [], [], [], []
    arrays = lambda: (np.array(x) for x in (roots, feature, threshold, child, value))
    if n == 0 or labels.min() == labels.max():
        return Forest(*(x.astype(int) if k < 2 or k == 3 else x for k, x in enumerate(arrays())), base)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T, strict=True)], axis=1)
    raw = np.full(n, base)
    width = rows.shape[1]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, curvature = labels - p, p * (1 - p)
        roots.append(len(feature))
        level = [(len(feature), np.arange(n))]
        for x in (feature, threshold, child, value):
            x.append(0)
        for depth in range(DEPTH + 1):
            below = []
            for node, own in level:
                g, h = gradient[own], curvature[own]
                value[node], child[node] = RATE * g.sum() / (h.sum() + 1.0), -1
                raw_gain = g.sum() ** 2 / (h.sum() + 1.0)
                if depth == DEPTH or len(own) < 2 * LEAST:
                    continue
                flat = (binned[own] + np.arange(width) * BINS).ravel()
                sums = [np.bincount(flat, np.repeat(x, width), width * BINS).reshape(width, BINS).cumsum(axis=1) for x in (g, h, np.ones(len(own)))]
                (left, lh, ln), right, rh, rn = sums, g.sum() - sums[0], h.sum() - sums[1], len(own) - sums[2]
                gain = left**2 / (lh + 1.0) + right**2 / (rh + 1.0) - raw_gain
                gain[(ln < LEAST) | (rn < LEAST)] = 0
                f, cut = divmod(int(np.argmax(gain)), BINS)
                if gain[f, cut] <= 1e-6:
                    continue
                feature[node], threshold[node], child[node] = f, edges[f][cut], len(feature)
                goes_right = binned[own, f] > cut
                for part in (own[~goes_right], own[goes_right]):
                    below.append((len(feature), part))
                    for x in (feature, threshold, child, value):
                        x.append(0)
            for node, own in level:
                if child[node] == -1:
                    raw[own] += value[node]
            level = below
    roots, feature, threshold, child, value = arrays()
    return Forest(roots, feature, threshold.astype(float), child, value.astype(float), base)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Trees for ``labels.quality`` from about ``rows`` labelled texts at most, whose statistics come to the driver.

    Rows that repeat one id and text teach once, and the share is one of different
    labelled rows, so that neither a repeated row nor a repeated id goes beyond the bound.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").distinct()
    docs = pick(docs, "doc_id", "text").filter("doc_id is not null").withColumn("row", F.xxhash64("doc_id", "text"))
    count = docs.select("doc_id", "row").distinct().join(known, "doc_id").count()
    if count > rows:
        docs = docs.filter(F.pmod("row", F.lit(1 << 32)) < int(rows / count * (1 << 32)))
    docs = docs.dropDuplicates(["doc_id", "row"])

    def measure(batches):
        release()
        for batch in portions(batches, "text"):
            values = statistics(batch["text"])
            yield pa.record_batch({"doc_id": batch["doc_id"], "row": batch["row"], "values": pa.array(list(values), pa.list_(pa.float64()))})

    measured = docs.mapInArrow(measure, "doc_id long, row long, values array<double>").join(known, "doc_id")
    # An order that does not hang on how tasks were dealt, so the trees are the same each time.
    table = measured.select("doc_id", "row", "values", "quality").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("quality", "ascending")])
    values = np.array(table["values"].to_pylist(), float).reshape(-1, len(FEATURES))
    return boost(values, np.array(table["quality"].to_pylist(), float))


def held_out():
    """Whether a row is kept from teaching; null without a doc_id, and such rows do not teach either."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def score(docs: DataFrame, training: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``score``, learnt from the texts of ``training`` that ``labels`` marks.

    A null text is scored as an empty one. Labels without id or other than 0 and
    1 teach nothing; a document with several labels teaches each. With nothing to
    learn from all scores are 1/2. Equal texts get equal scores. An empty table
    gives no rows; other columns are not looked at.
    """
    forest = docs.sparkSession.sparkContext.broadcast(fit(training, labels, rows))

    def rate(batches):
        release()
        for batch in portions(batches, "text"):
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(forest.value.score(statistics(batch["text"])))})

    return pick(docs, "doc_id", "text").mapInArrow(rate, "doc_id long, score double")


def accepted(docs: DataFrame, training: DataFrame, labels: DataFrame, least: float, rows: int = FIT_ROWS) -> DataFrame:
    """``docs``, all columns, without the rows whose score is below ``least``."""
    forest = docs.sparkSession.sparkContext.broadcast(fit(training, labels, rows))

    def keep(batches):
        release()
        for batch in portions(batches, "text"):
            yield batch.filter(pa.array(forest.value.score(statistics(batch["text"])) >= least))

    return docs.mapInArrow(keep, docs.schema)
