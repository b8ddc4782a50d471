"""The Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from actiloom.llm import jaccard
from actiloom.llm.graph import components

SF = "/root/testdata/sf0.001"


def sets_of(rows, width):
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return out


def brute(sets, percent):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def run(spark, rows, width, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("entry", F.lit("x")).withColumn("n_shingles", F.lit(-1))
    return [tuple(r) for r in jaccard.jaccard_components(docs, width, percent).collect()]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_chains_and_edits(spark, width, percent):
    random.seed(width * percent)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = random.choices(vocabulary, k=random.choice([3, 8, 20, 60, 150, 400]))
        for _ in range(random.choice([1, 3, 8])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(random.choice([0, 1, 2])):
                words = list(words)
                words[random.randrange(len(words))] = random.choice(vocabulary)
    got = {d: (n, c) for d, n, c in run(spark, rows, width, percent)}
    assert got == brute(sets_of(rows, width), percent)


def test_edges(spark):
    long = " ".join(f"v{i % 977}x{i // 977}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
        (7, long), (8, long + " tail"), (9, "É a b c"), (10, "é a b c"), (11, long), (None, long), (None, None), (4, "other words here now"),
        (12, "Other words here NOW"),
    ]
    got = sorted(run(spark, rows, 4, 85), key=str)
    by_id = [(d, c) for d, _, c in got]
    assert set(by_id) == {
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (9, 9), (10, 10), (11, 7), (None, 7), (None, None), (12, 4),
    }
    assert {n for d, n, _ in got if d in (1, 2, 3)} == {0}
    assert run(spark, [], 4, 85) == []


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {d: (n, c) for d, n, c in run(spark, rows, 4, 85)} == brute(sets_of(rows, 4), 85)


def near_copies(n, seed=5, words=120, changes=3):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(0, words, 6), changes):
            own[k] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_many_sets_that_hardly_link(spark):
    rows = near_copies(60)
    got = {d: (n, c) for d, n, c in run(spark, rows, 4, 85)}
    assert got == brute(sets_of(rows, 4), 85)


@pytest.mark.parametrize("blocks", [0, 1])
def test_meetings_tell_forests(blocks):
    """Of a group of near copies a meeting tells fewer links than it has sets, and connects what links connect."""
    for n in (150, 300, 600):
        rows = near_copies(n, n, 200)
        sets = list(jaccard.shingle_sets(pa.array([text for _, text in rows]), 5))
        sketch = jaccard.Sketch(80)
        entries = [sketch.entries(x).view(np.int64).tolist() for x in sets]
        columns = {"hub": [0] * n, "row": range(n), "n": [len(x) for x in sets], "entries": entries, "block": [k % 2 for k in range(n)], "across": [bool(blocks)] * n}
        make = lambda data: jaccard.Meeting(pa.table({**{k: list(v) for k, v in columns.items()}, "data": data}), 80)  # noqa: E731, B023
        hopeful = set(jaccard._hopeful(make([jaccard.whole_sketch(x) for x in sets]))[:, 1].tolist())
        links = jaccard._forest(make([x.tobytes() for x in sets])).tolist()
        assert len(links) < n
        expected = {k: c for k, (_, c) in brute(sets_of(rows, 5), 80).items()}
        found = {k: k for k in range(n)}
        for a, b in links:
            assert {a, b} <= hopeful
            x, y = sorted((found[a], found[b]))
            found = {k: x if c == y else c for k, c in found.items()}
        if not blocks:
            assert found == expected
        else:
            inside = {(expected[a], a % 2) for a, _ in rows}
            assert all(expected[a] == expected[b] and a % 2 != b % 2 for a, b in links) and inside


def test_large_meetings_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20_000)
    rows = near_copies(150, 3, 200, 1) + [(150 + k, text) for k, text in near_copies(40, 4)]
    got = {d: (n, c) for d, n, c in run(spark, rows, 5, 80)}
    assert got == brute(sets_of(rows, 5), 80)


def test_one_id_with_many_texts_and_rows_without_id(spark):
    """A third of the rows under one id, a third without: every one links by its own text."""
    texts = [text for _, text in near_copies(40, 8, 90, 2)]
    rows = [(7, text) for text in texts[:20]] + [(None, text) for text in texts[20:]] + [(100 + k, text) for k, text in enumerate(texts[10:30])]
    got = run(spark, rows, 4, 85)
    numbered = {k: text for k, (_, text) in enumerate(rows)}
    plain = brute(sets_of(numbered.items(), 4), 85)
    group = {}
    for k in numbered:  # one id is one document
        group.setdefault(plain[k][1], set()).add("id7" if rows[k][0] == 7 else k)
    merged = []
    for own in group.values():
        same = [g for g in merged if g & own]
        merged = [g for g in merged if not g & own] + [own.union(*same)]
    least = {}
    for own in merged:
        ids = [7 if k == "id7" else rows[k][0] for k in own]
        for k in own:
            least[k] = min((i for i in ids if i is not None), default=None)
    expected = sorted(((rows[k][0], plain[k][0], least["id7" if rows[k][0] == 7 else k]) for k in numbered), key=str)
    assert sorted(got, key=str) == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 61)} | {(i, 100) for i in (100, 150, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_of_one_id_link(spark):
    x, y = "a b c d e f g h", "q r s t u v w z"
    rows = [(3, x), (5, x), (5, y), (12, y), (20, "k l m n o p")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (12, 3), (20, 20)]
