"""Wu-Manber search against a plain search for every window."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from actiloom.llm import decontam, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width):
    strings = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                strings.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(s) for s in strings}:
            for i in range(len(w) - m + 1):
                if (s := tuple(w[i : i + m])) in strings:
                    hit.update(range(i, i + m))
                    found |= strings[s]
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def run(spark, docs, items, width, most=decontam.PASS_CHARS):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit("a"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    rows = decontam.benchmark_hits(d, b, width, most).collect()
    return sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] for s in r.spans), tuple(r.items)) for r in rows), key=str)


def test_random_words(spark):
    random.seed(3)
    for width in (1, 2, 3, 10):
        alphabet = ["a", "B", "b1", "é", "cc", "d"]
        text = lambda n: random.choice([" ", ", ", "\n"]).join(random.choices(alphabet, k=n))
        items = [(i % 9, text(random.choice([1, 2, 5, 9, 10, 11, 14]))) for i in range(12)] if width > 1 else [(1, "cc"), (2, "x d")]
        docs = [(i, text(random.choice([0, 3, 9, 10, 40, 700]))) for i in range(30)]
        for item, passage in items[:6]:
            docs.append((100 + item, text(20) + " " + passage.upper() + " " + text(300)))
        assert run(spark, docs, items, width) == brute(docs, items, width)
        assert run(spark, docs, items, width, most=20) == brute(docs, items, width)


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "..."), (None, item), (4, item), (4, item), (5, "x " * 50_000 + item), (6, "short One")]
    items = [(10, item), (9, item), (None, item), (7, None), (8, "!"), (11, "short one")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)
    assert run(spark, docs, [], 10) == brute(docs, [], 10)
    assert run(spark, [], items, 10) == []
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    kept = decontam.clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_query(spark):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    expected = {}
    for d, n, h, items in brute([(r[0], r[1]) for r in read("documents")], read("benchmark"), 10):
        ids = ",".join(sorted(map(str, items)))
        expected[d] = (n, h, len(items), hashlib.sha256(ids.encode()).hexdigest(), h > 0)
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()}
    assert got == expected
    assert any(x[4] for x in got.values())
