"""URL rules, licences, languages, quality, sharding and top-k on small and odd inputs."""

import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from actiloom.llm import language, licence_forms, licenses, quality, queries, sharding, topk, urls

SF = "/root/testdata/sf0.001"
RULES = [urls.parse_rule(line) for line in queries.URL_RULES]


def judged(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls(spark):
    odd = [
        None, "", "org/", "http://", "http://org", "http://ORG/", "x://a.Example.ORG/es/1", "http://example.org/en/12?x", "http://notexample.org/en/1",
        "http://anorg/", "http://b.com/fr/", "http://com/de/#x", "http://a.com/de", "http://.org/x", "http://é.org/\n/", "a://b://c.org/", "http://org:80/",
    ]
    rows = [(i, u) for i, u in enumerate(odd)] + [(5, odd[5]), (None, "http://org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("h")).withColumn("key_a", F.lit(1))
    got = sorted((tuple(r) for r in urls.judge(pages, RULES).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u in rows), key=str)
    assert urls.judge(pages, []).filter("rule is not null").isEmpty()
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(6000).select(F.xxhash64("id").alias("key_a"), F.xxhash64("id", F.lit(1)).alias("key_b"), "id")
    listed = keys.filter("id % 50 = 0").select("key_a", "key_b")
    cascade = urls.build(listed, keys.select("key_a", "key_b"))
    rows = keys.orderBy("id").toArrow()
    flat = np.stack([rows[c].to_numpy().view(np.uint64) for c in ("key_a", "key_b")], axis=1)
    assert len(cascade.levels) > 1
    assert (cascade.has(flat) == (np.arange(6000) % 50 == 0)).all()


def test_licences(spark):
    plain = {text: name for name, text in licenses.TEMPLATES.items()}
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").collect())]
    known = {(i, plain[line.strip()]) for i, text in rows for line in text.split("\n") if line.strip() in plain}
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "template").collect()]
    assert known and known <= set(got)
    odd = [
        (1, None), (2, ""), (3, "A license is a word."), (4, "x " * 60_000 + "\nReleased under the MIT Licence!\n" + "y " * 9),
        (4, "Licensed under CC BY-SA 4.0."), (None, "All rights reserved."), (5, "Licensed under CC BY 4.0. All rights reserved."),
        (6, "This work is licensed under the GNU General Public License, version 2."),
    ]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("template", F.lit(1))
    got = {(r.doc_id, r.template): (r.missing, r.added) for r in licenses.scan(frame).collect()}
    assert got[4, "mit"] == (["license"], ["licence"]) and got[6, "gpl-2.0"] == ([], [])
    assert got[4, "cc-by-sa-4.0"] == ([], []) and (None, "all-rights-reserved") in got
    assert not {k for k in got if k[0] in (1, 2, 3)}
    assert licenses.scan(frame.limit(0)).count() == 0


def test_licences_compare_every_template(spark):
    rows, cases = [], {}
    for name, text in licenses.TEMPLATES.items():
        for said in (text, text.lower(), text.upper()):
            cases[len(rows)] = name
            rows.append((len(rows), said))
    words = {name: [w.lower() for w in licenses._WORD.findall(text)] for name, text in licenses.TEMPLATES.items()}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        said = [w.lower() for w in licenses._WORD.findall(text[got[i].first : got[i].last])]
        brute = min((sum(map(len, licenses.differences(t, said))), name) for name, t in words.items())
        assert got[i].template == cases[i] == brute[1] and len(got[i].missing) + len(got[i].added) == brute[0]


def test_licences_beside_each_other(spark):
    both = "Licensed under CC BY 4.0. All rights reserved."
    texts = [
        both,
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        "Released under the MIT License.\nAll rights reserved.\n\nReleased under the MIT License.",
        "A licence. " + "All rights reserved.\n" * 900,
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "licensed under a CC licence by 4.0",
        "x " * 8189 + "Released under the MIT License. " + "y " * 90_000 + "All rights reserved.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(licenses.scan(frame, licenses.TEMPLATES).collect(), key=lambda r: (r.doc_id, r.first)):
        got.setdefault(r.doc_id, []).append((texts[r.doc_id][r.first : r.last], r.template, r.missing, r.added))
    assert got[0] == [(both[:25], "cc-by-4.0", [], []), (both[26:], "all-rights-reserved", [], [])]
    assert [x[1] for x in got[1]] == ["mit", "apache-2.0"] and all(x[2:] == ([], []) for x in got[1])
    assert [x[1] for x in got[2]] == ["mit", "all-rights-reserved", "mit"]
    assert [x[1] for x in got[3]] == ["all-rights-reserved"] * 900
    assert got[4] == [(texts[4], "mpl-2.0", [], [])]
    assert got[5] == [(texts[5], "cc-by-4.0", [], ["a", "licence"])]
    assert [x[:2] for x in got[6]] == [("Released under the MIT License.", "mit"), ("All rights reserved.", "all-rights-reserved")]


def brute_differences(template, words):
    """The fewest differing words and, of those spans, the fewest missing words, over all spans."""
    row = [(0, 0)] * (len(words) + 1)
    for t in template:
        below = [(row[0][0] + 1, row[0][1] + 1)]
        for j, w in enumerate(words):
            (a, b), (c, d) = row[j], row[j + 1]
            below.append(min((a, b) if t == w else (a + 1, b + 1), (c + 1, d + 1), (below[j][0] + 1, below[j][1])))
        row = below
    return row


def test_licence_forms(spark):
    wrapped = licence_forms.TEXTS["apache-2.0"][0].replace("Version 2.0", "\n * Version 2.0")
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + licence_forms.TEXTS["mit"][0].replace("conditions: ", "conditions:\n\n").replace(". THE", ".\n\nTHE")
    said = {
        "This project is licensed under the MIT license.": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "# spdx-license-identifier: GPL-3.0-or-later": "gpl-3.0",
        "SPDX-License-Identifier: LGPL-3.0-only": "lgpl-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd-4.0",
        "Licensed under the Apache License,\nVersion 2.0.": "apache-2.0",
        "This library is distributed under the GNU Lesser General Public License v3": "lgpl-3.0",
        wrapped: "apache-2.0",
        mit: "mit",
        licence_forms.TEXTS["gpl-3.0"][0].replace(" either", "\n# either"): "gpl-3.0",
        licence_forms.TEXTS["agpl-3.0"][0]: "agpl-3.0",
        licence_forms.TEXTS["bsd-2-clause"][0]: "bsd-2-clause",
        licence_forms.TEXTS["bsd-3-clause"][0].upper(): "bsd-3-clause",
        licence_forms.TEXTS["gpl-2.0"][2].upper(): "gpl-2.0",
        "This project is licensed under the ISC license.": None,
        "SPDX-License-Identifier: CC-BY-3.0": None,
    }
    for licence, text, _ in licence_forms.forms():
        said |= {x: licence for x in (text, text.lower(), text.upper(), text.replace(" ", "\n"))}
    texts = list(said)
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        assert [r.template for r in got.get(i, [])] == ([said[text]] if said[text] else []), text
    # No template has a closer span or more words in common than the one reported.
    matcher = licenses.Matcher()
    random.seed(4)
    pool = [*list(said)[:8], "some other words", "all rights", *(random.choice(matcher.templates).words and " ".join(random.choice(matcher.templates).words[:12]) for _ in range(8))]
    for _ in range(25):
        text = " ".join(random.sample(pool, 3)) + " copyright"
        words = [w.lower() for w in licenses._WORD.findall(text)]
        codes = np.array([matcher.codes.get(w, -1) for w in words])
        for t in random.sample(matcher.templates, 12):
            if t.possible(licenses.Counter(codes.tolist())):
                row = t.ends(codes)
                assert [(int(x) // licenses.DIFFERS, int(x) % licenses.DIFFERS // licenses.MISSING) for x in row] == brute_differences(t.words, words)
        for first, last, name, _, missing, added in matcher.notices(text):
            span = [w.lower() for w in licenses._WORD.findall(text[first:last])]
            assert any(len(t.words) - len(missing) == len(span) - len(added) for t in matcher.templates if t.name == name)


def test_compression_ranks_licences(monkeypatch):
    given = {
        "long": "Permission to use and copy this work for any purpose is licensed free of charge to every person.",
        "short": "any purpose is licensed free",
    }
    text = "Permission to use and copy this thing for any purpose is licensed free of charge to every person."
    matcher = licenses.Matcher(given)
    assert [(x[2], x[4], x[5]) for x in matcher.notices(text)] == [("long", ["work"], ["thing"])]
    # By wording alone the short one, which does not differ at all, would be told.
    monkeypatch.setattr(licenses.Matcher, "reduction", lambda *_: 1)
    assert licenses.Matcher(given).notices(text)[0][2] == "short"
    # What no template compresses is no notice, whatever its words.
    monkeypatch.setattr(licenses.Matcher, "reduction", lambda *_: 0)
    assert licenses.Matcher().notices("Released under the MIT License.") == []


def test_licence_ranking_by_brute_force():
    """In each block the winner is the most reducing of all templates that any span of the block confirms."""
    matcher = licenses.Matcher(licenses.TEMPLATES)
    alone = zstandard.ZstdCompressor(level=licenses.LEVEL)
    random.seed(9)
    for _ in range(30):
        said = random.choice(list(licenses.TEMPLATES.values())).split()
        said[random.randrange(len(said))] = random.choice(["other", "the", "4.0.", "BY", said[0]])
        text = "copyright " + " ".join(said)
        words = [w.lower() for w in licenses._WORD.findall(text)]
        codes = np.array([matcher.codes.get(w, -1) for w in words], np.int64)
        markers = [(k, k + 1) for k, w in enumerate(words) if licenses._MARKER.search(w)]
        for begin, end in matcher._blocks(codes, markers, 0, len(words)):
            raw, best = " ".join(words[begin:end]).encode(), []
            for place, t in enumerate(matcher.templates):
                given = zstandard.ZstdCompressionDict(" ".join(t.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=given).compress(raw))
                spans = [(i, j) for i in range(begin, end) for j in range(i + 1, end + 1) if any(i <= a and b <= j for a, b in markers)]
                told = [whole_differences(t.words, words[i:j]) for i, j in spans]
                told = [x for x in told if x[1] <= t.most and x[0] <= len(t.words)]
                if told and size < len(alone.compress(raw)):
                    best.append((size, min(told)[0], place))
            found = matcher._winner(codes, words, markers, begin, end)
            assert [x[2] for x in found[:1]] == [x[2] for x in sorted(best)[:1]], text


def whole_differences(template, words):
    """Differing and missing words of a whole span, the fewest."""
    row = [(k, 0) for k in range(len(words) + 1)]
    for n, t in enumerate(template):
        below = [(n + 1, n + 1)]
        for j, w in enumerate(words):
            (a, b), (c, d) = row[j], row[j + 1]
            below.append(min((a, b) if t == w else (a + 1, b + 1), (c + 1, d + 1), (below[j][0] + 1, below[j][1])))
        row = below
    return row[-1]


def test_licence_expressions(spark):
    said = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["mit", "apache-2.0"],
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": ["mit", "apache-2.0", "bsd-3-clause"],
        "License: GPL-2.0+ WITH Classpath-exception-2.0": ["gpl-2.0"],
        "License: BSD-3-Clause": ["bsd-3-clause"],
        '"license": "MIT"': ["mit"],
        "Dual-licensed under MIT or Apache-2.0.": ["mit", "apache-2.0"],
        "MIT licensed.": ["mit"],
        "(c) 2020 Foo. All rights reserved. Apache License, Version 2.0": ["all-rights-reserved", "apache-2.0"],
        "License: MIT\nLicense: MIT": ["mit", "mit"],
        "License: The thing is licensed under the ISC license, says well licensed counsel.": [],
    }
    texts = list(said)
    frame = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in sorted(licenses.scan(frame).collect(), key=lambda r: (r.doc_id, r.first)):
        got.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):  # equal rows give equal notices each
        assert [r.template for r in got.get(k, [])] == [x for x in said[text] for _ in range(2)], text
        spans = sorted({(r.first, r.last) for r in got.get(k, [])})
        assert len(spans) == len(said[text]) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_language(spark):
    got = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    train = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "und die und " * 40_000), (4, "the"), (None, "the"), (5, "²½")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(0))
    rows = [(r.doc_id, r.lang_pred) for r in language.identify(docs, train).collect()]
    assert rows == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en"), (None, "en"), (5, "und")]
    kept = language.identified(docs, train)
    assert kept.columns == docs.columns and kept.count() == 3
    assert {r.lang_pred for r in language.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), train).count() == 0
    # With nothing learnt the texts with a letter stay.
    assert sorted(r.text for r in language.identified(docs, train.limit(0)).collect()) == sorted(["und die und " * 40_000, "the", "the"])


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    """A repeated id or row does not take the sample beyond its bound, nor is it in whole or out whole."""
    rows = [(1, f"der die das {k}", "de", 1) for k in range(600)] + [(2, "the and of", "en", 0)] * 600 + [(None, "le la", "fr", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    model = language.fit(docs, rows=100)
    assert len(model.languages) <= 3 and 0.1 < np.exp(model.prior).max() <= 1
    whole = language.fit(docs)
    assert np.allclose(np.exp(whole.prior) * 602, [600, 1, 1])
    seen = []
    monkeypatch.setattr(quality, "boost", lambda values, labels: seen.append(labels))
    labels = docs.select("doc_id", "quality")
    quality.fit(docs, labels, rows=100)
    quality.fit(docs, labels)
    assert 50 < len(seen[0]) < 150 and len(seen[1]) == 601


def test_held_out_is_never_null(spark, tmp_path):
    docs = [(None, "the and", "en"), (1, "der die", "de"), (2, "the of", "en"), (5, "das und", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op5_language_id", "op9_quality"):
        assert {r.held_out for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} <= {True, False}


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op9_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    odd = [(1, None), (2, ""), (3, "\n\n"), (4, "w " * 90_000), (4, "w"), (None, "w")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumn("quality", F.lit("q"))
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 7)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(docs, docs, marks).collect()]
    assert len(scores) == 6 and all(0 <= x <= 1 for x in scores)
    assert {r.score for r in quality.score(docs, docs, marks.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, docs, marks, 0.0).columns == docs.columns
    assert quality.score(docs.limit(0), docs, marks).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(1)
    rows = rng.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.3)).astype(float)
    forest = quality.boost(rows[:2000], labels[:2000])
    assert ((forest.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.97


def test_sharding(spark):
    random.seed(8)
    rows = [(i, "x" * random.randrange(200)) for i in range(400)] + [(7, "same")] * 120 + [(None, "é" * 50), (None, None), (9, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix", F.lit(1)).withColumn("h0", F.lit(2))
    got = sharding.shards(docs, 100).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len((t or "").encode())) for d, t in rows)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.n_bytes)
        assert r.depth == len(r.shard)
    assert all(sum(x) <= 100 or len(x) == 1 for x in held.values())
    assert not any(a != b and b.startswith(a) for a in held for b in held)
    assert all((sum(held[r.shard]), len(held[r.shard])) == (r.shard_bytes, r.shard_rows) for r in got)
    assert {r.shard for r in sharding.shards(docs, 10**9).collect()} == {""}
    assert sharding.shards(docs.limit(0), 100).count() == 0
    # Rows without text are split too, by their number where they are alike.
    bare = spark.createDataFrame([(3, None)] * 700 + [(None, "")] * 300, "doc_id long, text string")
    assert max(r.shard_rows for r in sharding.shards(bare, 100).collect()) <= 100


def test_later_directories_are_not_broadcast(spark):
    """Only the directory of the first bits, of bounded size, may go through the driver."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('x', 60) as text")
    placed = sharding.shards(docs, 100)
    assert placed.agg(F.max("depth")).first()[0] > sharding.ROUND_BITS  # two rounds at least
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) > 1 and sum("rightHint=(strategy=merge)" not in line for line in joins) == 1
    assert placed._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1


def test_written_shards(spark, tmp_path):
    rows = [(i, "x" * (i % 150), "s") for i in range(300)] + [(7, f"same {k % 3}", None) for k in range(200)]
    rows += [(None, "é" * (k % 40), str(k)) for k in range(150)] + [(None, None, "n"), (9, "y" * 500, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("nth", F.lit(1))
    directory = sharding.write_shards(docs, 100, str(tmp_path / "out")).collect()
    schema = "doc_id long, text string, shard string, nth int, shard_ string"
    back = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    held = {}
    for r in back.collect():
        held.setdefault(r.shard_, []).append(len((r.text or "").encode()))
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.text, r.shard)) for r in back.collect())
    assert all(sum(x) <= 100 or len(x) == 1 for x in held.values())
    assert {r.shard: (r.shard_bytes, r.shard_rows) for r in directory} == {k: (sum(x), len(x)) for k, x in held.items()}
    assert len(directory) == len(held)
    sharding.write_shards(docs.drop("shard"), 10**9, str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == len(rows)


def brute_top(rows, k, every):
    valid = [(i, [np.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size, out = max((len(v) for _, v in valid), default=0), set()
    valid = [(i, np.array(v + [0.0] * (size - len(v)))) for i, v in valid]
    for q, x in valid:
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in valid if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k(spark, monkeypatch):
    random.seed(9)
    monkeypatch.setattr(topk, "PAGE", 40)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "NODE", 6)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 420)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8)]
    rows += [(550, []), (551, [2.0, 1.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("s")).withColumn("page", F.lit(0))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in topk.top_k(frame, 5, 10).collect()} == brute_top(rows, 5, 10)
    assert topk.top_k(frame.limit(0), 5, 10).count() == 0
    few = frame.filter("vec_id in (0, 1, 2)")
    assert topk.top_k(few, 5, 10).count() == 2
    assert topk.top_k(frame.filter("vec_id between 500 and 503 or vec_id is null"), 5, 10).count() == 0
    # A repeated id, its rows alike or not, spreads over pages and copies.
    hot = [(10, [float(i % 7), 1.0]) for i in range(200)] + [(10, [2.0, 2.0])] * 200 + [(i, [float(i % 5), -1.0]) for i in range(11, 90)]
    found = topk.top_k(spark.createDataFrame(hot, "vec_id long, embedding array<float>"), 5, 10)
    # The best of all rows of an id, each pair of candidate and score once.
    best = {q: sorted({(-s, i) for own, _, i, s in brute_top(hot, len(hot), 10) if own == q})[:5] for q in (10, *range(20, 90, 10))}
    assert {tuple(r) for r in found.collect()} == {(q, n + 1, i, -s) for q, own in best.items() for n, (s, i) in enumerate(own)}


def test_pages_hold_what_they_should(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 50)
    random.seed(2)
    rows = [(0, 3.0)] * 500 + [(1, random.random()) for _ in range(1000)] + [(2, 1.0)]
    rings = topk._rings(spark.createDataFrame(rows, "cell long, far double"))
    assert rings[0]["parts"].tolist() == [10] and rings[2]["parts"].tolist() == [1]
    near, far = rings[1]["near"], rings[1]["far"]
    assert 20 <= len(near) <= 25 and (far[:-1] < near[1:]).all() and (rings[1]["parts"] <= 2).all()
    pages = sorted(p for r in rings.values() for a, n in zip(r["first"], r["parts"]) for p in range(a, a + n))
    assert pages == list(range(len(pages)))


def test_tree_search_is_exact():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c * 9, 0.3, (400, 3)) for c in range(10)])
    largest = float((points**2).sum(axis=1).max())
    tree = topk.MTree(topk._points(points, largest), np.arange(len(points)))
    for q in points[::400]:
        found = tree.search(q, -1, 5, float((q**2).sum()) + largest, -np.inf)
        assert np.allclose([x[0] for x in found], np.sort(points @ q)[::-1][:5])
