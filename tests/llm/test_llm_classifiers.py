"""Both classifiers against plain versions: loops over characters, split candidates and tree nodes."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from actiloom.llm import language, quality

SF = "/root/testdata/sf0.001"
FACTORS = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
WORD = 1 << 32


def plain_grams(text):
    """Buckets of all 1- to 3-grams; a gram that runs beyond the text is filled up with spaces."""
    counts = Counter()
    codes = [ord(c) for c in text.lower()]
    for at in range(len(codes)):
        total = 0
        for k in range(3):
            total = (total + (codes[at + k] if at + k < len(codes) else ord(" ")) * FACTORS[k]) % WORD
            counts[((total ^ total >> 15) * (0x2C1B3C6D + 2 * k) % WORD) >> 18] += 1
    return counts


def plain_bayes(training, texts):
    grams, documents = defaultdict(Counter), Counter()
    for text, lang in training:
        documents[lang] += 1
        grams[lang].update(plain_grams(text))
    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        own, logs, prior = plain_grams(text), {}, {}
        for lang, counts in grams.items():
            total = sum(counts.values()) + 0.5 * 2**14
            logs[lang] = sum(n * math.log((counts[b] + 0.5) / total) for b, n in own.items())
            prior[lang] = math.log(documents[lang] / sum(documents.values()))
        best = min(logs, key=lambda lang: (-(logs[lang] + prior[lang]), lang))
        share = min(1, 40 / sum(own.values()))
        shown = {lang: logs[lang] * share + prior[lang] for lang in logs}
        out.append((best, 1 / sum(math.exp(v - shown[best]) for v in shown.values())))
    return out


def test_language_is_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = sorted(docs.collect())[:120]
    rows = [(r.doc_id, (r.text or "")[:400] if r.text is not None else None, r.lang) for r in rows]
    rows += [(9001, "", None), (9002, "12 ... !", "en"), (9003, "É", None), (9004, "x", "fr"), (9005, None, "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = [(text, lang) for _, text, lang in rows if text is not None and lang is not None]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame, frame).collect()}
    for (doc_id, text, _), (lang, score) in zip(rows, plain_bayes(training, [text for _, text, _ in rows]), strict=True):
        assert found[doc_id][0] == lang, text
        assert found[doc_id][1] == pytest.approx(score, abs=2e-3)


def plain_score(forest, row):
    total = forest.base
    for node in forest.roots.tolist():
        while forest.child[node] >= 0:
            node = int(forest.child[node]) + (row[forest.feature[node]] > forest.threshold[node])
        total += forest.value[node]
    return 1 / (1 + math.exp(-total))


def plain_split(rows, gradient, curvature, edges):
    """The best (gain, feature, cut) over every feature and every edge, the first of equal ones."""
    best = (1e-6, None, None)
    whole = gradient.sum() ** 2 / (curvature.sum() + 1)
    for f, own in enumerate(edges):
        for cut, edge in enumerate(own.tolist()):
            left = rows[:, f] <= edge
            if min(left.sum(), (~left).sum()) < quality.LEAST:
                continue
            gain = -whole + sum(gradient[side].sum() ** 2 / (curvature[side].sum() + 1) for side in (left, ~left))
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


def test_trees_are_the_plainly_searched_ones():
    """Every node of the first trees splits where a search of all thresholds does; flat arrays score as the trees do."""
    rng = np.random.default_rng(5)
    rows = np.stack([rng.normal(size=500), rng.integers(0, 4, 500).astype(float), rng.exponential(size=500)], axis=1)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 1] > 1) | (rng.random(500) < 0.1)).astype(float)
    forest = quality.boost(rows, labels)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, quality.BINS)[1:-1])) for column in rows.T]
    raw = np.full(len(rows), forest.base)
    for root in forest.roots[:3].tolist():
        p = 1 / (1 + np.exp(-raw))
        gradient, curvature = labels - p, p * (1 - p)
        step = np.zeros(len(rows))

        def grow(node, own, depth, gradient=gradient, curvature=curvature, step=step):
            g, h = gradient[own], curvature[own]
            gain, f, cut = plain_split(rows[own], g, h, edges) if depth < quality.DEPTH and len(own) >= 2 * quality.LEAST else (0, None, None)
            child = int(forest.child[node])
            assert (child < 0) == (f is None)
            if f is None:
                assert forest.value[node] == pytest.approx(quality.RATE * g.sum() / (h.sum() + 1))
                step[own] = forest.value[node]
                return
            right = rows[own, f] > edges[f][cut]
            same = rows[own, int(forest.feature[node])] > forest.threshold[node]
            # Another split may gain as much to the last digit.
            other = sum(g[side].sum() ** 2 / (h[side].sum() + 1) for side in (same, ~same)) - g.sum() ** 2 / (h.sum() + 1)
            assert other == pytest.approx(gain) and len(right) == len(same)
            grow(child, own[~same], depth + 1)
            grow(child + 1, own[same], depth + 1)

        grow(root, np.arange(len(rows)), 0)
        raw += step
    fresh = rng.normal(size=(200, 3)) * 2
    assert forest.score(fresh) == pytest.approx([plain_score(forest, row) for row in fresh])
    assert np.mean((forest.score(rows) > 0.5) == labels) > 0.9
