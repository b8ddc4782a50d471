"""Merkle manifest, lexical search and byte-level BPE against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from actiloom.llm import bytepiece, lexical, merkle, queries

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = [
    "", " ", "  a", "a  b", "a \n b", "it's 's I'LL", "x\x1cy \x1f z", "\0a b", "é é ́x", "日本 語  x 1²½", "<|endoftext|> a", "\t\ta", "a 　b\u0085c d",
    "a" * 3000, "ab" * 2000 + " é", " " * 300 + "x", "\U0001f600\U0001f468‍\U0001f469 z", None,
]


# Byte-level BPE


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytepiece.read_ranks(RANKS), special_tokens={}).encode_ordinary


@pytest.mark.parametrize("kept", [0, 30, 100_000])
def test_codec(kept):
    random.seed(4)
    texts = ODD + ["".join(random.choices(["a", "The", "'", " ", "\n", "é", "7", "　", "'s", "漢", "…"], k=40)) for _ in range(300)]
    codec, plain = bytepiece.Codec(RANKS, PATTERN, kept), library()
    for at in [*range(0, len(texts), 40), 0]:
        some = texts[at : at + 40]
        for text, ids in zip(some, codec.encode(some), strict=True):
            assert ids.tolist() == plain(text or ""), text
            assert codec.decode(ids) == (text or "").encode()


def test_every_vocabulary_entry_and_byte():
    codec, ranks = bytepiece.Codec(RANKS, PATTERN), bytepiece.read_ranks(RANKS)
    assert all(codec.decode(np.array([rank])) == piece for piece, rank in ranks.items())
    plain = library()
    for piece in random.Random(1).sample(sorted(ranks), 3000):
        text = piece.decode(errors="ignore")
        assert codec.encode([text])[0].tolist() == plain(text)
    with pytest.raises(ValueError):
        bytepiece.model_bytes([b"a", b"b"])


def test_vocabulary_entry_that_merges_do_not_reach():
    """The library takes a whole pre-token from the vocabulary before it merges."""
    pieces = [bytes([b]) for b in range(256)] + [b"bc", b"abcd"]
    codec = bytepiece.Codec.__new__(bytepiece.Codec)
    import sentencepiece

    codec.places = {piece: k + 1 for k, piece in enumerate(pieces)}
    codec.id_of = np.arange(len(pieces), dtype=np.uint32)
    codec.model = sentencepiece.SentencePieceProcessor(model_proto=bytepiece.model_bytes(pieces))
    plain = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={}).encode_ordinary
    for text in ("abcd", "abcdx", "bcbc", "aabcdd"):
        assert codec.merge([text])[0].tolist() == plain(text)


def test_byte_bpe_query(spark):
    plain, docs = library(), spark.read.parquet(f"{SF}/documents.parquet")
    expected = Counter()
    for row in docs.collect():
        ids = np.array(plain(row.text or ""), "<u4").tobytes()
        own = hashlib.sha256(ids).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()
        expected[row.doc_id, len(ids) // 4, *own] += 1
    found = queries.QUERIES["op13_byte_bpe"](spark, SF)
    assert Counter(map(tuple, found.collect())) == expected


def test_byte_bpe_edges(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    found = bytepiece.decode(bytepiece.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in found) == [(0, b"c"), (1, b"a b"), (1, b"a b"), (2, b""), (3, b"")]
    assert bytepiece.encode(df.limit(0), RANKS, PATTERN).count() == 0


# Merkle manifest


@pytest.mark.parametrize("levels", range(1, 12))
def test_layout(levels):
    places = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << levels) - 1))
    # A subtree at half the height lies together, and is laid out the same way.
    upper = levels // 2
    for i in range(1 << upper if levels > 1 else 0):
        own = np.concatenate([places[upper + d][i << d : (i + 1) << d] for d in range(levels - upper)])
        assert own.max() - own.min() + 1 == len(own) == (1 << (levels - upper)) - 1
        inner = np.concatenate([merkle.address(levels - upper, d, np.arange(1 << d)) for d in range(levels - upper)])
        assert (own - own.min()).tolist() == inner.tolist()


def digest(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_leaf(row):
    doc_id, source, lang, n_chars, text = row
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def plain_tree(leaves):
    """The root, and for each leaf (sibling or None, whether the sibling is on the left) from below."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for way, k in zip(ways, at, strict=True):
            way.append((level[k ^ 1] if k ^ 1 < len(level) else None, bool(k & 1)))
        level = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda lang: b"" if lang is None else b"=" + lang.encode())
    trees = {}
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = own, *plain_tree([plain_leaf(r) for r in own])
    root, above = plain_tree([trees[lang][1] for lang in langs])
    out = []
    for lang, way_on in zip(langs, above, strict=True):
        own, subroot, ways = trees[lang]
        for row, way in zip(own, ways, strict=True):
            doc_id, source, _, n_chars, text = row
            altered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            node = plain_leaf((doc_id, source, lang, n_chars + 1, text)) if altered else plain_leaf(row)
            for other, left in way + way_on:
                node = digest(node) if other is None else digest(other, node) if left else digest(node, other)
            proof = digest(*(other for other, _ in way + way_on if other is not None))
            out.append((doc_id, plain_leaf(row), subroot, root, proof, node, node == root))
    return out


def found_manifest(df, height):
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("long")
    made = merkle.manifest(df, later={"n_chars": F.when(altered, n_chars + 1).otherwise(n_chars)}, height=height)
    rows = merkle.proofs(made, height).collect()
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, digest(r.others), r.folded_root, r.folded_root == r.root) for r in rows)


def test_manifest_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    found = queries.QUERIES["op11_merkle_manifest"](spark, SF).collect()
    assert Counter(map(tuple, found)) == Counter(plain_manifest([tuple(r) for r in rows]))
    # Exactly the altered documents fail.
    assert {r.doc_id for r in found if not r.verified} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_of_many_tiers(spark, height):
    random.seed(height)
    rows = [(k, "s", random.choice(["de", "de", "de", "fr", None, "", "é", "z"]), random.choice([None, k]), random.choice([None, "", "é" * k])) for k in range(90)]
    rows += [(None, None, "de", None, None), (None, "x", "de", 3, "t"), (7, "s", "de", 1, "same"), (7, "s", "de", 1, "same"), (-5, "s", "lone", 2, "a")]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.repartition(5).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("rank", F.lit(0))
    assert found_manifest(df, height) == Counter(plain_manifest(rows))


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(1, "s", "de", 4, "text")]
    assert found_manifest(spark.createDataFrame(one, schema), 2) == Counter(plain_manifest(one))
    made = merkle.manifest(spark.createDataFrame([], schema))
    assert made.root is None and merkle.proofs(made).count() == 0


# Lexical search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    own = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    own = [(doc_id, terms) for doc_id, terms in own if terms]
    n_docs, length = len(own), sum(sum(terms.values()) for _, terms in own)
    df = Counter(term for _, terms in own for term in terms)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, terms in own:
            m = 25 + 75 * sum(terms.values()) * n_docs // length
            score = 0
            for term in plain_terms(text):
                if tf := terms[term]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1)]
    return out


def some_texts(n, seed, words=120):
    """Texts of a few topics, some copied, some with common words only."""
    rng = random.Random(seed)
    topics = [[f"w{rng.randrange(words)}" for _ in range(25)] for _ in range(6)]
    texts = [" ".join(rng.choices(rng.choice(topics) + ["The", "of"] * 5, k=rng.randrange(1, 60))) for _ in range(n)]
    return texts + [rng.choice(texts) for _ in range(n // 3)]


@pytest.mark.parametrize("portion", [1 << 20, 500])
def test_search(spark, portion):
    docs = [(k % 200, text) for k, text in enumerate(some_texts(300, 1))] + [(None, "w1 w2 w3"), (900, None), (901, ""), (902, "... !"), (903, "É é Ω w1")]
    items = [(k, text) for k, text in enumerate(some_texts(25, 2))] + [(5, "w1 W1 w1"), (None, "w2 É"), (70, None), (71, "nothing_like_it"), (72, "the of")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).withColumn("n", F.lit("x")).withColumn("terms", F.lit(0))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("nth", F.lit(0))
    found = lexical.search(df, asked, 10, portion).collect()
    assert Counter(map(tuple, found)) == Counter(plain_search(docs, items, 10))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for some, asked in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit(None)), items)):
        assert lexical.search(some, asked).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_bound_their_documents_and_skip():
    texts = some_texts(900, 3)
    words = lexical.words_of(pa.array(texts), lexical.LETTERED)
    vocabulary, places = np.unique(words.hashes, return_inverse=True)
    rows = [np.unique(places[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    ptr = np.cumsum([0, *(len(t) for t, _ in rows)])
    vectors = lexical.Vectors(ptr, np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows]) * 100_000)
    weights = np.random.default_rng(1).integers(1, 3000, len(vocabulary))
    blocks = lexical.Blocks(vectors, weights, block=8)
    assert sorted(blocks.order.tolist()) == list(range(len(texts)))
    assert len(blocks.docs) == len(vectors.term) and (blocks.stop - blocks.start).max() <= 8
    scored, ids = 0, np.arange(len(texts))
    for item in range(0, len(texts), 10):
        terms, repeats = rows[item]
        coefficients = np.zeros(len(vocabulary), np.int64)
        coefficients[terms] = repeats * weights[terms]
        exact = blocks.vectors.scores(ids, coefficients)
        for term in terms.tolist():
            bounds = blocks.bounds(term, coefficients)
            for bound, b in zip(bounds, range(blocks.first[term], blocks.first[term + 1]), strict=True):
                assert bound >= exact[blocks.docs[blocks.start[b] : blocks.stop[b]]].max()
        found, scores, n = blocks.search(terms, coefficients, ids, 10, 0)
        best = np.lexsort((ids, -exact))[:10]
        assert found.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
        scored += n
        found, _, _ = blocks.search(terms, coefficients, ids, 10, int(exact[best[3]]))
        assert set(best[:4].tolist()) <= set(found.tolist())
    lists = sum(blocks.first[t + 1] - blocks.first[t] for item in range(0, len(texts), 10) for t in rows[item][0])
    assert scored < lists / 4
