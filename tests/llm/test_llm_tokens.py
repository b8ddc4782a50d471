"""Encoder, packing and token files against the library run on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from actiloom.llm import packing, queries, tokenfile
from actiloom.session import scratch_path
from actiloom.llm.encoder import DROPPED, LEADING, Encoder

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "  a", "a  b", "a \n b", "a\n\nb ", "it's  'tis I'll", " 's", "x\x1cy \x1f z", "\0a b", "a \0b", "\0", "é é ́x", "\na", "a\n", "a\nb c\n\nd",
    "<|endoftext|> a<|startoftext|>", "\t\ta", "ΑΣ ὈΔΥΣΣΕΎΣ İ", "日本 語  x", "a .\n", "a 　b", "a  b c", "don't ' s", None,
]


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("p")).withColumn("task", F.lit(0))


@pytest.mark.parametrize("path,cut", [(WORD, DROPPED), (BYTE, LEADING), (BYTE, None)])
@pytest.mark.parametrize("kept", [0, 40, 400])
def test_encoder(path, cut, kept):
    random.seed(1)
    texts = ODD + ["".join(random.choices(["a", "B'", " ", "\n", "é", "7", "　", "'s"], k=30)) for _ in range(400)]
    encoder, plain = Encoder(path, cut, kept), library(path)
    for at in [*range(0, len(texts), 50), 0]:
        ids, offsets = encoder.encode(texts[at : at + 50])
        for k, text in enumerate(texts[at : at + 50]):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == plain(text), text


def check_packed(rows, docs, path, size, end):
    plain = library(path)
    expected = defaultdict(int)
    for doc_id, text in docs:
        ids = plain(text) + [end]
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            expected[doc_id, piece, start, len(part), crc(part)] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == expected
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(n * k[3] for k, n in expected.items())


def test_packing(spark):
    docs = documents(spark)
    rows = queries.QUERIES["op3_best_fit_packing"](spark, SF).collect()
    bins, tokens = check_packed(rows, docs, WORD, 2048, 0)
    assert bins <= -(-tokens // 2048) + 2
    docs = docs[:20] + [(None, "a b"), (None, None), (3, None), (3, None), (4, ""), (5, "word " * 9000)]
    rows = packing.pack(frame(spark, docs), WORD, DROPPED, 16, 0, ids=True)
    check_packed(rows.collect(), docs, WORD, 16, 0)
    lengths = packing.sequences(rows).select(F.size("ids")).collect()
    assert sum(n for (n,) in lengths) == sum(len(library(WORD)(t)) + 1 for _, t in docs)
    assert packing.pack(frame(spark, []), WORD, DROPPED).count() == 0


def test_plan_is_tight():
    random.seed(2)
    for size in (1, 7, 64, 300):
        counts = {n: random.randrange(1, 40) for n in random.sample(range(1, size + 1), min(size, 50))}
        made = packing.plan(counts, size)
        used = np.zeros(made.bins, int)
        for n, count in counts.items():
            where, offset = made.place(np.full(count, n), np.arange(count))
            np.add.at(used, where, n)
            assert (offset + n <= size).all()
        assert used.max() <= size and used.sum() == sum(n * c for n, c in counts.items())
        left = []  # best fit decreasing: no plan should be much worse
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [k for k, room in enumerate(left) if room >= n]
            if fits:
                left[min(fits, key=left.__getitem__)] -= n
            else:
                left.append(size - n)
        assert made.bins <= 1.01 * len(left) + 1


def test_fullest_against_all_subsets():
    from itertools import product

    random.seed(4)
    for _ in range(60):
        counts = {n: random.randrange(1, 4) for n in sorted(random.sample(range(1, 20), 4), reverse=True)}
        room = random.randrange(1, 40)
        best = max(t for t in (sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in product(*(range(c + 1) for c in counts.values()))) if t <= room)
        found = packing.fullest(room, counts)
        assert sum(n * k for n, k in found.items()) == best and all(k <= counts[n] for n, k in found.items())


def expected_index(docs, path, end):
    plain, out, at = library(path), [], 0
    for doc_id, text in docs:
        ids = plain(text) + [end]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_token_files(spark):
    docs = sorted(documents(spark))
    got = queries.QUERIES["op6_token_files"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == expected_index(docs, BYTE, 2)
    docs = [(1, None), (2, ""), (5, "a b"), (5, "a b"), (9, "word " * 9000)]
    got = tokenfile.token_index(frame(spark, docs), BYTE, LEADING, 2).collect()
    assert sorted(tuple(r) for r in got) == expected_index(docs, BYTE, 2)
    assert tokenfile.token_index(frame(spark, []), BYTE, LEADING, 2).count() == 0
    nulls = tokenfile.token_index(frame(spark, [(None, "x"), (None, None), (1, "x")]), BYTE, LEADING, 2).collect()
    assert sorted((r.start, r.doc_id is None) for r in nulls)[2] == (3, False)
    docs = [(4, f"a {k % 3}") for k in range(300)]
    assert sorted(tuple(r) for r in tokenfile.token_index(frame(spark, docs), BYTE, LEADING, 2).collect()) == expected_index(sorted(docs), BYTE, 2)


def test_hot_id_goes_to_several_files(spark):
    docs = frame(spark, [(4, f"a {k % 3}") for k in range(3000)]).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join ranges as small as these
    try:
        files = tokenfile.write_files(docs, tokenfile.shared_uri(spark, scratch_path(spark, "hot")), BYTE, LEADING, 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_docs for r in files) == 3000 and max(r.n_docs for r in files) < 1500


def test_folder_without_scheme_is_the_default_file_systems(spark):
    assert tokenfile.shared_uri(spark, "/shared/x") == "file:///shared/x"
    assert tokenfile.shared_uri(spark, "file:/shared/x") == tokenfile.shared_uri(spark, "file:///shared/x") == "file:///shared/x"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://shared/")
        conf.set("fs.viewfs.mounttable.shared.link./data", "file:///tmp")
        assert tokenfile.shared_uri(spark, "/data/x") == "viewfs://shared/data/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_random_access(tmp_path):
    random.seed(6)
    ids = np.array([random.choice([0, 3, 255, 256, 70_000, 2**31, 2**32 - 1, random.randrange(60_000)]) for _ in range(5000)], np.uint32)
    sizes = [0, 1, 999, 0, 4000, 0]
    for some, lengths in ((ids, sizes), (ids[:0], [0, 0]), (ids[:0], []), (ids % 200, sizes)):
        path = tmp_path / f"{len(some)}-{len(lengths)}-{some[:9].sum()}.dac"
        path.write_bytes(tokenfile.file_bytes([None, 7, *range(8, 4 + len(lengths))][: len(lengths)], lengths, some))
        file = tokenfile.TokenFile(f"file://{path}")
        for _ in range(80 if len(some) else 0):
            a, b = sorted(random.randrange(len(some) + 1) for _ in range(2))
            assert (file.ids(a, b) == some[a:b]).all()
        for place in (0, 63, 64, 511, 512, 513, 4999) if len(some) else ():
            assert file.token(place) == some[place]
        at = 0
        for k, n in enumerate(lengths):
            assert (file.document(k) == some[at : at + n]).all()
            at += n
