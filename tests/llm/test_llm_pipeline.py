"""The pipeline's stages and their effects."""

from pyspark.sql import functions as F
from test_llm_jaccard import brute, near_copies, sets_of

import corpus_pipeline
from actiloom.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 120").first().text
    top = docs.agg(F.max("doc_id")).first()[0]
    text = docs.filter("n_chars > 900 and lang = 'en'").orderBy("doc_id").first().text
    extra = [(top + 1, None), (top + 2, "123 456"), (top + 3, text), (top + 4, text + " end"), (top + 5, text[:300] + " " + item)]
    more = spark.createDataFrame(extra, "doc_id long, text string").select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")
    )
    current = docs.unionByName(more)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, SF)
        assert after.columns == docs.columns
        assert after.exceptAll(current).isEmpty()
        current = spark.createDataFrame(after.collect(), after.schema)
        kept[name] = {r.doc_id for r in current.collect()}
    assert not {top + 1, top + 2} & kept["language_id"] and {top + 3, top + 4, top + 5} <= kept["language_id"]
    assert not {top + 3, top + 4} & kept["near_duplicates"]
    assert top + 5 not in kept["decontamination"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r.doc_id for r in labels.filter("quality = 1").join(docs, "doc_id").collect()} & kept["language_id"]
    assert len(clean & kept["quality_filter"]) >= 0.97 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, current, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_one_row_of_each_group_stays(spark):
    def text(seed, changed=0):
        return " ".join(f"w{seed * 7919 + k}" for k in range(200 - changed)) + " changed" * changed

    rows = [(None, text(1)), (9, text(1)), (8, text(1, 1)), (9, text(1))]
    rows += [(None, text(2))] * 3000 + [(None, text(2, 1))] * 5
    rows += [(4, text(3))] * 2000 + [(4, text(4)), (5, text(4)), (3, text(3)), (3, text(3))]
    rows += [(None, text(5)), (7, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nth", F.lit("n"))
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len(kept) == 6
    assert {(8, text(1, 1)), (4, text(4)), (3, text(3)), (None, text(5)), (7, text(6))} < set(kept)
    assert ({(None, text(2)), (None, text(2, 1))} & set(kept)) and not {(9, text(1)), (5, text(4))} & set(kept)


def test_near_duplicates_are_those_of_all_pairs(spark):
    """The given documents and a large group of near copies: of each group linked at 0.8 over five words one stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = [(1_000_000 + k, text) for k, text in near_copies(200, 9, 200, 2)]
    more = spark.createDataFrame(copies, "doc_id long, text string").select(
        "doc_id", "text", *(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in ("doc_id", "text"))
    )
    both = docs.unionByName(more)
    rows = [tuple(r) for r in both.select("doc_id", "text").collect()]
    expected = {doc_id for doc_id, (_, least) in brute(sets_of(rows, 5), 80).items() if doc_id == least}
    kept = corpus_pipeline.near_duplicates(spark, both, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and len(expected) < len(rows)


def test_empty(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
