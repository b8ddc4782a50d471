"""From raw documents to packed training sequences, each stage by one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiloom.llm import decontam, jaccard, language, packing, quality
from actiloom.llm.encoder import DROPPED
from actiloom.llm.frames import table, written
from actiloom.llm.queries import tokenizer_path

#: Trained models and components are outside SQL; the stages are tested against brute force.
ORACLE_SQL = None
#: Words whose ids a worker remembers while packing, beside what the earlier stages left in its executor.
REMEMBERED = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognisable language go."""
    return language.identified(docs, docs.filter(~language.held_out()))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rates below 0.3 go."""
    return quality.accepted(docs, docs.filter(~quality.held_out()), table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over five-word shingles, one row stays.

    It is the one with the smallest id, a null id being the largest; of equal ids
    the first row as they are numbered here. Each row counts for itself, so
    different texts under one id are no copies. Rows without a word all stay.
    """
    nth = "nth"
    while nth in {c.lower() for c in docs.columns}:
        nth += "_"
    rows = written(docs.withColumn(nth, F.monotonically_increasing_id()), "rows")
    found = jaccard.jaccard_components(rows.select(F.col(nth).alias("doc_id"), "text"), width=5, percent=80)
    ids = rows.select(F.col(nth).alias("row"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    least = found.join(ids, found["doc_id"] == ids["row"]).groupBy("component_id").agg(F.min(order).alias("least"))
    return rows.join(least.select(F.col("least.row").alias(nth)), nth, "left_semi").drop(nth)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that contain ten running words of a benchmark item, or a whole shorter item, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), DROPPED, size=2048, end=0, kept=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
