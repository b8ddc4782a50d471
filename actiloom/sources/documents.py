"""Documents made from files: their size and type come from a listing, not a read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize
from . import tail


def list_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, original_name, mime, size) of the files a glob matches."""
    name = F.substring_index("file", "/", -1)
    return tail.read_file_list(spark, path).select(
        "file",
        name.alias("original_name"),
        X.mime_of(name).alias("mime"),
        F.col("bytes").alias("size"),
    )


def attach(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, states, edges) for files to hang on an ``owner``.

    ``files`` has (owner, file, original_name, mime, size).
    """
    made = materialize(files.withColumns({"id": F.expr("uuid()"), "_at": now}))
    anchors = made.select(
        "id", F.lit("document").alias("entity_type"), F.col("_at").alias("created_at")
    )
    states = made.select(
        F.expr("uuid()").alias("id"),
        F.col("id").alias("entity"),
        F.col("original_name").alias("name"),
        F.lit(None).cast("string").alias("content"),
        F.to_json(F.struct("file", "original_name", "mime", "size")).alias("attributes"),
        F.col("_at").alias("valid_from"),
    )
    edges = made.select(
        F.expr("uuid()").alias("id"),
        F.col("owner").alias("in"),
        F.col("id").alias("out"),
        F.expr("uuid()").alias("edge_uid"),
        F.lit("attached").alias("rel_type"),
        F.lit(True).alias("active"),
        F.col("_at").alias("valid_from"),
    )
    return anchors, states, edges
