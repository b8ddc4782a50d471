"""Small helpers shared by the corpus operators: input columns, scratch tables, Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiloom.session import scratch_path

KINDS = {"doc_id": "long", "item_id": "long", "page_id": "long", "vec_id": "long", "text": "string", "lang": "string", "url": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, in their usual types, so that no other column can clash."""
    return df.select(*(F.col(name).cast(KINDS[name]).alias(name) if name in KINDS else F.col(name) for name in names))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the n + 1 offsets; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have at most ``most`` bytes together, or of one longer text."""
    for batch in batches:
        for first, last in runs(utf8(batch[column])[1], most):
            yield batch.slice(first, last - first)
