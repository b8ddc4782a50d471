"""Sharding by extendible hashing, in DataFrame operations alone.

A row's hash bits lead through a directory to its bucket. A bucket over the byte
limit is split on its next bit, until every bucket fits; small buckets keep a
short prefix. The bits are the first 60 of the MD5 of the row's doc_id. Rows that
share those (the same id again) are split on further bits, taken from the hash
of the text and then from a number that each row got when it was written. Only a
single row can exceed the limit; it then has a bucket of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import pick, written

#: Bits that one word of the hash gives.
WORD_BITS = 60
#: Bits by which a round of splitting looks ahead.
ROUND_BITS = 10
WORDS = ["h0", "h1", "h2"]
#: What is said of a row's shard.
PLACE = ["shard", "depth", "shard_bytes", "shard_rows"]


def _bits(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, WORD_BITS // 4), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_bytes``, ``shard``, ``depth``, ``shard_bytes``, ``shard_rows``.

    ``shard``: the bucket's hash prefix as a string of 0 and 1 (empty if one
    bucket holds all); no shard's texts exceed ``limit`` UTF-8 bytes, but for one
    text that alone does, nor does it have more rows than ``limit``, so rows without
    text are split as well. A null text has no bytes; a null doc_id is hashed as an
    empty string. Rows count each for itself. An empty table gives no rows; other
    columns are not looked at.
    """
    rows = pick(docs, "doc_id", "text").withColumn("nth", F.monotonically_increasing_id())
    return _placed(rows, limit).select("doc_id", "n_bytes", *PLACE)


def _placed(docs: DataFrame, limit: int, *kept: str) -> DataFrame:
    """The columns of ``shards`` and those of ``kept``; docs: ``doc_id``, ``text`` and ``nth``, each row's number."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        _bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h0"),
        _bits(F.md5(F.coalesce("text", F.lit("")))).alias("h1"),
        "nth",
    )
    rows = written(rows, "rows")
    rows = rows.withColumn("h2", _bits(F.md5(F.col("nth").cast("string")))).select("doc_id", "n_bytes", *WORDS, *kept)
    # The buckets that are not split further, and what is still too large.
    done, prefix = [], F.lit("")
    open_rows = rows.withColumn("prefix", prefix)
    for first in range(0, WORD_BITS * len(WORDS), ROUND_BITS):
        word, shift = WORDS[first // WORD_BITS], WORD_BITS - first % WORD_BITS - ROUND_BITS
        ahead = F.lpad(F.bin(F.shiftright(word, shift).bitwiseAND((1 << ROUND_BITS) - 1)), ROUND_BITS, "0")
        cells = open_rows.groupBy("prefix", ahead.alias("ahead")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        cells = written(cells, "cells")
        # Every prefix of a cell is a possible bucket: its sums, and the shortest that fits.
        paths = cells.select(
            "prefix", "ahead", "bytes", "rows", F.explode(F.sequence(F.lit(0 if not first else 1), F.lit(ROUND_BITS))).alias("take")
        ).withColumn("bucket", F.concat("prefix", F.expr("substring(ahead, 1, take)")))
        sums = paths.groupBy("bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = sums.filter((F.greatest("shard_bytes", "shard_rows") <= limit) | (F.col("shard_rows") == 1))
        best = paths.join(_dealt(fits, first), "bucket").groupBy("prefix", "ahead").agg(F.min(F.struct("take", "bucket", "shard_bytes", "shard_rows")).alias("b"))
        best = written(best.select("prefix", "ahead", F.col("b.bucket").alias("shard"), "b.shard_bytes", "b.shard_rows"), "directory")
        keyed = open_rows.withColumn("ahead", ahead)
        best = _dealt(best, first)
        done.append(keyed.join(best, ["prefix", "ahead"]))
        left = _dealt(cells.join(best, ["prefix", "ahead"], "left_anti").select("prefix", "ahead"), first)
        if left.isEmpty():
            break
        deeper = keyed.join(left, ["prefix", "ahead"]).withColumn("prefix", F.concat("prefix", "ahead")).drop("ahead")
        open_rows = written(deeper.select(*rows.columns, "prefix"), "open")
    else:
        raise RuntimeError("rows with equal hash bits exceed the limit")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("depth", F.length("shard"))


def _dealt(directory: DataFrame, first: int) -> DataFrame:
    """``directory`` kept out of broadcasts unless it is that of the first bits, which is small on any table."""
    return directory.hint("merge") if first else directory


def write_shards(docs: DataFrame, limit: int, path: str) -> DataFrame:
    """Writes each shard's rows to a folder of its own; returns the directory.

    Every row of ``docs`` is written once, with all its columns. The folders are
    named by the column ``shard``, with underscores appended if ``docs`` has it.
    """
    nth, shard = _free(docs, "nth"), _free(docs, "shard")
    rows = written(docs.withColumn(nth, F.monotonically_increasing_id()), "numbered")
    placed = _placed(rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(nth).alias("nth")), limit, "nth")
    placed = written(placed.select("nth", *PLACE), "placed")
    where = placed.select(F.col("nth").alias(nth), F.col("shard").alias(shard))
    rows.join(where, nth).drop(nth).repartition(shard).write.partitionBy(shard).parquet(path)
    return placed.select(*PLACE).distinct()


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
