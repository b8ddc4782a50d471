"""Append-only Parquet tables: the only storage the package writes.

A batch is one folder, replaced as a whole when the batch is written again, so
a retried micro-batch leaves no doubles. Inside it rows lie by day of
``valid_from``, so reads with a time bound skip files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

# Kept by the chat format between batches.
EXTRA = {
    "chat_header": T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("session", T.StringType()),
            T.StructField("valid_from", T.TimestampType()),
        ]
    ),
    "chat_seen": T.StructType(
        [
            T.StructField("file", T.StringType()),
            T.StructField("record_id", T.StringType()),
            T.StructField("chars", T.LongType()),
            T.StructField("valid_from", T.TimestampType()),
        ]
    ),
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schema(self, table: str) -> T.StructType:
        return model.TABLES.get(table) or EXTRA[table]

    def exists(self, table: str) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def append(self, table: str, rows: DataFrame, batch: str) -> None:
        """Write one batch; writing the same batch again replaces it."""
        columns = [f.name for f in self.schema(table)]
        day = F.to_date("valid_from").alias("day")
        (
            rows.select(*columns, day)
            .write.mode("overwrite")
            .partitionBy("day")
            .parquet(f"{self.path(table)}/batch={batch}")
        )

    def read(self, table: str, without_batch: str | None = None) -> DataFrame:
        """All rows, with the partition columns ``batch`` and ``day`` left usable for pruning."""
        schema = self.schema(table)
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        full = T.StructType(
            [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("day", T.DateType())]
        )
        rows = self.spark.read.schema(full).parquet(self.path(table))
        if without_batch is not None:
            rows = rows.where(F.col("batch") != without_batch)
        return rows.select(*[f.name for f in schema])

    def since(self, table: str, moment) -> DataFrame:
        """Rows at or after a moment; the day folders before it are not listed."""
        schema = self.schema(table)
        full = T.StructType(
            [*schema.fields, T.StructField("batch", T.StringType()), T.StructField("day", T.DateType())]
        )
        rows = self.spark.read.schema(full).parquet(self.path(table))
        at = F.lit(moment)
        return rows.where((F.col("day") >= F.to_date(at)) & (F.col("valid_from") >= at)).select(
            *[f.name for f in schema]
        )

    def stream(self, table: str) -> DataFrame:
        """The table as a stream of newly written rows."""
        return (
            self.spark.readStream.schema(self.schema(table))
            .option("recursiveFileLookup", "true")
            .parquet(self.path(table))
        )

    def create(self, table: str) -> None:
        """An empty table, so a stream can start before the first batch."""
        if not self.exists(table):
            empty = self.spark.createDataFrame([], self.schema(table))
            empty.write.mode("overwrite").parquet(f"{self.path(table)}/batch=empty/day=1970-01-01")
