"""Session settings and the places where long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Settings every job of this package is written for. Sizes are left to AQE:
# it coalesces small shuffle partitions and splits skewed ones at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.ignoreMissingFiles": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Put the package defaults on a session builder."""
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder checkpoints and scratch tables go to.

    A cluster names it in ``spark.checkpoint.dir``. Only on a local master, where
    driver and tasks share one disk, is a temporary folder chosen if that is unset.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = context.master == "local" or context.master.startswith("local[")
    if configured is None and context.getCheckpointDir() is None and not local:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="actiloom-"))
    return configured or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    The rows are in the shared folder afterwards, so losing an executor costs
    a re-read, not a re-run of every earlier level of a loop.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a table in the shared folder, computed once and read back.

    Unlike a checkpoint it is computed once, keeps its columns apart, so that a
    reader takes only those it needs, and has a size that joins can go by.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The results of a loop's rounds, each written once under its number.

    A round adds what is new and nothing else. However many rounds there were,
    reading them back is one scan with the column ``round``, not a union of
    as many branches.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.count, self.schema = spark, scratch_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes the next round and returns it as read back."""
        path = f"{self.path}/round={self.count}"
        df.write.parquet(path)
        self.count += 1
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, first: int = 0) -> DataFrame:
        """The rows of the rounds from ``first`` on, with ``round``."""
        schema = T.StructType([*self.schema.fields, T.StructField("round", T.IntegerType())])
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*(f"{self.path}/round={n}" for n in range(first, self.count))) if first else reader.parquet(self.path)
