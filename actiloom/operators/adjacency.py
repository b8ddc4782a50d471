"""A table of links laid out for walks: all links of an end lie together.

Links are written once into Spark buckets by their near end and sorted by it.
A frontier then meets them without a shuffle of the links: a large one is dealt
to the same buckets, and the keys of a small one are pushed into the scan, which
opens only their buckets and, sorted as these are, only some row groups there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of a frontier whose ends are pushed into the scan; a larger one is joined bucket by bucket.
PUSHED = 1000


class Adjacency:
    def __init__(self, links: DataFrame, near: str) -> None:
        spark = links.sparkSession
        self.near, self.buckets = near, int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"links_{uuid.uuid4().hex}"
        # Repeated links are dropped in the partitions that become the buckets: one shuffle for both.
        rows = links.repartition(self.buckets, near).dropDuplicates()
        writer = rows.write.format("parquet").bucketBy(self.buckets, near).sortBy(near)
        writer.option("path", scratch_path(spark, name)).saveAsTable(name)
        self.links = spark.table(name)

    def meet(self, frontier: DataFrame) -> DataFrame | None:
        """The links whose near end is in the frontier, with the frontier's other columns; None of an empty one.

        ``frontier`` has a column named like the near end, and should be a
        written table: its first keys are looked at before anything is joined.
        """
        first = frontier.select(self.near).take(PUSHED + 1)
        if not first:
            return None
        if len(first) > PUSHED:
            return self.links.join(frontier, self.near)
        links = self.links.where(F.col(self.near).isin(*{row[0] for row in first}))
        return links if frontier.columns == [self.near] else links.join(frontier, self.near)
