"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiloom.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node that each end of the links (``a``, ``b``) reaches.

    Alternates two steps until only stars are left: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours likewise. Stars
    end in two rounds, chains in about the logarithm of their length. Only
    minima are taken per node, so a hub needs no list of its neighbours. Each
    round is written once; empty links give no rows.
    """
    links = written(_ordered(links.select("a", "b")), "links")
    while not _stars(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(up)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(_ordered(down.unionAll(least.select("a", F.col("m").alias("b")))), "links")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every larger node has one link, to a node that is nowhere the larger one."""
    chains = links.join(links.select(F.col("a").alias("b")), "b", "left_semi").select("a")
    forks = links.groupBy("a").count().filter("count > 1").select("a")
    return chains.unionAll(forks).isEmpty()


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
