"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest vertex in sight."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    lower = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.withColumnRenamed("m", "v"))


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of ``links (a, b)``; the component is its smallest vertex.

    Each round halves the depth of the remaining trees or better; rounds end when links no longer change.
    No vertex's links meet in one task: only their minimum does, and the join back may be split.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    pairs, before = cut(pairs), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            )
        before = state
        pairs = cut(_small_star(_large_star(pairs)).distinct())
