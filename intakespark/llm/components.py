"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Scratch


def _open(links: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one: else the links are stars around their smallest nodes."""
    low = links.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    high = links.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = low.unionByName(high).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where(F.col("below") + F.col("above") * F.least("below", F.lit(1)) > 1).agg(F.count(F.lit(1))).first()[0] > 0


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): the smallest node reachable.

    Each step keeps at most one row a link and looks at links only by joins and partial minima, so a node with
    very many links needs no task of its own. Steps are written to the shared folder, and end once the links are
    stars. Self-links and links with a null end are dropped; repeated links count once; no links, no rows.
    """
    now = scratch.keep(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _open(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.keep(moved.unionByName(floor.withColumnRenamed("m", "v")).where(F.col("u") != F.col("v")).distinct())
        scratch.drop(now)
        now = small
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
