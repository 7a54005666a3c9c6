"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps.

Each step replaces the neighbours of a vertex by edges to their minimum.  The
minimum is a partially aggregated ``min`` joined back to the edges.  The edges of
a vertex with very many of them meet in one task of that join, row by row and
never as a group, unless AQE splits its partition.  Lineage is cut after every
round in the shared checkpoint folder; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _proper(e: DataFrame) -> DataFrame:
    return e.where("a <> b").distinct()


def components(edges: DataFrame, files: int) -> DataFrame:
    """``edges`` (a, b: long) to ``(a, b)``: every vertex that isn't its component's smallest, with that smallest."""
    now = stage(_proper(edges.select("a", "b")), "edges", files)
    mark = None
    while True:
        new = stage(_proper(_small_star(_large_star(now))), "edges", files)
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(now)
        now = new
        if tuple(seen) == mark or seen[0] == 0:
            return now
        mark = tuple(seen)
