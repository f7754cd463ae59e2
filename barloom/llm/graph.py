"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import drop_tables, settle, shuffled_join

#: Edges up to which Spark may broadcast a round's tables; written edges take few bytes, and their rows on the driver many.
FEW = 100_000


def _large_star(edges: DataFrame, join) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")


def _small_star(edges: DataFrame, join) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = join(edges, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge, as a written table: ``root`` is the smallest node reachable.

    Each round is joins and minima with partial aggregation, so a hub is no larger a task than its share; rounds grow
    with the logarithm of the longest chain, and each round's edges are a table in the shared folder.  Loops and
    repeated edges are harmless; an edge with a null end is no edge; no edges give no rows.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = settle(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        join = shuffled_join if mark[0] > FEW else DataFrame.join
        before, edges = edges, settle(_small_star(_large_star(edges, join).distinct(), join).distinct(), "edges")
        drop_tables(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    found = settle(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots")
    drop_tables(edges)
    return found
