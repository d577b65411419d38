"""Connected components as rounds of DataFrame joins.

Large-star and small-star steps alternate: every node tells its larger, then its
smaller neighbours the smallest node it knows.  A node with very many neighbours
is one aggregate row per task and a skewed join that the engine may split.  Each
round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least).distinct()


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node reachable.

    Direction, repeated edges and edges from a node to itself don't matter, edges
    with a null end are no edges.  No edges: no rows.
    """
    now = written(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(
        F.greatest(source, target).alias("a"), F.least(source, target).alias("b")).distinct(), "edges")
    alone = now.where("a = b").select(F.col("a").alias("node"))
    now, before = now.where("a <> b"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(
            F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before, now = mark, written(_small(_large(now)), "edges")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    nodes = roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    lonely = alone.join(nodes, "node", "left_anti").select("node", F.col("node").alias("root"))
    return nodes.unionByName(lonely)
