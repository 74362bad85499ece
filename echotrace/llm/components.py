"""Connected components by alternating large-star and small-star steps.

Each step rewires edges towards the least neighbour, until the edges are stars: every node
points at the least node of its component.  Each round is written to the shared folder, so
lineage stays short and lost executors cost one step.  A node with very many neighbours is
joined where its edges are (see ``joins``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_common
from .store import forget, release, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down or any number of edges up: then v is the least node of each component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0").isEmpty()


#: Edges up to which one task may hold all those of a node.
SMALL = 1_000_000


def _starred(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u."""
    if total < SMALL:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "edges-least")
    return join_common(edges, least, ["u"], "n", total).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (u, v); the root is the least node."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, total).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges-large") if total >= SMALL else large
        small = _starred(large, total)
        step = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, written(step, "edges")
        forget(old)
        if total >= SMALL:
            forget(large)
            release(edges.sparkSession)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
