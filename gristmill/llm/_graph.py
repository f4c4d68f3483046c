"""Connected components of an edge table, by star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._text import checkpoint_dir


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that a chain of edges (a, b) reaches.

    With a number of rounds, it stops after them: nodes with the same component
    are connected then, but connected ones may still differ.

    Only nodes of an edge a != b are returned.  Nulls are ignored and repeated
    edges count once.  Each round sends every neighbour to the smallest one
    (large star, then small star) and is written to the checkpoint folder, so a
    lost executor costs one round at most; the rounds grow with the logarithm
    of the longest chain.  Nothing is gathered on the driver.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    done = 0
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where(F.col("y") > F.col("x")).join(least, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        now = now.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct().checkpoint()
        done += 1
        # done when every node points to one node, which points nowhere
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(now.select(F.col("v"), F.lit(0)).distinct())
        open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)")
        if done == rounds or open_.isEmpty():
            break
    stars = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    if rounds is not None:  # a node that others point to may point further itself
        roots = roots.join(stars.select(F.col("u").alias("node")), "node", "left_anti")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
