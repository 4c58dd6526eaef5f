"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenframe.session import materialise


def _smallest(sides: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours."""
    return sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sides.join(_smallest(sides), "u").filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges run from larger to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (edges.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").filter(F.col("u") != F.col("v")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). One row per node that has an edge to another: node, component (its smallest node).

    Each round is written to the shared folder. Rounds end when the edges no longer change: then every node is tied to
    the smallest of its component. Loops and repeated edges are fine; nodes must not be null.
    """
    now = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(now, "edges")
    mark = _mark(now)
    while mark[0]:
        after = materialise(_small_star(_large_star(now)), "edges")
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
