"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root for every node of links (a, b); root is the smallest node it can reach.

    Alternates two contractions that only ever join a link to its node's smallest neighbour, so
    no neighbourhood is gathered in one place: the larger neighbours of a node are hung on its
    smallest neighbour, then the smaller ones. The number of links never grows, and the forest
    becomes a set of stars after a number of rounds that grows with the logarithm of the
    longest chain. Each round is written, so a lost executor costs one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "links")
    mark = _mark(edges)
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)), "links")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    """What changes when a set of links does."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    # a larger neighbour v of u appears as edge (v, u): hang it on u's least
    return edges.join(least, edges["v"] == least["k"]).select(F.col("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = edges.join(least, edges["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).filter("u <> v").distinct()
