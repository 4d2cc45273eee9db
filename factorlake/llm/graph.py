"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stable


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _hang(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hangs the neighbours of every node below its smallest neighbour (or itself).

    The minima are stored first, so the join reads two plain tables and Spark can split a hub's edges.
    """
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stable(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    hung = edges.join(least, "u")
    if both_ways:
        return hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges(u, v)``; root is the smallest node reachable.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the
    component size, each round is a grouping and a join, and links never reach the driver (only a
    count and a checksum do). Self loops, repeated edges and an empty table are fine; nulls are dropped.
    """
    tidy = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stable(tidy)
    seen = _fingerprint(now)
    while seen[0]:
        large = stable(_hang(now, True).where(F.col("u") != F.col("v")).distinct())
        now = stable(_hang(large, False).where(F.col("u") != F.col("v")).distinct())
        last, seen = seen, _fingerprint(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
