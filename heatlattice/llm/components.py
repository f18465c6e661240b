"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations with partial sums and two joins with their results. Those are tables by then: they are
broadcast while few, and beyond that adaptive execution splits the rows of a frequent node among tasks. So no node's
neighbours have to meet in one. Every round is written to the shared folder. Nothing is collected but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatlattice.llm.common import checked_broadcast
from heatlattice.storage import stored


def table(least: DataFrame) -> DataFrame:
    least = stored(least)
    return checked_broadcast(least, least.count())


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of edges (a, b: long); loops are ignored."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while (mark := tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())) != was and mark[0]:
        was = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = table(large.groupBy("a").agg(F.min("b").alias("m")))
        rest = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
