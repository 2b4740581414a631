"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import lookup, stored


def _with_least(sides: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its v."""
    least = sides.groupBy("u").agg(F.min("v").alias("_least"))
    return sides.join(lookup(least), "u").withColumn("least", F.least("u", "_least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the least node it can reach.

    Rows with a null end or with equal ends link nothing. Each round hooks larger neighbours,
    then smaller ones, to the least neighbour; rounds grow with the logarithm of the number of
    nodes. A round is written to the shared folder. Links stay distributed, and a node with very
    many links is split by the skew join.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges, mark = stored(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v")
        small = _with_least(large.distinct())
        hooked = small.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v").unionByName(
            small.select("u", F.col("least").alias("v")).filter("u != v")
        )
        edges = stored(hooked.distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
