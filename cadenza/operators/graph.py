"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadenza.operators.pieces import lookup
from cadenza.session import durable


def connected(links: DataFrame, report=None) -> DataFrame:
    """``node, component`` of every node in ``links`` (``a, b``): the least node it can reach.

    Each round moves the links of a node to the least node around it, first those of larger neighbours,
    then those of smaller ones, so paths of any length shrink by a constant factor. A round costs four
    shuffles of what links are left; a node with very many links is split by the skew join. ``report`` is
    called with the number of links after each round.
    """
    pair = lambda u, v: (F.col(u).alias("u"), F.col(v).alias("v"))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = durable(edges), None
    while True:
        both = edges.unionByName(edges.select(*pair("v", "u")))
        larger = _least_around(both).filter("v > u").select(*pair("v", "least")).filter("u <> v").distinct()
        smaller = _least_around(larger)
        moved = smaller.select(*pair("v", "least")).unionByName(smaller.select(*pair("u", "least")))
        edges = durable(moved.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if report:
            report(now[0])
        if now == before:  # all are stars by now
            break
        before = now
    centres = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        centres.withColumn("component", F.col("node")))


def _least_around(edges: DataFrame) -> DataFrame:
    """Each link with ``least``: the least of its first end and all neighbours of that."""
    least = edges.groupBy("u").agg(F.min("v").alias("_least"))
    return edges.join(lookup(least), "u").withColumn("least", F.least("u", "_least"))
