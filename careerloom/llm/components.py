"""Connected components of a table of links, by alternating star contractions.

Every round is a handful of joins and aggregations; no link and no component
passes through the driver. The edges of a round are a table in the shared
folder, so a lost executor costs at most the round it was lost in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerloom.runtime import cut


def _towards_smaller(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    smallest = both.groupBy("a").agg(F.min("b").alias("n")).select("a", F.least("a", "n").alias("m"))
    return both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the smallest one."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum: two numbers, whatever the size."""
    part = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))
    return tuple(edges.agg(F.count("*"), F.sum(part), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Links may repeat, run either way or join a node to itself; links with a
    null end are left out. An empty table gives an empty table. The number of
    rounds is not bounded: they end when a round changes nothing.
    """
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    lone = ends.filter("a = b").select(F.col("a").alias("node"))
    edges = cut(_towards_smaller(ends))
    before = _mark(edges)
    while before[0]:
        edges = cut(_towards_smaller(_small_star(_towards_smaller(_large_star(edges)))))
        after = _mark(edges)
        if after == before:
            break
        before = after
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node")).union(lone).distinct()
    alone = roots.join(hung, "node", "left_anti").withColumn("component", F.col("node"))
    return hung.union(alone)
