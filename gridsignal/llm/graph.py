"""Connected components of an edge table, by stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``u, v`` longs) but the smallest.

    Each round links every node's larger neighbours, and then its smaller ones, to the smallest neighbour. Neighbours are
    only ever aggregated, so a node with very many of them is no large group. Rounds are written tables; their number
    grows with the logarithm of the longest path.
    """
    now = settle(directed(edges).distinct())
    while not settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = directed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(directed(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def directed(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")


def settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each node has one edge, and none leads to a node that has one."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n")).select("u", F.col("n"), F.lit(0).alias("hit"))
    hits = edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(1).alias("hit"))
    kinds = ends.unionByName(hits).groupBy("u").agg(F.max("n").alias("n"), F.max("hit").alias("hit"))
    return kinds.where("n > 1 OR n = 1 AND hit = 1").isEmpty()
