"""Connected components of link tables, without lists of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); root is the smallest node.

    Large-star / small-star rounds: every round is aggregations of minima (added up in each
    task first) and joins on plain exchanges, so a hub with many links is split, not listed.
    The number of rounds grows with the logarithm of the nodes.
    """
    edges = cut(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written down first: then a join has bare exchanges and its hubs are split.
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut(join_small(both.where("v > u"), low, ["u"]).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        ends = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut(join_small(large, ends, ["u"])
                    .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                              F.struct("u", F.col("m").alias("v")))).alias("e"))
                    .select("e.*").where("u <> v").distinct())
        mark = tuple(edges.agg(F.count(F.lit(1)),
                               F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if mark == before:
            break
        before = mark
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
                             .distinct())
