"""Connected components of a graph of links, by alternating stars; lineage is cut at every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node of ``links`` (a, b).

    Each round hangs every node on the least of its neighbours (large star), then what is left below a node on
    that node's least neighbour (small star).  Rows never outnumber the links; rounds grow as the logarithm
    of the longest chain.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # What is joined is written first: then a shuffle stands right below the join on either side, and adaptive
        # execution splits the links of a hub over tasks.  Its least neighbour is found by partial aggregation.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links")
        large = both.join(least.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        large = written(large.distinct(), "links")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "links")
        small = large.join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        after = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        # links as a set, by their number and two sums of hashes: a round that changes none is the last
        total = lambda seed: F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(38,0)"))
        now = tuple(after.agg(F.count("*"), total(1), total(2)).first())
        dropped(edges, least, large, low)
        edges = after
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
