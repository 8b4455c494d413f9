"""Connected components of neighbour graphs, and the direction of pairs within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster_id) of all nodes (id); edges (a, b) count in both directions. A cluster's id is its least member.

    Each round ties every node to the least of its neighbourhood (large star, then small star), so long chains
    shrink by half, and rounds go on until nothing changes. Nodes without edges are clusters of their own."""
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, settled(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop(last)
    tied = now.select(F.col("a").alias("id"), F.col("b").alias("cluster_id"))
    return nodes.select("id").distinct().join(tied, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def oriented(edges: DataFrame) -> DataFrame:
    """Each pair of events once: where both list the other, the rows of the smaller id's list stay."""
    pair = edges.select(F.least("ref_id", "neigh_id").alias("lo"), F.greatest("ref_id", "neigh_id").alias("hi"), "ref_id").distinct()
    keep = pair.groupBy("lo", "hi").agg(F.min("ref_id").alias("ref_id")).select("ref_id", F.expr("if(ref_id = lo, hi, lo)").alias("neigh_id"))
    return edges.join(keep, ["ref_id", "neigh_id"], "left_semi")
