"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the least of them and the node: the greater ones in a large
    star, the lesser ones and the node itself in a small one. Hot nodes are summed up before a shuffle,
    and the join on them is one that Spark may split."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges have a > b
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is the least of its neighbourhood keeps its greater neighbours
        return out.where(F.col("a") != F.col("b")).distinct()
    out = tied.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))).distinct()


def settled(edges: DataFrame) -> DataFrame:
    """(a, b) for every node of ``edges`` (a, b) but the least of its component, which is b. A written table.

    Edges with equal or null ends count for nothing; repeated and reversed ones count once. Each round's table replaces the one before."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "edges"), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before and state[0]:
        before = state
        after = written(_star(_star(now, large=True), large=False), "edges")
        drop_written(now)
        now = after
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component's name is its least node."""
    now = settled(edges)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
