"""Connected components of an undirected graph given as an edge table.

Alternating large-star and small-star rounds: every round links nodes to the
smallest node they know of, so the number of rounds grows with the logarithm of
a component's length. A hub never collects its neighbours in one place: only
minima are aggregated, then joined back. Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable."""
    links = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        # large star: neighbours larger than a node link to the smallest of its neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = scratch.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: a node and its smaller neighbours link to the smallest of them
        low = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = scratch.keep(small)
        changed = new.exceptAll(links).limit(1).count() + links.exceptAll(new).limit(1).count()
        for old in (links, least, large, low):
            scratch.drop(old)
        links = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
