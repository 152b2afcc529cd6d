"""Indices on spanning-tree bottleneck distances to medoids.

Three published generations differ in small ways, kept as flags: ``first`` averages cohesion over a
cluster and lets divisions by zero be; ``third`` averages cohesion, skips zero distances and returns
0 where a sum is 0; ``current`` (the default) takes cohesion by point and guards its silhouette.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.functions.internal import ratio
from cohesia.operators.frames import KEYS
from cohesia.operators.mst import bottleneck_to, mst_edges
from cohesia.operators.stats import medoids, overall_medoid

C = F.col


def distances_to_medoids(p: DataFrame, dim: int, mode: str = "exact", k: int = 5, overall: bool = False) -> DataFrame:
    """(keys, row_id, label, of, d): largest path edge from each point to each cluster's medoid (of = its label).

    overall: also from each point to the medoid of all points (of is null).
    """
    m = medoids(p, dim).select(*KEYS, C("label").alias("of"), C("medoid_id").alias("target"))
    if overall:
        m = m.unionByName(overall_medoid(p, dim).select(*KEYS, F.lit(None).cast("int").alias("of"), C("medoid_id").alias("target")))
    d = bottleneck_to(p, mst_edges(p, mode, k), m.select(*KEYS, "target").distinct())
    return d.join(m, [*KEYS, "target"]).join(p.select(*KEYS, "row_id", "label"), [*KEYS, "row_id"])


def _between(d: DataFrame, m: DataFrame) -> DataFrame:
    """(keys, li, lj, dm): distances between medoids, both ways."""
    at = m.select(*KEYS, C("label").alias("li"), C("medoid_id").alias("row_id"))
    return d.where("of is not null").join(at, [*KEYS, "row_id"]).where("li <> of").select(*KEYS, "li", C("of").alias("lj"), C("d").alias("dm"))


def mst_silhouette(p: DataFrame, dim: int, mode: str = "exact", k: int = 5, version: str = "current") -> DataFrame:
    d = distances_to_medoids(p, dim, mode, k)
    q = d.groupBy(*KEYS, "row_id", "label").agg(F.max(F.when(C("of") == C("label"), C("d"))).alias("a"), F.min(F.when(C("of") != C("label"), C("d"))).alias("b"))
    if version != "current":
        q = q.join(q.groupBy(*KEYS, "label").agg(F.avg("a").alias("m")), [*KEYS, "label"]).withColumn("a", C("m"))
    one = ratio(C("b") - C("a"), F.greatest("a", "b"))
    one = one if version == "first" else F.coalesce(one, F.lit(0.0))
    return q.groupBy(*KEYS).agg(F.when(F.count("b") == 0, F.lit(0.0)).otherwise(F.avg(one)).alias("value"))


def mst_davies_bouldin(p: DataFrame, dim: int, mode: str = "exact", k: int = 5, version: str = "current") -> DataFrame:
    d, m = distances_to_medoids(p, dim, mode, k), medoids(p, dim)
    s = d.where(C("of") == C("label")).groupBy(*KEYS, "label").agg(F.avg("d").alias("s"))
    pairs = _between(d, m).join(s.select(*KEYS, C("label").alias("li"), C("s").alias("si")), [*KEYS, "li"]).join(s.select(*KEYS, C("label").alias("lj"), C("s").alias("sj")), [*KEYS, "lj"])
    worst = pairs.groupBy(*KEYS, "li").agg(F.max(ratio(C("si") + C("sj"), C("dm"))).alias("r"))
    clusters = s.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"))
    total = worst.groupBy(*KEYS).agg(F.sum(F.coalesce("r", F.lit(0.0) if version == "third" else C("r"))).alias("t"))
    return clusters.join(total, KEYS, "left").select(*KEYS, F.when(C("k") == 1, 0.0).otherwise(C("t") / C("k")).alias("value"))


def mst_calinski_harabasz(p: DataFrame, dim: int, mode: str = "exact", k: int = 5, version: str = "current") -> DataFrame:
    d, m = distances_to_medoids(p, dim, mode, k, overall=True), medoids(p, dim)
    within = d.where(C("of") == C("label")).groupBy(*KEYS).agg(F.sum("d").alias("ssw"), F.count(F.lit(1)).alias("n"))
    sizes = p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("nk"))
    at = m.select(*KEYS, "label", C("medoid_id").alias("row_id"))
    centre = d.where("of is null").select(*KEYS, "row_id", "d").join(at, [*KEYS, "row_id"]).join(sizes, [*KEYS, "label"])
    between = centre.groupBy(*KEYS).agg(F.sum(C("d") * C("nk")).alias("ssb"), F.count(F.lit(1)).alias("k"))
    value = ratio(ratio(C("ssb"), C("k") - 1), ratio(C("ssw"), C("n") - C("k")))
    value = value if version == "first" else F.when((C("ssw") == 0) | (C("k") == 1), 0.0).otherwise(value)
    return within.join(between, KEYS).select(*KEYS, value.alias("value"))


def mst_separation_ratio(p: DataFrame, dim: int, mode: str = "exact", k: int = 5, version: str = "current") -> DataFrame:
    """Largest medoid distance on the clusters' own trees over the least distance between medoids on the whole tree."""
    m = medoids(p, dim)
    # each cluster is a key of its own for its tree
    own = p.select("dataset", F.concat_ws("\0", "labelset", C("label").cast("string")).alias("labelset"), "row_id", "x", "label")
    targets = m.select("dataset", F.concat_ws("\0", "labelset", C("label").cast("string")).alias("labelset"), C("medoid_id").alias("target"))
    inner = bottleneck_to(own, mst_edges(own, mode, k), targets)
    widest = inner.select("dataset", F.substring_index("labelset", "\0", 1).alias("labelset"), "d").groupBy(*KEYS).agg(F.max("d").alias("top"))
    d = bottleneck_to(p, mst_edges(p, mode, k), m.select(*KEYS, C("medoid_id").alias("target")))
    d = d.join(m.select(*KEYS, C("label").alias("of"), C("medoid_id").alias("target")), [*KEYS, "target"])
    least = _between(d, m).groupBy(*KEYS).agg(F.min("dm").alias("low"))
    inf = F.lit(float("inf"))
    value = ratio(C("top"), C("low")) if version == "first" else F.when(C("low").isNull() | (C("low") == 0) | (C("low") == inf), inf).otherwise(C("top") / C("low"))
    return widest.join(least, KEYS, "left").select(*KEYS, value.alias("value"))


#: name -> (plan, whether higher is better)
TREE = {"mst_s": (mst_silhouette, True), "mst_db": (mst_davies_bouldin, False), "mst_ch": (mst_calinski_harabasz, True), "mst_sep_ratio": (mst_separation_ratio, False)}
