"""Cluster statistics: centroids, medoids, moments, contingency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.functions.vectors import dist, sq_dist, sq_dist_of_few, total
from cohesia.operators.attach import attach
from cohesia.operators.frames import KEYS
from cohesia.session import Scratch


def centroids(p: DataFrame, dim: int) -> DataFrame:
    """(keys, label, n, mu, ssw, var): means by coordinate, the sum of squared distances to them and variances, in one scan of partial aggregations."""
    spread = total([F.var_pop(F.col("x")[i]) for i in range(dim)])
    return p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.col("x")[i]) for i in range(dim))).alias("mu"), (spread * F.count(F.lit(1))).alias("ssw"), F.array(*(F.var_pop(F.col("x")[i]) for i in range(dim))).alias("var"))


def cluster_lists(c: DataFrame, dim: int) -> DataFrame:
    """(keys, cs, big_n, k, mu_all): the clusters of each data set as one array of (label, n, mu, ssw), and its centre."""
    middle = F.array(*(F.sum(F.col("mu")[i] * F.col("n")) / F.sum("n") for i in range(dim)))
    cs = F.sort_array(F.collect_list(F.struct("label", "n", "mu", "ssw")))
    return c.groupBy(*KEYS).agg(cs.alias("cs"), F.sum("n").alias("big_n"), F.count(F.lit(1)).alias("k"), middle.alias("mu_all"))


def cluster_stats(p: DataFrame, dim: int, metric: str = "euclidean") -> DataFrame:
    """(keys, label, n, mu, big_n, k, mu_all, ssw, sd, sd_all): sums of squared and plain distances to the centroid, and to the centre.

    Two scans of the points: one for the centroids, one for the distances.
    """
    scratch = Scratch(p.sparkSession)
    about = scratch.keep(cluster_lists(centroids(p, dim), dim).select(*KEYS, "big_n", "k", "mu_all", F.explode("cs").alias("c")).select(*KEYS, "c.*", "big_n", "k", "mu_all"))
    joined = attach(p.select(*KEYS, "row_id", "label", "x"), about.select(*KEYS, "label", "mu", "mu_all"), [*KEYS, "label"], 2 * dim)
    d, d_all = (dist(F.col("x"), F.col(to), dim, metric) for to in ("mu", "mu_all"))
    sums = joined.groupBy(*KEYS, "label").agg(F.sum(d).alias("sd"), F.sum(d_all).alias("sd_all"))
    return about.join(sums, [*KEYS, "label"])


def covariances(p: DataFrame, dim: int) -> DataFrame:
    """(keys, label, n, mu, cov): sample covariance matrices, row by row."""
    cov = F.array(*(F.covar_samp(F.col("x")[i], F.col("x")[j]) for i in range(dim) for j in range(dim)))
    return p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(F.col("x")[i]) for i in range(dim))).alias("mu"), cov.alias("cov"))


def medoids(p: DataFrame, dim: int) -> DataFrame:
    """(keys, label, medoid_id, medoid): the point of least squared distance to its cluster, the first on a tie.

    The sum of squared distances to all members is n times the squared distance to the mean plus a constant, so the nearest
    point to the mean is the medoid: linear, not quadratic. Rounding keeps exact ties (two-point clusters) ties.
    """
    c = centroids(p, dim).select(*KEYS, "label", "mu")
    near = attach(p, c, [*KEYS, "label"], dim).withColumn("d", F.round(sq_dist(F.col("x"), F.col("mu"), dim), 12))
    return near.groupBy(*KEYS, "label").agg(F.min(F.struct("d", "row_id", "x")).alias("m")).select(*KEYS, "label", F.col("m.row_id").alias("medoid_id"), F.col("m.x").alias("medoid"))


def overall_medoid(p: DataFrame, dim: int) -> DataFrame:
    """(keys, medoid_id, medoid) over all points."""
    return medoids(p.withColumn("label", F.lit(0)), dim).drop("label")


def with_centroid_list(p: DataFrame, c: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Points with the centroids of their keys (and extra columns of c) as one array: each point is compared where it is, nothing is exploded.

    The array holds one entry a cluster; it is the only thing joined to the points.
    """
    lists = c.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("label", "mu", "n", *extra))).alias("cs"))
    return attach(p, lists, KEYS, F.size("cs") * (F.size(F.col("cs")[0]["mu"]) + 4))


def centroid_pairs(s: DataFrame, dim: int, extra: tuple[str, ...] = (), metric: str = "euclidean") -> DataFrame:
    """Unordered pairs of clusters of the same keys: (keys, li, lj, d2, dc, and extra columns with _i and _j).

    The clusters of a key are gathered once and paired there, so ``s`` is worked out once.
    """
    listed = s.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("label", "mu", *extra))).alias("cs"))
    first = listed.select(*KEYS, "cs", F.explode("cs").alias("i"))
    both = first.select(*KEYS, "i", F.explode(F.filter("cs", lambda c: c["label"] > F.col("i.label"))).alias("j"))
    named = both.select(*KEYS, F.col("i.label").alias("li"), F.col("j.label").alias("lj"), F.col("i.mu").alias("mu_i"), F.col("j.mu").alias("mu_j"), *(F.col(f"{e}.{c}").alias(f"{c}_{e}") for c in extra for e in ("i", "j")))
    far = named.withColumn("d2", sq_dist_of_few(F.col("mu_i"), F.col("mu_j")))
    return far.withColumn("dc", F.sqrt("d2") if metric == "euclidean" else dist(F.col("mu_i"), F.col("mu_j"), dim, metric))


def contingency(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, t, p, nij): counts of label pairs, null labels left out."""
    keys = keys or []
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("nij"))


def majority(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, t, best): the most frequent p of each t, the smallest on a tie."""
    return table.groupBy(*(keys or []), "t").agg(F.min_by("p", F.struct(-F.col("nij"), F.col("p"))).alias("best"))


def percent_change(start, end):
    """(end / start - 1) x 100; null where start is 0."""
    return (F.try_divide(end, start) - 1) * 100


def minmax_by(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """value scaled to [0, 1] within keys; 0 where it is constant."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(0.0)))


