"""Score tables and sweeps: many data sets, label sets and metrics in few plans."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.functions import external
from cohesia.functions.internal import FROM_BASE, imbalance_ratio, many_from_base, overlap_ratio
from cohesia.functions.pairwise import silhouette
from cohesia.operators import frames
from cohesia.operators.frames import KEYS
from cohesia.operators.kmeans import ml_kmeans
from cohesia.operators.stats import centroids
from cohesia.plans.registry import metric
from cohesia.session import Scratch
from cohesia.sources import generators

C = F.col


def score_table(p: DataFrame, dim: int, metrics: Sequence[str]) -> DataFrame:
    """(dataset, labelset, metric, higher, value): one plan a metric scores all data sets and label sets; metrics of cluster moments share one scan."""
    parts = []
    shared = [name for name in metrics if name in FROM_BASE]
    if shared:
        way = F.create_map(*(F.lit(x) for name in shared for x in (name, metric(name)[1])))
        parts.append(many_from_base(p, dim, shared).select(*KEYS, "metric", way[C("metric")].alias("higher"), "value"))
    for name in (name for name in metrics if name not in FROM_BASE):
        plan, higher = metric(name)
        parts.append(plan(p, dim).select(*KEYS, F.lit(name).alias("metric"), F.lit(higher).alias("higher"), C("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def timed_score_table(p: DataFrame, dim: int, metrics: Sequence[str]) -> DataFrame:
    """The same with seconds, the mean wall-clock time a label set; a metric that fails has null values."""
    scratch = Scratch(p.sparkSession)
    keys = scratch.keep(p.select(*KEYS).distinct())
    many, parts = max(keys.count(), 1), []
    for name in metrics:
        plan, higher = metric(name)
        began = time.time()
        try:
            values = scratch.keep(plan(p, dim).select(*KEYS, C("value").cast("double").alias("value")))
        except Exception as problem:  # one metric must not fail the table
            print(f"{name}: {problem}")
            values = keys.withColumn("value", F.lit(None).cast("double"))
        parts.append(keys.join(values, KEYS, "left").select(*KEYS, F.lit(name).alias("metric"), F.lit(higher).alias("higher"), "value", F.lit((time.time() - began) / many).alias("seconds")))
    return reduce(DataFrame.unionByName, parts)


def prepared(p: DataFrame, dim: int) -> DataFrame:
    """Duplicates removed, labels re-encoded, coordinates scaled to [-1, 1], and all label sets of plane points."""
    scaled = frames.minmax_scale(frames.reencode(frames.dedup(p)), dim)
    return frames.label_sets(scaled) if dim == 2 else scaled.unionByName(frames.random_labels(scaled, 2))


def estimate_k(p: DataFrame, dim: int, min_k: int = 2, max_k: int = 10, true_k: int | None = None, score: str = "silhouette", starts: int = 10) -> DataFrame:
    """(k, score, is_estimated_k, is_true_k) of k-means for each k; the estimate has the best score, the least k on a tie."""
    n = p.count()
    if min_k < 2 or max_k > n - 1 or true_k is not None and true_k < 2:
        raise ValueError("k must lie in 2 to n - 1")
    plan, higher = metric(score)
    scratch = Scratch(p.sparkSession)
    p = scratch.keep(p)
    labelled = [ml_kmeans(p, k, starts).withColumn("labelset", F.lit(str(k))) for k in range(min_k, max_k + 1)]
    scores = scratch.keep(plan(reduce(DataFrame.unionByName, labelled).select(*KEYS, "row_id", "x", "label"), dim).select(C("labelset").cast("int").alias("k"), C("value").alias("score")))
    best = scores.agg(F.min_by("k", F.struct(-C("score") if higher else C("score"), C("k")))).first()[0]
    is_true = (C("k") == true_k) if true_k else F.lit(False)
    return scores.select("k", "score", (C("k") == best).alias("is_estimated_k"), is_true.alias("is_true_k"))


def _steps(frames_by_step: list[DataFrame]) -> DataFrame:
    """Step i's points become data set i."""
    return reduce(DataFrame.unionByName, [f.withColumn("dataset", F.lit(str(i))) for i, f in enumerate(frames_by_step)])


def _linspace(a: float, b: float, n: int) -> list[float]:
    return [a + (b - a) * i / (n - 1) for i in range(n)]


def analysis_steps(spark: SparkSession, measure: str, per_cluster: int = 300, steps: int = 20, seed: int = 42) -> DataFrame:
    """Three clusters, step by step smaller in one (imbalance) or closer in two (overlap)."""
    if measure == "imbalance":
        sizes = [int(v) for v in _linspace(per_cluster, int(per_cluster * 0.1), steps)]
        return _steps([generators.analysis_clusters(spark, [(0, 0), (5, 0), (2.5, 4)], [per_cluster, per_cluster, s], seed=seed + i) for i, s in enumerate(sizes)])
    if measure == "overlap":
        return _steps([generators.analysis_clusters(spark, [(0, 0), (d, 0), (3, 5)], [per_cluster] * 3, seed=seed + i) for i, d in enumerate(_linspace(6, 1, steps))])
    raise ValueError(f"Unknown measure: {measure}")


MEASURES = {"imbalance": imbalance_ratio, "overlap": overlap_ratio}


def measure_sweep(spark: SparkSession, measure: str, **kwargs) -> DataFrame:
    """(step, value) of a data-complexity measure along its steps."""
    return MEASURES[measure](analysis_steps(spark, measure, **kwargs), 2).select(C("dataset").cast("int").alias("step"), "value")


def analyse_measure(spark: SparkSession, measure: str, index: str = "silhouette", split: str = "hl", **kwargs) -> DataFrame:
    """(step, measure, score_true, score_split, chosen): the true labels' index against a midpoint split's silhouette.

    chosen marks the first step where the split wins, or else its best step.
    """
    p = analysis_steps(spark, measure, **kwargs)
    plan, _ = metric(index)
    true = plan(p, 2).select("dataset", C("value").alias("score_true"))
    halves = frames.midpoint_label_sets(p).where(C("labelset") == split)
    wrong = silhouette(halves, 2).select("dataset", C("value").alias("score_split"))
    scratch = Scratch(spark)
    rows = scratch.keep(MEASURES[measure](p, 2).select("dataset", C("value").alias("measure")).join(true, "dataset").join(wrong, "dataset").select(C("dataset").cast("int").alias("step"), "measure", "score_true", "score_split"))
    pick = rows.agg(F.min(F.when(C("score_split") > C("score_true"), C("step"))).alias("first"), F.max_by("step", F.struct("score_split", -C("step"))).alias("best")).first()
    chosen = pick["first"] if pick["first"] is not None else pick["best"]
    return rows.withColumn("chosen", C("step") == F.lit(chosen))


def external_sweep(spark: SparkSession, stats, majority: Sequence[int], minority: Sequence[int], scales: Sequence[float] = tuple(range(1, 11)), index=external.ari_of, seed: int = 42) -> DataFrame:
    """(step, imbalance, score, balanced) with the labels of minority clusters drawn anew, for growing minority sizes."""
    p = _steps([generators.multivariate(spark, stats, minority, s, seed + i) for i, s in enumerate(scales)])
    ids = F.array(*map(F.lit, minority))
    drawn = F.element_at(ids, (F.pmod(F.xxhash64("dataset", "row_id", F.lit(seed)), F.lit(len(minority))) + 1).cast("int"))
    both = p.withColumn("drawn", F.when(C("label").isin(list(minority)), drawn).otherwise(C("label")))
    table = external.contingency(both, "label", "drawn", ["dataset"])
    score = index(table, ["dataset"]).withColumnRenamed("value", "score")
    balanced = external.balanced_external(both, "label", "drawn", index, "macro", ["dataset"]).withColumnRenamed("value", "balanced")
    return imbalance_ratio(p).select("dataset", C("value").alias("imbalance")).join(score, "dataset").join(balanced, "dataset").select(C("dataset").cast("int").alias("step"), "imbalance", "score", "balanced")


def merged_labels(p: DataFrame, above: int = 3) -> DataFrame:
    """(index, value): agreement of labels with themselves after the highest ones are merged."""
    both = p.select("label", F.least("label", F.lit(above)).alias("merged"))
    rows = [("ari", external.ari(both, "label", "merged")), ("ami", external.ami(both, "label", "merged"))]
    rows += [(f"balanced_ari_{m}", external.balanced_external(both, "label", "merged", method=m)) for m in external.METHODS]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("index"), "value") for n, df in rows])


def cluster_shapes(p: DataFrame, dim: int) -> DataFrame:
    """(keys, label, n, mu): what plots of centroids are drawn from."""
    return centroids(p, dim)
