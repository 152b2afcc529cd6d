"""Queries of the driver contract over the relational tables. Every float is rounded, as in the SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.functions import external
from cohesia.functions.density import cdbw, dbcv
from cohesia.functions.internal import LINEAR, imbalance_ratio, overlap_ratio
from cohesia.functions.pairwise import PAIRWISE
from cohesia.functions.tree import mst_calinski_harabasz, mst_davies_bouldin, mst_separation_ratio, mst_silhouette
from cohesia.operators import edging, frames, grid, kmeans, mst, pairs, stats
from cohesia.plans import analyses, registry
from cohesia.sources import generators, readers, report
from cohesia.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
C = F.col
#: point frame -> (reader, dimensions)
FRAMES = {"embeddings": (readers.embeddings, 64), "part": (readers.parts, 2), "supplier": (readers.suppliers, 2), "lineitem": (readers.lineitems, 2), "customer": (readers.customers, 2)}
#: pairs of labellings: name -> (table, true, predicted)
PAIRS = {"labels": ("labels", "quality", "toxic"), "lineitem": ("lineitem", "l_returnflag", "l_linestatus"), "orders": ("orders", "o_orderstatus", "o_orderpriority"), "documents": ("documents", "lang", "source")}
#: Decimals of indices with very large values over the unscaled line items.
LARGE = {"sse": -4, "bh": -4, "xb": -2, "xb_star": -3}
LABEL_SET_METRICS = ("ch", "db", "sse", "xb", "wb", "bh", "rs")


def rounded(column: str, digits: int = 6):
    return F.round(C(column).cast("double"), digits).alias(column)


def frame(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    read, dim = FRAMES[name]
    return read(spark, sf_dir), dim


def _index(plan, name: str, scaled: bool = False, digits: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, dim = frame(spark, sf_dir, name)
        if scaled:
            p = frames.minmax_scale(frames.dedup(p), dim)
        return plan(p, dim).select(rounded("value", digits))

    return run


def dedup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "part")
    return frames.dedup(p).select("row_id", C("x")[0].alias("x0"), C("x")[1].alias("x1"), C("label").cast("long").alias("label"))


def reencode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.points(spark.read.parquet(f"{sf_dir}/part.parquet"), C("p_partkey"), F.array(C("p_retailprice")), C("p_size"))
    return frames.reencode(p).select("row_id", C("label").cast("long").alias("label"))


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(p, dim)
    return q.select("row_id", F.round(C("x")[0], 6).alias("x0"), F.round(C("x")[1], 6).alias("x1"))


def label_sets_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    return frames.line_label_sets(p).groupBy("labelset", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids")).select("labelset", C("label").cast("long").alias("label"), "n", "ids")


def label_sets_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    return frames.midpoint_label_sets(p).select("labelset", "row_id", C("label").cast("long").alias("label"))


def singleton_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.points(spark.read.parquet(f"{sf_dir}/supplier.parquet"), C("s_suppkey"), F.array(C("s_acctbal")), F.floor(C("s_acctbal") / 50))
    return frames.singletons_to_noise(p).select("row_id", C("label").cast("long").alias("label"))


def cluster_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = stats.covariances(p, dim)
    return q.select(C("label").cast("long").alias("label"), "n", *(F.round(C("mu")[i], 8).alias(f"mean{i}") for i in range(2)), F.round(C("cov")[0], 4).alias("var0"), F.round(C("cov")[1], 4).alias("cov01"), F.round(C("cov")[3], 4).alias("var1"))


def centroid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "embeddings")
    return stats.centroids(p, dim).select(C("label").cast("long").alias("label"), "n", F.posexplode("mu").alias("dim", "mean")).select("label", "n", C("dim").cast("long").alias("dim"), rounded("mean"))


def medoid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "embeddings")
    return stats.medoids(p, dim).select(C("label").cast("long").alias("label"), "medoid_id")


def _external(score, pair: str, method: str | None = None) -> Query:
    table, t, p = PAIRS[pair]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        out = score(external.contingency(df, t, p), []) if method is None else external.balanced_external(df, t, p, score, method)
        return out.select(rounded("value"))

    return run


def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.contingency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "source")


def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.majority(contingency(spark, sf_dir))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    q = q.unionByName(frames.line_label_sets(q))
    return analyses.score_table(q, dim, LABEL_SET_METRICS).select("labelset", "metric", rounded("value"))


def flagged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    q = q.unionByName(frames.line_label_sets(q))
    return report.flags(analyses.score_table(q, dim, LABEL_SET_METRICS)).select("labelset", "metric", F.bround("value", 3).alias("value"), "flagged")


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    q = q.unionByName(frames.line_label_sets(q))
    return report.score_report(analyses.score_table(q, dim, LABEL_SET_METRICS), ["gt", "dfl", "dsl", "vl", "hl"]).drop("dataset")


def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "supplier")
    return mst.mst_edges(p).select("u", "v", rounded("w"))


def bottleneck_to_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    targets = stats.medoids(p, dim).select(*frames.KEYS, C("medoid_id").alias("target"))
    return mst.bottleneck_to(p, mst.mst_edges(p), targets).select("row_id", "target", rounded("d"))


def _tree(plan, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p, dim = frame(spark, sf_dir, "supplier")
        return plan(p, dim, **kwargs).select(rounded("value"))

    return run


def knn_prim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "supplier")
    return mst.mst_edges(p, "knn_prim", 5).select("u", "v", rounded("w"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    _, leaves = grid.grid_points(frames.minmax_scale(frames.dedup(p), dim), dim, 8, 8)
    return leaves.select("cell", C("depth").cast("long").alias("depth"), "n", *(F.round(C(b)[i], 6).alias(f"{b}{i}") for b in ("lo", "hi") for i in range(2)), rounded("volume"), rounded("density", 4))


def grid_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    settled, _ = grid.grid_points(q, dim, 8, 8)
    return grid.cell_labels(q, settled).select("cell", "n", rounded("purity"), rounded("impurity"), C("majority").cast("long").alias("majority"))


def grid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    return grid.grid_score(frames.minmax_scale(frames.dedup(p), dim), dim).select(*(rounded(c) for c in ("separation", "purity", "impurity", "normalized", "value")))


def grid_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    return grid.grid_diagnostics(frames.minmax_scale(frames.dedup(p), dim), dim).drop(*frames.KEYS)


def dbcv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    return dbcv(frames.minmax_scale(frames.dedup(p), dim), dim, check_duplicates=False).select(rounded("value"))


def cdbw_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    return cdbw(frames.minmax_scale(frames.dedup(p), dim), dim).select(rounded("value"))


def kmeans_lloyd_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    return kmeans.lloyd(q, dim, kmeans.first_rows(q, 4), 3).select("row_id", C("label").cast("long").alias("label"))


def kmeans_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    return kmeans.kmeans(frames.minmax_scale(frames.dedup(p), dim), dim, 4, 20).select("row_id", C("label").cast("long").alias("label"))


def estimate_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    return analyses.estimate_k(frames.minmax_scale(frames.dedup(p), dim), dim, true_k=5)


def edging_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    m = stats.medoids(p, dim).select(*frames.KEYS, C("medoid_id").alias("e"))
    return edging.edging_distances(p, p.select(*frames.KEYS, C("row_id").alias("s")).join(m, frames.KEYS)).select("s", "e", rounded("d"))


def ed_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "supplier")
    return edging.ed_kmeans(frames.minmax_scale(frames.dedup(p), dim), dim, 3).select("row_id", C("label").cast("long").alias("label"))


def overlap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.measure_sweep(spark, "overlap")


def imbalance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.measure_sweep(spark, "imbalance", per_cluster=300, steps=10).select("step", rounded("value"))


def analyse_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.analyse_measure(spark, "imbalance")


def external_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "customer")
    shapes = [(int(r["n"]), r["mu"], (r["cov"][0], r["cov"][1], r["cov"][3])) for r in stats.covariances(p, dim).orderBy("label").collect()]  # one row a cluster
    return analyses.external_sweep(spark, shapes, [0, 1, 2], [3, 4])


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "customer")
    return analyses.merged_labels(p, 2).select("index", rounded("value"))


def generated_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [g(spark, 200) for g in generators.GENERATORS.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


def bind_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "part")
    q = p.withColumn("label", F.when(C("row_id") % 7 == 0, -1).otherwise(C("label")).cast("int"))
    return pairs.bind_noise(q).select("row_id", C("label").cast("long").alias("label"))


def comb_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "lineitem")
    q = p.withColumn("label", F.when(C("label") == 0, -1).otherwise(C("label")).cast("int"))
    return frames.comb_noise(q).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(C("label").cast("long").alias("label"), "n")


def plane_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "embeddings")
    kinds = {"vertical": {}, "horizontal": {}, "sloped": {"p": (0.1, 0.0, 0.0), "v1": (1, 2, 0), "v2": (0, 1, 3)}}
    return p.select("row_id", *(frames.plane_side(C("x"), kind, **args).cast("long").alias(kind) for kind, args in kinds.items()))


def random_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "part")
    return frames.label_sets(p).groupBy("labelset", "label").agg(F.count(F.lit(1)).alias("n"))


def randomise_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, _ = frame(spark, sf_dir, "customer")
    return frames.randomise_minority(p, [3, 4], 5).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("low"), F.avg("o_totalprice").alias("mid"))
    return by.select("o_orderpriority", F.round(stats.percent_change(C("low"), C("mid")), 4).alias("change"))


def plain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "part")
    q = frames.minmax_scale(frames.dedup(p), dim)
    q = q.unionByName(frames.line_label_sets(q))
    return report.plain_report(analyses.score_table(q, dim, LABEL_SET_METRICS), ["gt", "dfl", "dsl", "vl", "hl"]).drop("dataset")


def running_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "lineitem")
    out = incremental.indices(incremental.running_stats(p, dim), dim)
    return out.select(rounded("sse", LARGE["sse"]), rounded("ch", 3), rounded("wb", 3), rounded("bh", LARGE["bh"]))


def user_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register("largest_share", lambda x, labels: float(np.bincount(labels).max()) / len(labels))
    p, dim = frame(spark, sf_dir, "customer")
    return analyses.score_table(p, dim, ["largest_share"]).select("metric", rounded("value"))


def pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, dim = frame(spark, sf_dir, "embeddings")
    q = kmeans.project_2d(p)
    return q.select("row_id", F.round(F.abs(C("x")[0]), 4).alias("x0"), F.round(F.abs(C("x")[1]), 4).alias("x1"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, (plan, _) in LINEAR.items():
        out[name] = _index(plan, "embeddings")
        if name not in ("rcip",):
            out[f"{name}_lineitem"] = _index(plan, "lineitem", digits=LARGE.get(name, 4))
    out["rcip"] = _index(LINEAR["rcip"][0], "customer", scaled=True)
    out |= {"imbalance_ratio": _index(imbalance_ratio, "lineitem"), "overlap_ratio": _index(overlap_ratio, "embeddings"), "overlap_ratio_lineitem": _index(overlap_ratio, "lineitem")}
    for name, (plan, _) in PAIRWISE.items():
        out[name] = _index(plan, "customer" if name.startswith("viasckde") else "embeddings", scaled=name.startswith("viasckde"))
    out["silhouette_customer"] = _index(PAIRWISE["silhouette"][0], "customer")
    for pair in PAIRS:
        out[f"ari_{pair}"] = _external(external.ari_of, pair)
    for pair in ("labels", "documents"):
        out[f"ami_{pair}"] = _external(external.ami_of, pair)
    out |= {f"balanced_ari_{m}": _external(external.ari_of, "documents", m) for m in external.METHODS}
    out["balanced_ami"] = _external(external.ami_of, "documents", "macro")

    def on_documents(f, **kwargs) -> Query:
        return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "source", **kwargs).select(rounded("value"))

    out |= {"pairwise_classes_all": on_documents(external.pairwise_classes), "pairwise_classes_within": on_documents(external.pairwise_classes, mode="within_between"), "minmax_balanced": on_documents(external.minmax_balanced)}
    out |= {"stratified_subsample": on_documents(external.stratified_subsample, row_id="doc_id"), "weighted_bootstrap": on_documents(external.weighted_bootstrap, row_id="doc_id")}
    out |= {"mst_s": _tree(mst_silhouette), "mst_db": _tree(mst_davies_bouldin), "mst_ch": _tree(mst_calinski_harabasz), "mst_sep_ratio": _tree(mst_separation_ratio)}
    out |= {f"mst_{n}_first": _tree(f, version="first") for n, f in (("s", mst_silhouette), ("db", mst_davies_bouldin), ("ch", mst_calinski_harabasz))} | {"mst_idea": _tree(mst_separation_ratio, version="first")}
    out |= {f"mst_{n}_third": _tree(f, version="third") for n, f in (("s", mst_silhouette), ("db", mst_davies_bouldin), ("ch", mst_calinski_harabasz))}
    out |= {f"mst_{n}_knn": _tree(f, mode="knn_prim") for n, f in (("s", mst_silhouette), ("db", mst_davies_bouldin), ("ch", mst_calinski_harabasz), ("sep_ratio", mst_separation_ratio))}
    out |= {"ed_s": _tree(edging.ed_silhouette), "ed_db": _tree(edging.ed_davies_bouldin), "ed_ch": _tree(edging.ed_calinski_harabasz)}
    own = (
        dedup_points, reencode_labels, minmax_scale, label_sets_lines, label_sets_midpoint, singleton_noise, cluster_moments, centroid_table, medoid_table, contingency, majority, score_table, flagged_metrics, score_report,
        mst_edges, bottleneck_to_medoid, knn_prim_edges, grid_cells, grid_purity, grid_score, grid_diagnostics, kmeans_lloyd_fixed, kmeans_plus_plus, estimate_k, edging_distance, ed_kmeans,
        overlap_sweep, imbalance_sweep, analyse_imbalance, external_sweep, merged_labels, generated_shapes, bind_noise, comb_noise, plane_sides, random_label_sets, randomise_minority,
        percent_change, plain_report, running_indices, user_metric, pca_plane,
    )
    return out | {f.__name__: f for f in own} | {"dbcv": dbcv_index, "cdbw": cdbw_index}
