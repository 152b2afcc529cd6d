"""Internal indices from all pairs of points, over the blocked pair pass.

Every index is one row (dataset, labelset, value); undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohesia.functions.internal import ratio
from cohesia.functions.vectors import dist
from cohesia.operators import leaves
from cohesia.operators import pairs as pp
from cohesia.operators.attach import attach
from cohesia.operators.frames import KEYS
from cohesia.operators.stats import centroid_pairs, centroids, with_centroid_list
from cohesia.session import Scratch

C = F.col


def _own_other(st: DataFrame) -> DataFrame:
    """(keys, row_id, label, a, b, near, far, diameter): mean and nearest distance in the own cluster and over others."""
    same = C("other") == C("label")
    mean = C("sum_d") / C("n")
    return st.groupBy(*KEYS, "row_id", "label").agg(
        F.max(F.when(same & (C("n") > 0), mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"), F.min(F.when(same, C("min_d"))).alias("near"), F.min(F.when(~same, C("min_d"))).alias("far"),
        F.max(F.when(same, C("max_d"))).alias("diameter"), F.sum("kernel").alias("kernel"),
    )


def silhouette(p: DataFrame, dim: int) -> DataFrame:
    """Mean silhouette; 0 for points alone in their cluster; null for one cluster."""
    sizes = p.groupBy(*KEYS, C("label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    mean = attach(pp.distinct_sums(p, dim=dim), sizes, [*KEYS, "other"])
    same = C("other") == C("label")
    q = mean.groupBy(*KEYS, "row_id", "label", "m").agg(F.max(F.when(same & (C("n") > 1), C("sum_d") / (C("n") - 1))).alias("a"), F.min(F.when(~same, C("sum_d") / C("n"))).alias("b"))
    one = F.when(C("a").isNull(), 0.0).otherwise(F.coalesce(ratio(C("b") - C("a"), F.greatest("a", "b")), F.lit(0.0)))
    return q.groupBy(*KEYS).agg(F.when(F.count("b") > 0, F.sum(one * C("m")) / F.sum("m")).alias("value"))


def dunn_paper(p: DataFrame, dim: int) -> DataFrame:
    """Least distance between points of different clusters over the largest diameter."""
    q = _own_other(pp.pair_stats(p))
    return q.groupBy(*KEYS).agg(ratio(F.min("far"), F.max("diameter")).alias("value"))


def dunn(p: DataFrame, dim: int) -> DataFrame:
    """Least distance from a centroid to the points of a later cluster over the largest diameter, as the published scores have it."""
    widest = _own_other(pp.pair_stats(p)).groupBy(*KEYS).agg(F.max("diameter").alias("w"))
    q = with_centroid_list(p, centroids(p, dim))
    near = F.array_min(F.transform(F.filter("cs", lambda c: c["label"] < C("label")), lambda c: dist(C("x"), c["mu"], dim)))
    least = q.select(*KEYS, near.alias("d")).groupBy(*KEYS).agg(F.min("d").alias("d"))
    return least.join(widest, KEYS).select(*KEYS, ratio(C("d"), C("w")).alias("value"))


def duda_hart(p: DataFrame, dim: int) -> DataFrame:
    """Mean over clusters of the mean distance inside (each point to itself counted) over the mean of that to all others."""
    same = C("other") == C("label")
    by = pp.pair_stats(p).groupBy(*KEYS, "label").agg(F.sum(F.when(same, C("sum_d")).otherwise(0.0)).alias("si"), F.sum(F.when(~same, C("sum_d"))).alias("so"), F.sum(F.when(~same, C("n"))).alias("no"))
    sizes = p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("nk"))
    means = sizes.join(by, [*KEYS, "label"], "left")
    return means.groupBy(*KEYS).agg(ratio(F.sum(F.coalesce("si", F.lit(0.0)) / (C("nk") * C("nk"))), F.sum(C("so") / C("no"))).alias("value"))


def cs(p: DataFrame, dim: int) -> DataFrame:
    """Mean farthest member distances over least centroid distances."""
    far = _own_other(pp.pair_stats(p)).groupBy(*KEYS, "label").agg(F.avg(F.coalesce("diameter", F.lit(0.0))).alias("m")).groupBy(*KEYS).agg(F.sum("m").alias("top"))
    pairs = centroid_pairs(centroids(p, dim), dim)
    least = pairs.select(*KEYS, F.explode(F.array("li", "lj")).alias("label"), "dc").groupBy(*KEYS, "label").agg(F.min("dc").alias("d")).groupBy(*KEYS).agg(F.sum("d").alias("bottom"))
    return far.join(least, KEYS, "left").select(*KEYS, F.when(C("bottom") == 0, float("inf")).otherwise(C("top") / C("bottom")).alias("value"))


def c_index(p: DataFrame, dim: int, metric: str = "euclidean", compat: bool = True) -> DataFrame:
    """(S - Smin) / (Smax - Smin), S over pairs inside clusters, Smin and Smax over as many least and largest pairs.

    Exact for any number of pairs: sums come from histograms whose boundary bin is refined until it holds one value
    (or no width), so pairs are never sorted. With all clusters single, 0 (compat) or null.
    """
    scratch = Scratch(p.sparkSession)
    q = scratch.keep(pp.pair_stats(p, metric))
    whole = q.groupBy(*KEYS).agg(
        F.sum(F.when(C("other") == C("label"), C("sum_d")).otherwise(0.0)).alias("sw"), F.sum(F.when(C("other") == C("label"), C("n")).otherwise(0)).alias("nw"), F.sum("n").alias("nt"), F.min("min_d").alias("low"), F.max("max_d").alias("high"), F.sum("sum_d").alias("all"),
    )
    made = scratch.keep(pp.blocks(p))
    out = []
    for r in whole.collect():  # one row for each data set and label set
        sw, nw, nt = r["sw"] / 2, r["nw"] // 2, r["nt"] // 2
        own = made.where((C("dataset") == r["dataset"]) & (C("labelset") == r["labelset"]))
        value = None
        if nw == 0:
            value = 0.0 if compat and nt else None
        elif nw < nt:
            first = _histogram(own, r["low"], r["high"], metric)
            least = _least_sum(own, r["low"], r["high"], nw, metric, first)
            largest = r["all"] / 2 - _least_sum(own, r["low"], r["high"], nt - nw, metric, first)
            value = (sw - least) / (largest - least) if largest > least else None
        out.append((r["dataset"], r["labelset"], value))
    return p.sparkSession.createDataFrame(out, "dataset string, labelset string, value double")


def _histogram(made: DataFrame, low: float, high: float, metric: str) -> list[tuple[int, int, float]]:
    return sorted((b["bin"], b["n"], b["s"]) for b in pp.pair_histogram(made, low, high, metric).collect())  # BINS rows at most


def _least_sum(made: DataFrame, low: float, high: float, count: int, metric: str, bins: list[tuple[int, int, float]]) -> float:
    """Sum of the count smallest pair distances, from the histogram between low and high.

    The boundary bin is refined until all its distances could be off by its width without changing the sum's last digits.
    """
    while True:  # each round narrows the boundary bin by a factor of BINS
        done, seen = 0.0, 0
        for k, n, s in bins:
            if seen + n > count:
                rest = count - seen
                width = (high - low) / pp.BINS
                if rest == 0:
                    return done
                if n == 1 or k in (-1, pp.BINS) or width <= 1e-12 * max(1.0, abs(high)) or n * width <= 1e-14 * done:
                    return done + rest * s / n
                low, high = low + k * width, low + (k + 1) * width
                bins = _histogram(made, low, high, metric)
                break
            done, seen = done + s, seen + n
        else:
            return done


def reflections(p: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(points with ps, centroids): the symmetry distance of each point in its cluster."""
    c = centroids(p, dim)
    about = p.join(c.select(*KEYS, "label", "mu"), [*KEYS, "label"])
    mirror = about.select(*KEYS, "row_id", F.array(*(2 * C("mu")[i] - C("x")[i] for i in range(dim))).alias("x"), "label")
    near = pp.nearest_reflected(p, mirror)
    d = about.select(*KEYS, "row_id", dist(C("x"), C("mu"), dim).alias("d"))
    return near.join(d, [*KEYS, "row_id"]).select(*KEYS, "row_id", "label", (C("mean_k") * C("d")).alias("ps")), c


def sym(p: DataFrame, dim: int) -> DataFrame:
    """Largest centroid distance over clusters times the sum of symmetry distances."""
    ps, c = reflections(p, dim)
    s = ps.groupBy(*KEYS).agg(F.sum("ps").alias("s"), F.count_distinct("label").alias("k"), F.sum(C("ps").isNull().cast("int")).alias("bad"))
    far = centroid_pairs(c, dim).groupBy(*KEYS).agg(F.max("dc").alias("m"))
    return s.join(far, KEYS, "left").select(*KEYS, F.when(C("bad") == 0, ratio(C("m"), C("k") * C("s"))).alias("value"))


def sym_db(p: DataFrame, dim: int) -> DataFrame:
    """Sum over pairs of clusters of mean symmetry distances over centroid distance, by the number of clusters."""
    ps, c = reflections(p, dim)
    mean = ps.groupBy(*KEYS, "label").agg(F.avg("ps").alias("s"), F.sum(C("ps").isNull().cast("int")).alias("bad"))
    pairs = centroid_pairs(c.join(mean, [*KEYS, "label"]), dim, ("s", "bad"))
    k = c.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"))
    total = pairs.groupBy(*KEYS).agg(F.sum(ratio(C("s_i") + C("s_j"), C("dc"))).alias("s"), F.sum(C("bad_i") + C("bad_j")).alias("bad"))
    return k.join(total, KEYS, "left").select(*KEYS, F.when(C("bad") == 0, C("s") / C("k")).alias("value"))


def sym33(p: DataFrame, dim: int) -> DataFrame:
    """Least mean distance between two clusters over twice the largest mean symmetry distance."""
    ps, _ = reflections(p, dim)
    inner = ps.groupBy(*KEYS, "label").agg((2 * F.avg("ps")).alias("m"), F.sum(C("ps").isNull().cast("int")).alias("bad")).groupBy(*KEYS).agg(F.max("m").alias("m"), F.sum("bad").alias("bad"))
    between = pp.pair_stats(p).where("label < other").groupBy(*KEYS, "label", "other").agg((F.sum("sum_d") / F.sum("n")).alias("d")).groupBy(*KEYS).agg(F.min("d").alias("d"))
    return inner.join(between, KEYS, "left").select(*KEYS, F.when(C("bad") == 0, ratio(C("d"), C("m"))).alias("value"))


def cop(p: DataFrame, dim: int) -> DataFrame:
    """Cohesion over separation as published in code: separation is measured to the first K - 1 rows only."""
    c = centroids(p, dim)
    inner = p.join(c.select(*KEYS, "label", "mu"), [*KEYS, "label"]).groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.avg(dist(C("x"), C("mu"), dim)).alias("m"))
    k = c.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k"))
    head = _first_rows(p, k)  # K - 1 rows a key
    far = p.select(*KEYS, "label", "x").join(F.broadcast(head), KEYS).groupBy(*KEYS, "label", "pos").agg(F.max(dist(C("x"), C("hx"), dim)).alias("d")).groupBy(*KEYS, "label").agg(F.min("d").alias("sep"))
    return inner.join(far, [*KEYS, "label"], "left").groupBy(*KEYS).agg((F.sum(C("n") * ratio(C("m"), C("sep"))) / F.sum("n")).alias("value"))


def _first_rows(p: DataFrame, k: DataFrame) -> DataFrame:
    """(keys, pos, hx): the first K - 1 rows of each key by row_id."""
    top = max((r["k"] for r in k.collect()), default=1)
    ranked = p.select(*KEYS, "row_id", "x").withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy("row_id"))).where(C("pos") < top)
    return ranked.join(k, KEYS).where("pos < k").select(*KEYS, "pos", C("x").alias("hx"))


def cop_paper(p: DataFrame, dim: int) -> DataFrame:
    """Cohesion over separation as in the paper: the least, over points outside, of the farthest member."""
    c = centroids(p, dim)
    inner = p.join(c.select(*KEYS, "label", "mu"), [*KEYS, "label"]).groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.avg(dist(C("x"), C("mu"), dim)).alias("m"))
    sep = pp.pair_stats(p).where("label <> other").groupBy(*KEYS, C("other").alias("label")).agg(F.min("max_d").alias("sep"))
    return inner.join(sep, [*KEYS, "label"], "left").groupBy(*KEYS).agg((F.sum(C("n") * ratio(C("m"), C("sep"))) / F.sum("n")).alias("value"))


def _viasckde_points(p: DataFrame, dim: int, bandwidth: float) -> DataFrame:
    """(keys, row_id, label, one): compactness against separation, weighted by density scaled within the cluster."""
    scratch = Scratch(p.sparkSession)  # points and pairs are worked out once, though both are read twice
    kept = scratch.keep(p)
    many = leaves.fits(kept, dim) and leaves.kernel_fits(kept, dim, bandwidth)
    met = leaves.nearest_and_kernel(kept, dim, bandwidth) if many else _own_other(pp.pair_stats(kept, bandwidth=bandwidth))
    q = scratch.keep(met.withColumn("density", F.log("kernel")))
    range_of = q.groupBy(*KEYS, "label").agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    w = q.join(range_of, [*KEYS, "label"]).withColumn("weight", F.when(C("hi") > C("lo"), (C("density") - C("lo")) / (C("hi") - C("lo"))).otherwise(0.0))
    return w.select(*KEYS, "row_id", "label", (ratio(C("far") - C("near"), F.greatest("far", "near")) * C("weight")).alias("one"))


def viasckde(p: DataFrame, dim: int, bandwidth: float = 0.05) -> DataFrame:
    """Mean over points; null for one cluster or a cluster of one."""
    q = _viasckde_points(p, dim, bandwidth)
    return q.groupBy(*KEYS).agg(F.when(F.count("one") == F.count(F.lit(1)), F.avg("one")).alias("value"))


def viasckde_cumulative(p: DataFrame, dim: int, bandwidth: float = 0.05) -> DataFrame:
    """The first published form: running sums over clusters in label order are summed and divided by summed running counts."""
    by = _viasckde_points(p, dim, bandwidth).groupBy(*KEYS, "label").agg(F.sum("one").alias("s"), F.count(F.lit(1)).alias("n"), F.count("one").alias("ok"))
    w = Window.partitionBy(*KEYS).orderBy("label").rowsBetween(Window.unboundedPreceding, 0)  # one row a cluster
    run = by.select(*KEYS, F.sum("s").over(w).alias("rs"), F.sum("n").over(w).alias("rn"), (C("ok") == C("n")).alias("ok"))
    return run.groupBy(*KEYS).agg(F.when(F.min("ok"), F.sum("rs") / F.sum("rn")).alias("value"))


#: name -> (plan, whether higher is better)
PAIRWISE = {
    "silhouette": (silhouette, True), "c_index": (c_index, False), "cs": (cs, False), "dunn": (dunn, True), "dunn_paper": (dunn_paper, True), "duda_hart": (duda_hart, False), "sym": (sym, True), "sym_db": (sym_db, False), "sym33": (sym33, True),
    "cop": (cop, False), "cop_paper": (cop_paper, False), "viasckde": (viasckde, True), "viasckde_cumulative": (viasckde_cumulative, True),
}
