"""Internal indices from centroids: linear in the points, quadratic only in the clusters.

Every index is one row (dataset, labelset, value). Labels may be any integers.
An index that is not defined (one cluster, zero separation) is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesia.functions.vectors import dist, sq_dist_of_few
from cohesia.operators.attach import attach
from cohesia.operators.frames import KEYS
from cohesia.operators.stats import centroid_pairs, centroids, cluster_lists, cluster_stats, covariances, with_centroid_list
from cohesia.session import Scratch, ship

C = F.col


def ratio(a: Column | float, b: Column) -> Column:
    return F.try_divide(a if isinstance(a, Column) else F.lit(a), b)


def _msq(c: Column) -> Column:
    return c["ssw"] / c["n"]


def _d2(a: Column, b: Column) -> Column:
    return sq_dist_of_few(a["mu"], b["mu"])


def _sum(values: Column) -> Column:
    """Sum of the values of an array that are not null; null if there are none."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v))


def _over_clusters(value: Callable[[Column], Column]) -> Column:
    return F.transform("cs", value)


def _over_pairs(value: Callable[[Column, Column], Column]) -> Column:
    """value of every unordered pair of clusters."""
    later = lambda a: F.filter("cs", lambda b: b["label"] > a["label"])
    return F.flatten(F.transform("cs", lambda a: F.transform(later(a), lambda b: value(a, b))))


def _over_others(a: Column, value: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter("cs", lambda b: b["label"] != a["label"]), value)


def base(p: DataFrame, dim: int) -> DataFrame:
    """One row for each data set and label set, after one scan: its clusters as an array, and sums over them.

    All indices that need no distances of points but squared ones to their own centroid are expressions over this row.
    """
    row = cluster_lists(centroids(p, dim), dim)
    return row.select(
        *KEYS, "cs", C("big_n").alias("n"), "k", _sum(_over_clusters(lambda c: c["ssw"])).alias("ssw"),
        _sum(_over_clusters(lambda c: c["n"] * sq_dist_of_few(c["mu"], C("mu_all")))).alias("ssb"), F.array_max(_over_clusters(_msq)).alias("max_msq"), _sum(_over_clusters(_msq)).alias("sum_msq"),
    )


def _min_d2() -> Column:
    return F.array_min(_over_pairs(_d2))


def _silhouettes() -> Column:
    """Of each cluster: its mean square against the least mean square of another cluster about this centroid."""

    def one(a: Column) -> Column:
        far = F.array_min(_over_others(a, lambda b: _msq(b) + _d2(a, b)))
        return ratio(far - _msq(a), F.greatest(far, _msq(a)))

    return _over_clusters(one)


def _separations() -> Column:
    """Of each cluster: its relative size less exp(-d^2 / beta) to the nearest centroid, beta the mean square of centroids about their mean."""
    mid = F.transform(F.sequence(F.lit(0), F.size(C("cs")[0]["mu"]) - 1), lambda i: F.aggregate("cs", F.lit(0.0), lambda s, c: s + c["mu"][i]) / C("k"))
    beta = F.aggregate("cs", F.lit(0.0), lambda s, c: s + sq_dist_of_few(c["mu"], C("mid_"))) / C("k")
    top = F.array_max(_over_clusters(lambda c: c["n"]))
    return mid, beta, lambda b: _over_clusters(lambda a: F.when(C("k") > 1, a["n"] / top - F.exp(-ratio(F.array_min(_over_others(a, lambda o: _d2(a, o))), b))))


#: Indices as expressions over ``base``.
FROM_BASE: dict[str, Callable[[], Column]] = {
    "ch": lambda: ratio(ratio(C("ssb"), C("k") - 1), ratio(C("ssw"), C("n") - C("k"))),
    "sse": lambda: C("ssw"),
    "bh": lambda: ratio(C("ssw"), C("k")),
    "wb": lambda: ratio(C("k") * C("ssw"), C("ssb")),
    "rs": lambda: 1 - ratio(C("sum_msq"), (C("ssw") + C("ssb")) / C("n")),
    "xb": lambda: ratio(C("ssw"), C("n") * _min_d2()),
    "xb_star": lambda: ratio(C("max_msq"), _min_d2()),
    "gd43": lambda: ratio(F.sqrt(_min_d2()), 2 * C("max_msq")),
    # least joint spread of two clusters over twice the largest mean square
    "gd53": lambda: ratio(F.array_min(_over_pairs(lambda a, b: (a["ssw"] + b["ssw"]) / (a["n"] + b["n"]))), 2 * C("max_msq")),
    "csil": lambda: ratio(_sum(_silhouettes()), F.size(F.filter(_silhouettes(), lambda v: v.isNotNull())).cast("double")),
    # sum of the mean squares over those about the nearest other centroid
    "h": lambda: _sum(_over_clusters(lambda a: ratio(_msq(a), _msq(a) + F.array_min(_over_others(a, lambda b: _d2(a, b)))))),
}


def _from_base(name: str) -> Callable[[DataFrame, int], DataFrame]:
    def run(p: DataFrame, dim: int) -> DataFrame:
        return base(p, dim).select(*KEYS, FROM_BASE[name]().alias("value"))

    return run


def many_from_base(p: DataFrame, dim: int, names: list[str]) -> DataFrame:
    """(keys, metric, value) of several indices of ``FROM_BASE`` after one scan."""
    values = F.array(*(F.struct(F.lit(n).alias("metric"), FROM_BASE[n]().cast("double").alias("value")) for n in names))
    return base(p, dim).select(*KEYS, F.explode(values).alias("v")).select(*KEYS, "v.*")


def partition_separation(p: DataFrame, dim: int) -> DataFrame:
    """Sum over clusters of the relative size less exp(-d^2 / beta) to the nearest centroid."""
    mid, beta, values = _separations()
    row = base(p, dim).withColumn("mid_", mid).withColumn("beta_", beta)
    return row.select(*KEYS, _sum(values(C("beta_"))).alias("value"))


def i_index(p: DataFrame, dim: int) -> DataFrame:
    """((distances to the centre over those to the centroids) / K x the largest centroid distance) squared."""
    s = Scratch(p.sparkSession).keep(cluster_stats(p, dim))
    whole = s.groupBy(*KEYS).agg(F.sum("sd").alias("sd"), F.sum("sd_all").alias("sd_all"), F.max("k").alias("k"))
    widest = centroid_pairs(s, dim).groupBy(*KEYS).agg(F.max("dc").alias("max_dc"))
    return whole.join(widest, KEYS, "left").select(*KEYS, F.pow(ratio(C("sd_all"), C("sd")) / C("k") * C("max_dc"), F.lit(2.0)).alias("value"))


def davies_bouldin(p: DataFrame, dim: int) -> DataFrame:
    """Mean over clusters of the worst ratio of scatters to centroid distance."""
    pairs = centroid_pairs(cluster_stats(p, dim).withColumn("s", C("sd") / C("n")), dim, ("s", "k")).withColumn("r", ratio(C("s_i") + C("s_j"), C("dc")))
    ends = F.explode(F.array(C("li"), C("lj"))).alias("label")
    worst = pairs.select(*KEYS, ends, "r", "k_i").groupBy(*KEYS, "label").agg(F.max("r").alias("r"), F.max("k_i").alias("k"))
    return worst.groupBy(*KEYS).agg((F.sum("r") / F.max("k")).alias("value"))


def _own_and_nearest(p: DataFrame, dim: int) -> DataFrame:
    """Each point with its distance to its own centroid (a) and to the nearest other one (b, null if none)."""
    c = centroids(p, dim)
    q = with_centroid_list(p, c)
    ds = F.transform("cs", lambda c: F.struct(c["label"].alias("label"), dist(C("x"), c["mu"], dim).alias("d")))
    q = q.select(*KEYS, "row_id", "label", ds.alias("ds"))
    own = F.filter("ds", lambda e: e["label"] == C("label"))[0]["d"]
    other = F.array_min(F.transform(F.filter("ds", lambda e: e["label"] != C("label")), lambda e: e["d"]))
    return q.select(*KEYS, "row_id", "label", own.alias("a"), other.alias("b"))


def np_silhouette(p: DataFrame, dim: int) -> DataFrame:
    """Centroid silhouette with a cluster's mean distance as cohesion; 0 for one cluster."""
    s = cluster_stats(p, dim).select(*KEYS, "label", "mu", "n", (C("sd") / C("n")).alias("cohesion"))
    q = with_centroid_list(p.select(*KEYS, "row_id", "label", "x"), s, ("cohesion",))
    other = F.filter("cs", lambda c: c["label"] != C("label"))
    near = q.select(*KEYS, F.filter("cs", lambda c: c["label"] == C("label"))[0]["cohesion"].alias("a"), F.array_min(F.transform(other, lambda c: dist(C("x"), c["mu"], dim))).alias("b"))
    one = ratio(C("b") - C("a"), F.greatest("b", "a"))
    return near.groupBy(*KEYS).agg(F.when(F.count("b") == 0, F.lit(0.0)).otherwise(F.avg(one)).alias("value"))


def score_function(p: DataFrame, dim: int) -> DataFrame:
    """1 - exp(-exp(between - within)), between the weighted mean square of centroids by clusters, within the sum of mean distances."""
    s = cluster_stats(p, dim)
    between = F.sum(C("n") * sq_dist_of_few(C("mu"), C("mu_all"))) / (F.max("big_n") * F.max("k"))
    return s.groupBy(*KEYS).agg((1 - F.exp(-F.exp(between - F.sum(C("sd") / C("n"))))).alias("value"))


def _scatter(p: DataFrame, dim: int) -> DataFrame:
    """(keys, cs, k, scat, stdev): clusters as (label, mu), mean norm of their variances over that of all points, and the mean deviation."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    listed = centroids(p, dim).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("label", "mu"))).alias("cs"), F.count(F.lit(1)).alias("k"), F.sum(norm(C("var"))).alias("norms"), F.sum("n").alias("n"),
        *(F.sum(C("mu")[i] * C("n")).alias(f"s{i}") for i in range(dim)), *(F.sum((C("var")[i] + C("mu")[i] * C("mu")[i]) * C("n")).alias(f"q{i}") for i in range(dim)),
    )
    whole = F.array(*(C(f"q{i}") / C("n") - (C(f"s{i}") / C("n")) * (C(f"s{i}") / C("n")) for i in range(dim)))
    return listed.select(*KEYS, "cs", "k", (ratio(C("norms"), norm(whole)) / C("k")).alias("scat"), (F.sqrt("norms") / C("k")).alias("stdev"))


def sd_validity(p: DataFrame, dim: int) -> DataFrame:
    """Scatter of the clusters plus their separation (Dmax / Dmin) x the sum of 1 / (summed distances to the other centroids)."""
    one = lambda a: ratio(1.0, _sum(_over_others(a, lambda b: F.sqrt(_d2(a, b)))))
    d = _over_pairs(lambda a, b: F.sqrt(_d2(a, b)))
    apart = ratio(F.array_max(d), F.array_min(d)) * _sum(_over_clusters(one))
    return _scatter(p, dim).select(*KEYS, (C("scat") + apart).alias("value"))


def s_dbw(p: DataFrame, dim: int) -> DataFrame:
    """Scatter of the clusters plus the density between them: points of two clusters within the mean deviation of the middle of
    their centroids, over the larger number about a centroid. Each point is compared with the middles of its own cluster's pairs."""
    lists = Scratch(p.sparkSession).keep(_scatter(p, dim))
    q = attach(p.select(*KEYS, "row_id", "label", "x"), lists.select(*KEYS, "cs", "stdev"), KEYS, F.size("cs") * (dim + 2))
    own = F.filter("cs", lambda c: c["label"] == C("label"))[0]
    middle = lambda c: F.zip_with(c["mu"], C("own.mu"), lambda a, b: (a + b) / 2)
    near = F.filter("cs", lambda c: sq_dist_of_few(C("x"), middle(c)) <= C("stdev") * C("stdev"))
    # a cluster's middle with itself is its centroid; a pair's middle is met from both sides
    hits = q.withColumn("own", own).select(*KEYS, "label", F.explode(F.transform(near, lambda c: c["label"])).alias("other"))
    counts = hits.groupBy(*KEYS, F.least("label", "other").alias("li"), F.greatest("label", "other").alias("lj")).agg(F.count(F.lit(1)).alias("c"))
    about = _label_pairs(lists).join(counts, [*KEYS, "li", "lj"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    centre = about.where("li = lj").select(*KEYS, C("li").alias("l"), C("c").alias("at"))
    between = about.where("li < lj").join(centre.select(*KEYS, C("l").alias("li"), C("at").alias("ci")), [*KEYS, "li"]).join(centre.select(*KEYS, C("l").alias("lj"), C("at").alias("cj")), [*KEYS, "lj"])
    dense = between.groupBy(*KEYS).agg(F.sum(F.when(F.greatest("ci", "cj") > 0, C("c") / F.greatest("ci", "cj"))).alias("d"), F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.greatest("ci", "cj") > 0, 1)).alias("known"))
    value = F.when(C("known") == C("pairs"), C("scat") + C("d") / C("pairs"))
    return lists.join(dense, KEYS, "left").select(*KEYS, value.alias("value"))


def _label_pairs(lists: DataFrame) -> DataFrame:
    """(keys, li, lj) for li <= lj of each key."""
    first = lists.select(*KEYS, "cs", F.explode("cs.label").alias("li"))
    return first.select(*KEYS, "li", F.explode(F.filter(C("cs.label"), lambda x: x >= C("li"))).alias("lj"))


def cross_information_potential(p: DataFrame, dim: int) -> DataFrame:
    """Sum over pairs of clusters of a Gaussian of the centroid difference under the summed sample covariances."""
    ship(p.sparkSession)
    c = covariances(p, dim)
    a = c.select(*KEYS, C("label").alias("li"), C("mu").alias("mu_i"), C("cov").alias("cov_i"))
    b = c.select(*KEYS, C("label").alias("lj"), C("mu").alias("mu_j"), C("cov").alias("cov_j"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for mi, ci, mj, cj in pdf[["mu_i", "cov_i", "mu_j", "cov_j"]].itertuples(index=False):
                s, d = (np.array(ci, dtype=float) + np.array(cj, dtype=float)).reshape(dim, dim), np.array(mi) - np.array(mj)
                sign, log_det = np.linalg.slogdet(s)
                out.append(float(np.exp(-0.5 * (d @ np.linalg.solve(s, d) + log_det + dim * np.log(2 * np.pi)))) if sign > 0 else None)
            yield pdf[KEYS].assign(v=out)

    pairs = a.join(b, KEYS).where("li < lj")  # clusters, not points
    return pairs.mapInPandas(run, "dataset string, labelset string, v double").groupBy(*KEYS).agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum("v")).alias("value"))


def imbalance_ratio(p: DataFrame, dim: int = 0) -> DataFrame:
    """Largest over smallest cluster."""
    sizes = p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*KEYS).agg((F.max("n") / F.min("n")).alias("value"))


def overlap_ratio(p: DataFrame, dim: int, slack: float = 1.2) -> DataFrame:
    """Share of points whose nearest other centroid is within slack times the distance to their own; 0 for one cluster."""
    q = _own_and_nearest(p, dim)
    return q.groupBy(*KEYS).agg(F.avg(F.coalesce((C("b") <= slack * C("a")).cast("double"), F.lit(0.0))).alias("value"))


#: name -> (plan, whether higher is better)
LINEAR: dict[str, tuple[Callable[[DataFrame, int], DataFrame], bool]] = {
    **{name: (_from_base(name), name in ("ch", "rs", "gd43", "gd53", "csil")) for name in FROM_BASE},
    "db": (davies_bouldin, False), "np_silhouette": (np_silhouette, True), "i_index": (i_index, True), "ps": (partition_separation, True), "sf": (score_function, True),
    "rcip": (cross_information_potential, False), "sd": (sd_validity, False), "s_dbw": (s_dbw, False),
}
