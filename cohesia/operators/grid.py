"""Adaptive grid of median splits, its cell graph, and the score on the graph's spanning tree.

The grid does not depend on labels: it is built once per data set, level by level, as
grouped medians over all open cells at once (at most 2^max_depth cells), and label
sets are joined afterwards. A cell is known by its path: a string of L and R.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesia.functions.internal import ratio
from cohesia.functions.vectors import dist, sq_dist
from cohesia.operators.frames import KEYS
from cohesia.operators.mst import mst_of_graph
from cohesia.session import Scratch

C = F.col
NARROW = 1e-6


def _product(terms: list[Column]) -> Column:
    out = F.lit(1.0)
    for t in terms:
        out = out * t
    return out


def grid_points(p: DataFrame, dim: int, min_points: int = 5, max_depth: int = 10, density_threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with their cell, cells with bounds), for the distinct (dataset, row_id) points of p.

    cells: (dataset, cell, depth, n, lo, hi, volume, density); lo and hi are the cell's bounds, volume that of its points.
    """
    scratch = Scratch(p.sparkSession)
    pts = p.select("dataset", "row_id", "x").dropDuplicates(["dataset", "row_id"])
    lo = F.array(*(F.min(C("x")[i]) for i in range(dim)))
    hi = F.array(*(F.max(C("x")[i]) for i in range(dim)))
    root = pts.groupBy("dataset").agg(F.count(F.lit(1)).alias("all"), lo.alias("lo"), hi.alias("hi"))
    threshold = F.lit(density_threshold) if density_threshold is not None else ratio(0.5 / C("all"), _product([C("hi")[i] - C("lo")[i] for i in range(dim)]))
    bounds = scratch.keep(root.select("dataset", F.lit("").alias("cell"), "lo", "hi", "all", threshold.alias("thr")))
    current = scratch.keep(pts.withColumn("cell", F.lit("")))
    leaves, settled = None, None
    for depth in range(max_depth + 1):
        axis = depth % dim
        ranges = [F.greatest(F.max(C("x")[i]) - F.min(C("x")[i]), F.lit(NARROW)) for i in range(dim)]
        at = C("x")[axis]
        stats = current.groupBy("dataset", "cell").agg(F.count(F.lit(1)).alias("n"), _product(ranges).alias("volume"), F.median(at).alias("cut"), F.max(at).alias("top"))
        cells = bounds.join(stats, ["dataset", "cell"]).withColumn("density", C("n") / C("all") / C("volume"))
        stop = F.lit(depth >= max_depth) | (C("n") <= min_points) | F.coalesce(C("density") < C("thr"), F.lit(False)) | (C("n") < 2) | (C("top") <= C("cut"))
        cells = scratch.keep(cells.withColumn("leaf", stop))
        done = cells.where("leaf").select("dataset", "cell", F.lit(depth).alias("depth"), "n", "lo", "hi", "volume", "density")
        leaves = done if leaves is None else leaves.unionByName(done)
        placed = current.join(cells.select("dataset", "cell", "leaf", "cut"), ["dataset", "cell"])
        own = placed.where("leaf").select("dataset", "row_id", "x", "cell")
        settled = own if settled is None else settled.unionByName(own)
        opened = cells.where("not leaf")
        if not opened.limit(1).count():
            break
        current = scratch.keep(placed.where("not leaf").select("dataset", "row_id", "x", F.concat("cell", F.when(at <= C("cut"), "L").otherwise("R")).alias("cell")))
        put = lambda name, side: F.array(*(C("cut") if i == axis and name == side else C(name)[i] for i in range(dim)))
        halves = F.array(F.struct(F.concat("cell", F.lit("L")).alias("cell"), C("lo").alias("lo"), put("hi", "hi").alias("hi")), F.struct(F.concat("cell", F.lit("R")).alias("cell"), put("lo", "lo").alias("lo"), C("hi").alias("hi")))
        bounds = scratch.keep(opened.select("dataset", "all", "thr", F.explode(halves).alias("h")).select("dataset", "h.*", "all", "thr"))
    return scratch.keep(settled), scratch.keep(leaves)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def cell_medoids(settled: DataFrame, dim: int) -> DataFrame:
    """(dataset, cell, medoid): the member nearest to the cell's mean, the first on a tie."""
    mean = settled.groupBy("dataset", "cell").agg(F.array(*(F.avg(C("x")[i]) for i in range(dim))).alias("mu"))
    near = settled.join(mean, ["dataset", "cell"]).withColumn("d", F.round(sq_dist(C("x"), C("mu"), dim), 12))
    return near.groupBy("dataset", "cell").agg(F.min(F.struct("d", "row_id", "x")).alias("m")).select("dataset", "cell", C("m.x").alias("medoid"))


def cell_graph(settled: DataFrame, leaves: DataFrame, dim: int) -> DataFrame:
    """(dataset, a, b, w): touching cells a < b and the distance of their medoids. Cells are at most 2^max_depth."""
    named = leaves.select("dataset", "cell", "lo", "hi").join(cell_medoids(settled, dim), ["dataset", "cell"])
    a = named.select("dataset", *(C(c).alias(f"{c}_a") for c in ("cell", "lo", "hi", "medoid")))
    b = named.select("dataset", *(C(c).alias(f"{c}_b") for c in ("cell", "lo", "hi", "medoid")))
    touch, fits = F.lit(0), F.lit(0)
    for i in range(dim):
        t = _close(C("hi_a")[i], C("lo_b")[i]) | _close(C("hi_b")[i], C("lo_a")[i])
        o = (C("hi_a")[i] > C("lo_b")[i]) & (C("hi_b")[i] > C("lo_a")[i])
        touch, fits = touch + t.cast("int"), fits + (t | o).cast("int")
    near = a.join(b, "dataset").where(C("cell_a") < C("cell_b")).where((touch >= 1) & (fits == dim))
    return near.select("dataset", C("cell_a").alias("a"), C("cell_b").alias("b"), dist(C("medoid_a"), C("medoid_b"), dim).alias("w"))


def cell_labels(p: DataFrame, settled: DataFrame) -> DataFrame:
    """(keys, cell, n, labels, purity, impurity): the set of labels of a cell, share of its most frequent one, and entropy in bits."""
    counts = p.select(*KEYS, "row_id", "label").join(settled.select("dataset", "row_id", "cell"), ["dataset", "row_id"]).groupBy(*KEYS, "cell", "label").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy(*KEYS, "cell").agg(F.sum("c").alias("n"))
    share = C("c") / C("n")
    return counts.join(whole, [*KEYS, "cell"]).groupBy(*KEYS, "cell").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_set("label")).alias("labels"), F.max(share).alias("purity"), (-F.sum(share * F.log2(share))).alias("impurity"), F.min_by("label", F.struct(-C("c"), C("label"))).alias("majority"),
    )


def grid_score(p: DataFrame, dim: int, min_points: int = 8, max_depth: int = 8) -> DataFrame:
    """(keys, separation, purity, impurity, normalized, value): least edge between cells of different label sets over the largest
    between equal ones, times one minus the mean entropy. Null where the tree has no edge."""
    settled, leaves = grid_points(p, dim, min_points, max_depth)
    tree = mst_of_graph(cell_graph(settled, leaves, dim))
    by = cell_labels(p, settled)
    left = by.select(*KEYS, C("cell").alias("a"), C("labels").alias("la"))
    right = by.select(*KEYS, C("cell").alias("b"), C("labels").alias("lb"))
    edges = tree.join(left, ["dataset", "a"]).join(right, [*KEYS, "b"])
    same = C("la") == C("lb")
    sep = edges.groupBy(*KEYS).agg(F.min(F.when(~same, C("w"))).alias("inter"), F.max(F.when(same, C("w"))).alias("intra"))
    cells = by.groupBy(*KEYS).agg(F.avg("purity").alias("purity"), F.avg("impurity").alias("impurity"))
    k = p.groupBy(*KEYS).agg(F.count_distinct("label").alias("k"))
    joined = cells.join(k, KEYS).join(sep, KEYS, "left")
    normalized = C("impurity") / F.when(C("k") > 1, F.log2("k")).otherwise(1.0)
    separation = F.when(C("inter").isNull() & C("intra").isNull(), F.lit(None)).otherwise(F.coalesce(C("inter") / (C("intra") + 1e-10), F.lit(0.0)))
    return joined.select(*KEYS, separation.alias("separation"), "purity", "impurity", normalized.alias("normalized"), (separation * (1 - normalized)).alias("value"))


def grid_diagnostics(p: DataFrame, dim: int, min_points: int = 8, max_depth: int = 8) -> DataFrame:
    """One row a key: numbers of cells, ranges of density and volume, purity, and edge weights by majority label."""
    settled, leaves = grid_points(p, dim, min_points, max_depth)
    tree = mst_of_graph(cell_graph(settled, leaves, dim))
    by = cell_labels(p, settled)
    cells = leaves.groupBy("dataset").agg(F.count(F.lit(1)).alias("cells"), F.min("density").alias("density_min"), F.max("density").alias("density_max"), F.avg("density").alias("density_mean"), F.min("volume").alias("volume_min"), F.max("volume").alias("volume_max"))
    labels = by.groupBy(*KEYS).agg(F.avg("purity").alias("purity_mean"), F.median("purity").alias("purity_median"), F.sum((C("purity") == 1).cast("long")).alias("pure_cells"), F.sum((C("purity") < 0.5).cast("long")).alias("mixed_cells"), F.avg("impurity").alias("impurity_mean"))
    left = by.select(*KEYS, C("cell").alias("a"), C("majority").alias("ma"))
    right = by.select(*KEYS, C("cell").alias("b"), C("majority").alias("mb"))
    edges = tree.join(left, ["dataset", "a"]).join(right, [*KEYS, "b"])
    stat = lambda when, name: [f(F.when(when, C("w"))).alias(f"{name}_{n}") for n, f in (("edges", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    weights = edges.groupBy(*KEYS).agg(*stat(C("ma") == C("mb"), "intra"), *stat(C("ma") != C("mb"), "inter"))
    return labels.join(cells, "dataset").join(weights, KEYS, "left")


def sbcvi(p: DataFrame, dim: int, min_points: int = 8, max_depth: int = 8) -> DataFrame:
    return grid_score(p, dim, min_points, max_depth).select(*KEYS, "value")


