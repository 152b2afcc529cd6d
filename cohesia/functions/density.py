"""DBCV and CDbw: density-based indices.

The steps inside one cluster (spanning tree, hull) are sequential and limited to
``mst.GROUP_ROWS`` points a cluster; everything over pairs of points is the blocked pair pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators import pairs as pp
from cohesia.operators.frames import KEYS, drop_noise, singletons_to_noise
from cohesia.operators.hull import hull_2d
from cohesia.operators.mst import guarded
from cohesia.session import Scratch, ship

C = F.col
FLOOR, CEILING = 1e-12, 1e12


def near_duplicates(p: DataFrame, within: float = 1e-9) -> DataFrame:
    """(keys, row_id) of points that have another one closer than the bound."""
    return pp.pair_stats(p).groupBy(*KEYS, "row_id").agg(F.min("min_d").alias("d")).where(C("d") < within).select(*KEYS, "row_id")


def _cores(p: DataFrame, dim: int) -> DataFrame:
    """(keys, row_id, label, core): core distance by log-sum-exp of -d ln D, D the squared distance."""

    def work(a, others):
        ids, labels, xs, _ = a
        top, s = np.full(len(ids), -np.inf), np.zeros(len(ids))
        for (jds, jlabels, ys, _), _ in others:
            d = np.maximum(pp.distances(xs, ys, "sqeuclidean"), FLOOR)
            t = np.where((labels[:, None] == jlabels[None, :]) & (ids[:, None] != jds[None, :]), -dim * np.log(d), -np.inf)
            new = np.maximum(top, t.max(axis=1))
            some = np.isfinite(new)
            s[some] = s[some] * np.exp(top[some] - new[some]) + np.exp(t[some] - new[some, None]).sum(axis=1)
            top = new
        has = np.isfinite(top)
        return [ids[has], labels[has].astype(np.int32), top[has], s[has]]

    made = pp.blocks(p)
    parts = pp.block_pairs(made, made, work, "dataset string, labelset string, row_id long, label int, m double, s double")
    top = parts.groupBy(*KEYS, "row_id", "label").agg(F.max("m").alias("top"))
    total = parts.join(top, [*KEYS, "row_id", "label"]).groupBy(*KEYS, "row_id", "label").agg((F.max("top") + F.log(F.sum(C("s") * F.exp(C("m") - C("top"))))).alias("log_sum"))
    sizes = p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("nk"))
    log_mean = F.least(C("log_sum") - F.log(C("nk") - 1), F.lit(float(np.log(CEILING))))
    return total.join(sizes, [*KEYS, "label"]).select(*KEYS, "row_id", "label", F.exp(-log_mean / dim).alias("core"))


def _cluster_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one cluster: which points are internal to the tree of mutual reachability, and its largest internal edge."""
    pdf = guarded(pdf, "a DBCV cluster")
    x, core, ids = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), pdf["core"].to_numpy(), pdf["row_id"].to_numpy()
    n = len(x)
    best, link, done, at, edges = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.maximum(((x - x[at]) ** 2).sum(axis=1), FLOOR), core), core[at])
        tie = (d == best) & ((np.minimum(ids, ids[at]) < np.minimum(ids, ids[link])) | ((np.minimum(ids, ids[at]) == np.minimum(ids, ids[link])) & (np.maximum(ids, ids[at]) < np.maximum(ids, ids[link]))))
        closer = ((d < best) | tie) & ~done
        best[closer], link[closer] = d[closer], at
        left = np.flatnonzero(~done)
        low = left[best[left] == best[left].min()]
        at = int(min(low, key=lambda k: (min(ids[k], ids[link[k]]), max(ids[k], ids[link[k]]))))
        edges.append((at, int(link[at]), best[at]))
    degree = np.bincount([v for e in edges for v in e[:2]], minlength=n) if edges else np.zeros(n, int)
    internal = degree > 1
    weights = np.array([w for _, _, w in edges])
    if internal.sum() == 0:
        internal[:] = True
    elif internal.sum() > 1:
        weights = np.array([w for u, v, w in edges if internal[u] and internal[v]])
    sparse = float(weights.max()) if len(weights) else 0.0
    return pd.DataFrame({"dataset": pdf["dataset"], "labelset": pdf["labelset"], "row_id": ids, "label": pdf["label"], "x": pdf["x"], "core": core, "internal": internal, "dsc": sparse})


def dbcv(p: DataFrame, dim: int, noise: int = -1, check_duplicates: bool = True) -> DataFrame:
    """Density-based clustering validation; raises on near-duplicate points as published, unless told not to."""
    ship(p.sparkSession)
    scratch = Scratch(p.sparkSession)
    size = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    q = scratch.keep(drop_noise(singletons_to_noise(p, noise), noise))
    if check_duplicates and near_duplicates(q).limit(1).count():
        raise ValueError("Duplicated samples have been found in X.")
    tree = scratch.keep(q.join(_cores(q, dim).drop("label"), [*KEYS, "row_id"]).groupBy(*KEYS, "label").applyInPandas(_cluster_tree, "dataset string, labelset string, row_id long, label int, x array<double>, core double, internal boolean, dsc double"))
    inner = tree.where("internal")

    def work(a, others):
        _, labels, xs, cores = a
        least: dict[tuple[int, int], float] = {}
        for (_, jlabels, ys, jcores), _ in others:
            d = np.maximum(np.maximum(np.maximum(pp.distances(xs, ys, "sqeuclidean"), FLOOR), cores[:, None]), jcores[None, :])
            for i in np.unique(labels):
                for j in np.unique(jlabels):
                    if i != j:
                        at = (int(i), int(j))
                        least[at] = min(least.get(at, np.inf), float(d[np.ix_(labels == i, jlabels == j)].min()))
        return [np.array([i for i, _ in least], dtype=np.int32), np.array([j for _, j in least], dtype=np.int32), np.array(list(least.values()), dtype=float)]

    made = pp.blocks(inner.select(*KEYS, "row_id", "x", "label", "core"), extra="core")
    sep = pp.block_pairs(made, made, work, "dataset string, labelset string, label int, other int, d double").groupBy(*KEYS, "label").agg(F.min("d").alias("dspc"))
    by = tree.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("nk"), F.max("dsc").alias("dsc")).join(sep, [*KEYS, "label"], "left").withColumn("dspc", F.coalesce("dspc", F.lit(CEILING)))
    v = (C("dspc") - C("dsc")) / (FLOOR + F.greatest("dspc", "dsc"))
    total = by.groupBy(*KEYS).agg(F.sum(v * C("nk")).alias("s"))
    return size.join(total, KEYS, "left").select(*KEYS, F.coalesce(C("s") / C("n"), F.lit(0.0)).alias("value"))


def cdbw(p: DataFrame, dim: int, shells: int = 3, metric: str = "euclidean") -> DataFrame:
    """Compactness and separation by density around representatives (hull vertices), as published in code.

    Two dimensions; in others clusters of four points or more have no hull here and the value is null. One key is
    worked out in one task: representatives are few, but all points of the key are held (GROUP_ROWS at most).
    """
    ship(p.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = guarded(pdf, "CDbw")
        x, labels = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), pdf["label"].to_numpy()
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "labelset": [pdf["labelset"].iloc[0]], "value": [cdbw_value(x, labels, shells, metric)]})

    return p.groupBy(*KEYS).applyInPandas(run, "dataset string, labelset string, value double")


def cdbw_value(x: np.ndarray, labels: np.ndarray, shells: int = 3, metric: str = "euclidean") -> float | None:
    names = np.unique(labels)
    k = len(names)
    parts = [x[labels == n] for n in names]
    if k < 2 or x.shape[1] != 2 and any(len(c) >= 4 for c in parts):
        return None
    stdev = float(np.sqrt((parts[-1].std(axis=0) ** 2).sum() / x.shape[1]))  # of the last cluster only
    reps = [c[hull_2d(c)] if len(c) >= 4 else c for c in parts]
    if any(len(r) < 2 for r in reps) or stdev == 0:
        return 0.0
    dens = np.zeros(shells)
    for s in range(shells):
        for c, r in zip(parts, reps, strict=True):
            shell = (1 - s / shells) * r + s / shells * c.mean(axis=0)
            near = sum(int((pp.distances(c[at : at + 4096], shell, metric) < stdev).sum()) for at in range(0, len(c), 4096))
            dens[s] += near / (len(r) * len(c) * stdev) / k
    compact = dens.sum() / shells
    cohesion = compact / (1 + np.abs(np.diff(dens)).sum() / (shells - 1))
    least, densest = np.full(k, np.inf), 0.0
    for i in range(k):
        for j in range(i):
            d = pp.distances(reps[i], reps[j], metric)
            forth, back = d.min(axis=1), d.min(axis=0)
            # pairs that are nearest to each other, ties included
            u, v = np.nonzero((d == forth[:, None]) & (d == back[None, :]))
            far = np.array([float(pp.distances(reps[i][a : a + 1], reps[j][b : b + 1], metric)[0, 0]) for a, b in zip(u, v, strict=True)])
            middle = (reps[i][u] + reps[j][v]) / 2
            both = np.vstack((parts[i], parts[j]))
            card = sum((pp.distances(middle, both[at : at + 4096]) < stdev).sum(axis=1) for at in range(0, len(both), 4096))
            densest = max(densest, float((card * far).sum() / (stdev * len(both))))
            least[i] = min(least[i], float(far.mean()))
    sep = least[1:].sum() / k / (1 + densest / k)
    value = compact * cohesion * sep
    return float(value) if np.isfinite(value) else 0.0
