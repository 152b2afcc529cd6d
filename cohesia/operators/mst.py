"""Minimum spanning trees of point sets and largest-edge (bottleneck) distances on them.

``mst_edges`` is exact. Up to ``PRIM_ROWS`` points of a key it runs Prim's algorithm in
one task; beyond, Boruvka rounds over the blocked pair pass, whose tasks hold two
blocks at a time. Ties are broken by (weight, smaller id, larger id), so both give one tree.
``knn_prim`` keeps the order-dependent variant that only offers the nearest unvisited
neighbours; it is sequential and limited to ``GROUP_ROWS`` points.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.components import connected_components
from cohesia.operators.frames import KEYS
from cohesia.operators.pairs import block_pairs, blocks, distances
from cohesia.session import Scratch, ship

#: Points of a key that one task takes: memory is a few numbers a point, time their square (60,000 plane points: some 10 s).
PRIM_ROWS = 100_000
#: Largest group that a sequential algorithm accepts; a larger one is refused rather than cut.
GROUP_ROWS = 200_000
EDGES = "dataset string, labelset string, u long, v long, w double"
C = F.col


def guarded(pdf: pd.DataFrame, what: str, limit: int = GROUP_ROWS) -> pd.DataFrame:
    if len(pdf) > limit:
        raise ValueError(f"{what} is sequential: {len(pdf)} points are over the limit of {limit}")
    return pdf.sort_values("row_id")


def prim(x: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, float]]:
    """Exact tree on dense distances, one row of them at a time; points that have joined are left out of the rows after.

    Of equal weights the edge with the smaller pair of ids is taken, whichever was met first.
    """
    n = len(x)
    cols = [np.array(c, dtype=float) for c in x.T]
    own = ids.astype(np.int64)
    best, link = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    at, edges = 0, []
    for _ in range(n - 1):
        here, now = own[at], [c[at] for c in cols]
        last = len(own) - 1  # the point that joined gives its place to the last one
        for a in (*cols, own, best, link):
            a[at] = a[last]
        cols, own, best, link = [c[:last] for c in cols], own[:last], best[:last], link[:last]
        d = np.zeros(last)
        for c, v in zip(cols, now, strict=True):
            t = c - v
            t *= t
            d += t
        np.sqrt(d, out=d)
        closer = np.flatnonzero(d <= best)
        tied = d[closer] == best[closer]
        if tied.any():
            keep, t = np.ones(len(closer), dtype=bool), np.flatnonzero(tied)
            at_t = closer[t]
            keep[t] = _before(own[at_t], np.full(len(t), here), own[at_t], link[at_t])
            closer = closer[keep]
        best[closer], link[closer] = d[closer], here
        at = int(best.argmin())
        low = np.flatnonzero(best == best[at])
        if len(low) > 1:
            at = int(low[np.lexsort((np.maximum(own[low], link[low]), np.minimum(own[low], link[low])))[0]])
        u, v = int(own[at]), int(link[at])
        edges.append((min(u, v), max(u, v), float(best[at])))
    return edges


def prim_of_copies(x: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, float]]:
    """The tree of ``prim`` where many points are copies: Prim's algorithm on the first of each, to which its copies are tied.

    That is the same tree, since edges between copies come first and those of the smallest id before the others.
    Distinct points so close that their distance is 0 would mix with them; then all points go through ``prim``.
    """
    _, of = np.unique(x + 0.0, axis=0, return_inverse=True)
    of = of.ravel()
    by = np.lexsort((ids, of))
    heads = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
    if len(heads) == len(x):
        return prim(x, ids)
    first = np.repeat(by[heads], np.diff(np.r_[heads, len(by)]))
    edges = prim(x[by[heads]], ids[by[heads]])
    if any(w == 0 for _, _, w in edges):
        return prim(x, ids)
    later = by != first
    return edges + [(u, v, 0.0) for u, v in zip(ids[first[later]].tolist(), ids[by[later]].tolist(), strict=True)]


def _before(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the unordered pair (a, b) comes before (c, d), by smaller id and then by larger."""
    low, other = np.minimum(a, b), np.minimum(c, d)
    return (low < other) | ((low == other) & (np.maximum(a, b) < np.maximum(c, d)))


def knn_limited_prim(x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """A spanning tree by places: a joining point offers only its k nearest points not yet in the tree."""
    n = len(x)
    seen = np.zeros(n, dtype=bool)
    queue: list[tuple[float, int, int]] = []

    def join(at: int) -> None:
        seen[at] = True
        rest = np.flatnonzero(~seen)
        if len(rest):
            d = ((x[rest] - x[at]) ** 2).sum(axis=1)
            near = np.argpartition(d, k - 1)[:k] if len(rest) > k else np.arange(len(rest))
            for j in near:
                heapq.heappush(queue, (float(d[j]), at, int(rest[j])))

    edges = []
    join(0)
    while len(edges) < n - 1 and queue:
        d, u, v = heapq.heappop(queue)
        if not seen[v]:
            edges.append((u, v, float(np.sqrt(d))))
            join(v)
    return edges


def _prim_group(mode: str, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = guarded(pdf, f"{mode} spanning tree")
        x, ids = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1), pdf["row_id"].to_numpy()
        edges = prim_of_copies(x, ids) if mode == "prim" else [(int(min(ids[u], ids[v])), int(max(ids[u], ids[v])), w) for u, v, w in knn_limited_prim(x, k)]
        out = pd.DataFrame(edges, columns=["u", "v", "w"]) if edges else pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "w": pd.Series(dtype=float)})
        out.insert(0, "labelset", pdf["labelset"].iloc[0])
        out.insert(0, "dataset", pdf["dataset"].iloc[0])
        return out

    return run


def boruvka(p: DataFrame) -> DataFrame:
    """Exact tree in rounds: every component takes its least edge out, found by the blocked pair pass."""
    scratch = Scratch(p.sparkSession)
    nodes = scratch.keep(p.select(*KEYS, "row_id", "x", F.col("row_id").alias("label")))  # the label is the component
    tree = None
    while True:

        def work(a, others):
            # the least edge out of each component that has points in the block; of equal ones that of the smaller ids
            ids, own, xs, _ = a
            near, who = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
            for (jds, theirs, ys, _), _ in others:
                by = np.argsort(jds)  # of a point's equal edges that to the smallest id comes first
                d = distances(xs, ys[by])
                d[own[:, None] == theirs[None, by]] = np.inf
                at = d.argmin(axis=1)
                least, j = d[np.arange(len(ids)), at], jds[by][at]
                closer = (least < near) | np.isfinite(least) & (least == near) & (j < who)
                near[closer], who[closer] = least[closer], j[closer]
            i = np.flatnonzero(np.isfinite(near))
            low, high = np.minimum(ids[i], who[i]), np.maximum(ids[i], who[i])
            by = np.lexsort((high, low, near[i], own[i]))
            first = by[np.r_[True, np.diff(own[i][by]) != 0][: len(by)]]
            return [own[i][first], near[i][first], low[first], high[first]]

        made = blocks(nodes)
        parts = block_pairs(made, made, work, "dataset string, labelset string, comp long, w double, u long, v long")
        least = parts.groupBy(*KEYS, "comp").agg(F.min(F.struct("w", "u", "v")).alias("e")).select(*KEYS, "comp", "e.*")
        found = scratch.keep(least.select(*KEYS, "u", "v", "w").distinct())
        if not found.limit(1).count():
            break
        tree = found if tree is None else scratch.keep(tree.unionByName(found).distinct())
        comp = scratch.keep(connected_components(tree.select(*KEYS, C("u").alias("a"), C("v").alias("b")), scratch))
        nodes = scratch.keep(nodes.drop("label").join(comp, [(nodes[k] == comp[k]) for k in KEYS] + [nodes.row_id == comp.node], "left").select(*(nodes[k] for k in KEYS), nodes.row_id, nodes.x, F.coalesce(comp.component, nodes.row_id).alias("label")))
    return tree if tree is not None else p.sparkSession.createDataFrame([], EDGES)


def mst_edges(p: DataFrame, mode: str = "exact", k: int = 5) -> DataFrame:
    """(keys, u, v, w): the edges of a spanning tree of each key; u < v are row ids."""
    ship(p.sparkSession)
    if mode == "exact":
        largest = p.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
        if largest > PRIM_ROWS:
            return boruvka(p)
        mode = "prim"
    return p.select(*KEYS, "row_id", "x").groupBy(*KEYS).applyInPandas(_prim_group(mode, k), EDGES)


def bottleneck_from(n: int, edges: list[tuple[int, int, float]], source: int) -> np.ndarray:
    """Largest edge on the tree path from one place to every other; inf where there is none."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    out = np.full(n, np.inf)
    out[source] = 0.0
    stack = [source]
    while stack:
        u = stack.pop()
        for v, w in near[u]:
            if out[v] == np.inf and v != source:
                out[v] = max(out[u], w)
                stack.append(v)
    return out


def bottleneck_to(p: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(keys, row_id, target, d): largest path edge from every point to each target row of its key.

    The tree of a key (one row a point) is walked in one task, once for each target.
    """
    ship(p.sparkSession)
    rows = edges.select(*KEYS, "u", "v", "w").unionByName(targets.select(*KEYS, C("target").alias("u"), F.lit(-1).cast("long").alias("v"), F.lit(0.0).alias("w"))).unionByName(p.select(*KEYS, C("row_id").alias("u"), F.lit(-2).cast("long").alias("v"), F.lit(0.0).alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, w = pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy()
        ids = np.unique(u[v == -2])
        if len(ids) > GROUP_ROWS:
            raise ValueError(f"paths of {len(ids)} points are over the limit of {GROUP_ROWS}")
        tree = v >= 0
        pairs = list(zip(np.searchsorted(ids, u[tree]).tolist(), np.searchsorted(ids, v[tree]).tolist(), w[tree].tolist(), strict=True))
        parts = [pd.DataFrame({"row_id": ids, "target": t, "d": bottleneck_from(len(ids), pairs, int(np.searchsorted(ids, t)))}) for t in np.unique(u[v == -1])]
        out = pd.concat(parts) if parts else pd.DataFrame({"row_id": pd.Series(dtype="int64"), "target": pd.Series(dtype="int64"), "d": pd.Series(dtype=float)})
        out.insert(0, "labelset", pdf["labelset"].iloc[0])
        out.insert(0, "dataset", pdf["dataset"].iloc[0])
        return out

    return rows.groupBy(*KEYS).applyInPandas(run, "dataset string, labelset string, row_id long, target long, d double")


def mst_of_graph(edges: DataFrame) -> DataFrame:
    """The least spanning forest of a weighted graph (dataset, a, b, w), by Kruskal's order (w, a, b).

    For small graphs (grid cells): a data set's edges are worked out in one task, GROUP_ROWS x 50 at most.
    """
    ship(edges.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 50 * GROUP_ROWS:
            raise ValueError(f"a graph of {len(pdf)} edges is over the limit")
        pdf = pdf.sort_values(["w", "a", "b"])
        up: dict[str, str] = {}

        def root(v: str) -> str:
            while up.setdefault(v, v) != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        keep = []
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            ra, rb = root(a), root(b)
            keep.append(ra != rb)
            up[ra] = rb
        return pdf[keep]

    return edges.groupBy("dataset").applyInPandas(run, edges.schema)
