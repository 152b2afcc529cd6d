"""Sums over and nearest of all pairs of points in one or two dimensions, without going through all pairs.

The box of a data set is halved, always across its widest side, until a leaf holds ``CAP`` points or it has been halved ``DEPTH`` times.
Every point has a part in every result and nothing is left out:

* ``distance_sums``: near leaves are met point by point. Of a far part of the tree the distance is smooth, so it is taken through as many
  Chebyshev nodes as keep its error below ``EPS`` of the distance, which is about what the order of a sum of doubles changes.
* ``nearest_and_kernel``: nearest points are exact: bounds from the boxes of the leaves say which leaves can hold them. Sums of
  exp(-d^2 / 2 h^2) go through Chebyshev nodes in boxes no wider than 2 h, on which it is as smooth.

Leaves are dealt in groups; a task holds the points of its group and of the leaves near it. The driver holds a row for each leaf and label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.operators.frames import KEYS
from cohesia.session import Scratch, ship

C = F.col
#: From so many points on leaves are used; below, the pass over all pairs is short.
FROM = 50_000
#: Halvings, points of a leaf, groups of leaves, labels at most, and numbers of the grid of a kernel at most.
DEPTH, CAP, GROUPS, LABELS, GRID = 14, 1024, 96, 64, 4_000_000
EPS = 1e-13
#: Nodes a side of a kernel's boxes.
NODES = 22
POINT = "row_id long, label int, m long, x0 double, x1 double"
KEYED = "dataset string, labelset string"


def nodes(low: float, high: float, p: int) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos((2 * np.arange(p) + 1) * np.pi / (2 * p))


def shares(x: np.ndarray, low: float, high: float, p: int) -> np.ndarray:
    """What each of the p nodes of a box counts for at each x: the interpolating polynomials."""
    t = np.clip((2 * x - low - high) / (high - low), -1, 1) if high > low else np.zeros(len(x))
    of_nodes = chebvander(np.cos((2 * np.arange(p) + 1) * np.pi / (2 * p)), p - 1) * (2 / p)
    of_nodes[:, 0] /= 2
    return chebvander(t, p - 1) @ of_nodes.T


@dataclass
class Tree:
    """The leaves of one key: first cell, depth, points by label and tight box of each, and the group it is dealt to."""

    low: np.ndarray
    high: np.ndarray
    labels: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    depth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    tight: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    group: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    near: list[np.ndarray] = field(default_factory=list)
    far: list[list[tuple[int, int]]] = field(default_factory=list)
    weights: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    grid: np.ndarray | None = None

    def __post_init__(self) -> None:
        side, self.axes, self.sides = self.high - self.low, [], [self.high - self.low]
        for _ in range(DEPTH):
            axis = int(side.argmax())
            side = side.copy()
            side[axis] /= 2
            self.axes.append(axis)
            self.sides.append(side)

    def cells(self, x: np.ndarray) -> np.ndarray:
        parts = [2 ** self.axes.count(k) for k in (0, 1)]
        span = np.where(self.high > self.low, self.high - self.low, 1.0)
        at = [np.clip(((x[:, k] - self.low[k]) / span[k] * parts[k]).astype(np.int64), 0, parts[k] - 1) for k in (0, 1)]
        left, out = [self.axes.count(0), self.axes.count(1)], np.zeros(len(x), dtype=np.int64)
        for axis in self.axes:
            left[axis] -= 1
            out = 2 * out + (at[axis] >> left[axis] & 1)
        return out

    def boxes(self, depth: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros((len(prefix), 2))
        for i, axis in enumerate(self.axes[:depth]):
            at[:, axis] = 2 * at[:, axis] + (prefix >> (depth - 1 - i) & 1)
        return self.low + at * self.sides[depth], self.low + (at + 1) * self.sides[depth]

    def leaf(self, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, cell, side="right") - 1

    def orders(self, depth: int) -> tuple[int, int]:
        """Nodes a side of a box of this depth for what is at least its widest side away."""
        side = self.sides[depth]
        ratio = 2 * side.max() / np.maximum(side, 1e-300)
        return tuple(int(np.ceil(-np.log(EPS) / np.log(r + np.hypot(r, 1)))) + 1 for r in ratio)

    def grow(self, stats: pd.DataFrame) -> None:
        """Leaves from the rows (cell, label, n, low and high of each coordinate) of the cells."""
        cell, n = stats["cell"].to_numpy(), stats["n"].to_numpy()
        cap = max(CAP, int(n.sum()) // 1000)
        starts, depths, open_ = [], [], np.zeros(1, dtype=np.int64)
        for d in range(DEPTH + 1):
            many = np.bincount(np.searchsorted(open_, cell[np.isin(cell >> (DEPTH - d), open_)] >> (DEPTH - d)), n[np.isin(cell >> (DEPTH - d), open_)], minlength=len(open_))
            done = (many > 0) & ((many <= cap) | (d == DEPTH))
            starts.append(open_[done] << (DEPTH - d))
            depths.append(np.full(int(done.sum()), d))
            open_ = np.repeat(open_[many > cap] * 2, 2) + np.tile([0, 1], int((many > cap).sum())) if d < DEPTH else open_
        by = np.argsort(np.concatenate(starts))
        self.start, self.depth = np.concatenate(starts)[by], np.concatenate(depths)[by]
        of, k = self.leaf(cell), len(self.start)
        self.counts = np.zeros((k, len(self.labels)), dtype=np.int64)
        np.add.at(self.counts, (of, np.searchsorted(self.labels, stats["label"].to_numpy())), n)
        self.tight = np.repeat([[np.inf, np.inf, -np.inf, -np.inf]], k, axis=0)
        for c, (name, take) in enumerate((("l0", np.minimum), ("l1", np.minimum), ("h0", np.maximum), ("h1", np.maximum))):
            take.at(self.tight[:, c], of, stats[name].to_numpy())
        total = np.cumsum(self.counts.sum(axis=1))
        self.group = np.minimum((total - 1) * GROUPS // total[-1], GROUPS - 1)

    def part(self) -> None:
        """The near leaves of each leaf and the far parts of the tree that make up the rest."""
        k = len(self.start)
        low, high = (np.zeros((k, 2)) for _ in range(2))
        for d in np.unique(self.depth):
            low[self.depth == d], high[self.depth == d] = self.boxes(d, self.start[self.depth == d] >> (DEPTH - d))
        near, self.far = [], [[] for _ in range(k)]
        at, prefix = np.arange(k), np.zeros(k, dtype=np.int64)
        for d in range(DEPTH + 1):
            a, b = self.boxes(d, prefix)
            gap = np.hypot(*np.maximum(np.maximum(a - high[at], low[at] - b), 0).T)
            off = gap >= self.sides[d].max()
            for t, q in zip(at[off].tolist(), prefix[off].tolist(), strict=True):
                self.far[t].append((d, q))
            at, prefix = at[~off], prefix[~off]
            first = np.searchsorted(self.start, prefix << (DEPTH - d))
            single = (self.depth[np.minimum(first, k - 1)] == d) & (self.start[np.minimum(first, k - 1)] == prefix << (DEPTH - d))
            near.append((at[single], first[single]))
            if d < DEPTH:
                at, prefix = np.repeat(at[~single], 2), np.repeat(2 * prefix[~single], 2) + np.tile([0, 1], int((~single).sum()))
                some = np.searchsorted(self.start, prefix << (DEPTH - d - 1)) < np.searchsorted(self.start, (prefix + 1) << (DEPTH - d - 1))
                at, prefix = at[some], prefix[some]
        of, other = (np.concatenate(c) for c in zip(*near, strict=True))
        self.near = [np.sort(other[of == t]) for t in range(k)]

    def reach(self) -> None:
        """The leaves that can hold the nearest points, of its own and of other labels, of each point of a leaf."""
        k, has = len(self.start), self.counts > 0
        low, high = self.tight[:, :2], self.tight[:, 2:]
        self.near = []
        for t in range(k):
            least = np.hypot(*np.maximum(np.maximum(low - high[t], low[t] - high), 0).T)
            most = np.hypot(*np.maximum(high - low[t], high[t] - low).T)
            one = np.where(has, most[:, None], np.inf).min(axis=0)
            others = self.counts - (np.arange(k) == t)[:, None]
            own = np.where(others > 0, most[:, None], np.inf).min(axis=0)
            need = np.zeros(k, dtype=bool)
            for label in np.flatnonzero(has[t]):
                rest = np.arange(len(self.labels)) != label
                bound = one[rest].min(initial=np.inf)
                need |= has[:, label] & (least <= own[label] * (1 + 1e-9))
                need |= has[:, rest].any(axis=1) & (least <= bound * (1 + 1e-9))
            need[t] = True
            self.near.append(np.flatnonzero(need))

    def rise(self, of_leaves: dict[int, np.ndarray]) -> None:
        """Weights of the nodes of all parts of the tree from those of the leaves."""
        self.weights = {(int(self.depth[i]), int(self.start[i] >> (DEPTH - self.depth[i]))): w for i, w in of_leaves.items()}
        for d in range(DEPTH, 0, -1):
            for (e, prefix), w in list(self.weights.items()):
                if e == d:
                    to = (d - 1, prefix >> 1)
                    (a,), (b,) = self.boxes(d, np.array([prefix]))
                    (low,), (high,) = self.boxes(d - 1, np.array([prefix >> 1]))
                    for axis, (p, q) in enumerate(zip(self.orders(d), self.orders(d - 1), strict=True)):
                        w = np.moveaxis(np.tensordot(shares(nodes(a[axis], b[axis], p), low[axis], high[axis], q), w, ((0,), (axis,))), 0, axis)
                    self.weights[to] = self.weights[to] + w if to in self.weights else w

    def points_of(self, depth: int, prefix: int) -> np.ndarray:
        (a,), (b,) = self.boxes(depth, np.array([prefix]))
        p, q = self.orders(depth)
        return np.stack(np.meshgrid(nodes(a[0], b[0], p), nodes(a[1], b[1], q), indexing="ij"), axis=-1).reshape(-1, 2)


def fits(p: DataFrame, dim: int) -> bool:
    """Whether points are so many, of so few coordinates and labels, that leaves pay."""
    if dim > 2:
        return False
    finite = [F.max(F.coalesce(F.abs(C("x")[i]), F.lit(float("inf")))).alias(f"m{i}") for i in range(dim)]
    sizes = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"), *finite).collect()  # a row a key
    return bool(sizes) and max(r["n"] for r in sizes) >= FROM and all(r["k"] <= LABELS and all(r[f"m{i}"] < 1e100 for i in range(dim)) for r in sizes)


def _trees(p: DataFrame, scratch: Scratch) -> dict[tuple[str, str], Tree]:
    """A tree for each key of points (keys, row_id, label, m, x0, x1)."""
    box = p.groupBy(*KEYS).agg(*(f(c).alias(a) for f, c, a in ((F.min, "x0", "l0"), (F.min, "x1", "l1"), (F.max, "x0", "h0"), (F.max, "x1", "h1"))), F.sort_array(F.collect_set("label")).alias("labels")).collect()
    trees = {(r["dataset"], r["labelset"]): Tree(np.array([r["l0"], r["l1"]]), np.array([r["h0"], r["h1"]]), np.array(r["labels"])) for r in box}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, some in pdf.groupby(KEYS):
                x = some[["x0", "x1"]].to_numpy()
                yield some[[*KEYS, "label"]].assign(cell=trees[key].cells(x), x0=x[:, 0], x1=x[:, 1])

    celled = p.mapInPandas(run, f"{KEYED}, label int, cell long, x0 double, x1 double")
    stats = celled.groupBy(*KEYS, "cell", "label").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("l0"), F.min("x1").alias("l1"), F.max("x0").alias("h0"), F.max("x1").alias("h1"))
    for key, some in stats.toArrow().to_pandas().groupby(KEYS):  # 2^DEPTH x LABELS rows a key at most
        trees[key].grow(some)
    return trees


def _dealt(p: DataFrame, trees: dict[tuple[str, str], Tree], scratch: Scratch) -> DataFrame:
    """(keys, grp, leaf, own, point): each point once for its own group of leaves and once for each other one that a leaf of it is near to."""
    wanted = {}
    for key, t in trees.items():
        pairs = np.unique(np.concatenate([np.stack((t.near[i], np.full(len(t.near[i]), t.group[i])), axis=1) for i in range(len(t.start))]), axis=0)
        wanted[key] = (pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(t.start) + 1)))
    light = {k: Tree(t.low, t.high, t.labels, t.start, group=t.group) for k, t in trees.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, some in pdf.groupby(KEYS):
                t, (to, ends) = light[key], wanted[key]
                leaf = t.leaf(t.cells(some[["x0", "x1"]].to_numpy()))
                many = ends[leaf + 1] - ends[leaf]
                row = np.repeat(np.arange(len(some)), many)
                grp = to[np.repeat(ends[leaf], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
                yield some.iloc[row].assign(grp=grp, leaf=leaf[row], own=grp == t.group[leaf[row]])

    schema = f"{KEYED}, {POINT}, grp int, leaf int, own boolean"
    return scratch.keep(p.mapInPandas(run, schema).repartition(GROUPS, *KEYS, "grp").sortWithinPartitions(*KEYS, "grp", "leaf"))


def _by_group(dealt: DataFrame, work, schema: str) -> DataFrame:
    """work(key, points of a group and near it, those by leaf) for each group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[KEYS].iloc[0])
        pdf = pdf.sort_values(["leaf", "label"], ignore_index=True)
        leaf = pdf["leaf"].to_numpy()
        heads = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        where = {int(leaf[a]): slice(a, b) for a, b in zip(heads, np.r_[heads[1:], len(leaf)], strict=True)}
        own = [int(leaf[a]) for a in heads if pdf["own"].iat[a]]
        out = work(key, {c: pdf[c].to_numpy() for c in ("row_id", "label", "m")} | {"x": pdf[["x0", "x1"]].to_numpy()}, where, own)
        return out.assign(dataset=key[0], labelset=key[1])

    return dealt.repartition(GROUPS, *KEYS, "grp").groupBy(*KEYS, "grp").applyInPandas(run, f"{schema}, {KEYED}")


def _flat(p: DataFrame, dim: int, m) -> DataFrame:
    return p.select(*KEYS, "row_id", "label", m.cast("long").alias("m"), C("x")[0].alias("x0"), (C("x")[1] if dim > 1 else F.lit(0.0)).alias("x1"))


def _sums(xs: np.ndarray, ys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distances of xs to ys, summed with their weights, in pieces that stay in the cache."""
    out = np.zeros((len(xs), of.shape[1]))
    for i in range(0, len(xs), 256):
        for j in range(0, len(ys), 256):
            d = xs[i : i + 256, 0, None] - ys[None, j : j + 256, 0]
            e = xs[i : i + 256, 1, None] - ys[None, j : j + 256, 1]
            d *= d
            e *= e
            d += e
            out[i : i + 256] += np.sqrt(d, out=d) @ of[j : j + 256]
    return out


def distance_sums(once: DataFrame, dim: int) -> DataFrame:
    """What ``pairs.distinct_sums`` gives, of distinct points and labels (keys, row_id, x, label, m)."""
    spark, scratch = once.sparkSession, Scratch(once.sparkSession)
    ship(spark)
    p = scratch.keep(_flat(once, dim, C("m")))
    trees = _trees(p, scratch)
    for t in trees.values():
        t.part()
    dealt = _dealt(p, trees, scratch)
    plan = spark.sparkContext.broadcast(trees)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for (dataset, labelset, leaf), some in pdf.groupby([*KEYS, "leaf"]):
                t = plan.value[dataset, labelset]
                d = int(t.depth[leaf])
                (a,), (b,) = t.boxes(d, t.start[[leaf]] >> (DEPTH - d))
                x = some[["x0", "x1"]].to_numpy()
                sx, sy = (shares(x[:, k], a[k], b[k], n) for k, n in enumerate(t.orders(d)))
                label, m = some["label"].to_numpy(), some["m"].to_numpy()
                for v in np.unique(label):
                    w = (sx[label == v] * m[label == v, None]).T @ sy[label == v]
                    yield pd.DataFrame({"dataset": [dataset], "labelset": [labelset], "leaf": [leaf], "label": [v], "w": [w.ravel()]})

    made = dealt.where("own").mapInPandas(weigh, f"{KEYED}, leaf int, label int, w array<double>").toArrow().to_pandas()  # some rows a leaf and label
    for key, some in made.groupby(KEYS):
        t, of = trees[key], {}
        for leaf, label, w in zip(some["leaf"], some["label"], some["w"], strict=True):
            shape = t.orders(int(t.depth[leaf]))
            of.setdefault(int(leaf), np.zeros((*shape, len(t.labels))))[:, :, np.searchsorted(t.labels, label)] += np.asarray(w).reshape(shape)
        t.rise(of)
    full = spark.sparkContext.broadcast(trees)

    def work(key, c, where, own) -> pd.DataFrame:
        t, parts = full.value[key], []
        k = len(t.labels)
        for leaf in own:
            xs = c["x"][where[leaf]]
            rows = np.concatenate([np.arange(where[j].start, where[j].stop) for j in t.near[leaf].tolist()])
            of = np.zeros((len(rows), k))
            of[np.arange(len(rows)), np.searchsorted(t.labels, c["label"][rows])] = c["m"][rows]
            ys = [c["x"][rows], *(t.points_of(*n) for n in t.far[leaf])]
            ws = [of, *(t.weights[n].reshape(-1, k) for n in t.far[leaf])]
            parts.append(_sums(xs, np.concatenate(ys), np.concatenate(ws)))
        at = np.concatenate([np.arange(where[i].start, where[i].stop) for i in own] or [np.zeros(0, np.int64)])
        made = {n: np.repeat(c[n][at], k) for n in ("row_id", "label", "m")}
        return pd.DataFrame(made | {"other": np.tile(t.labels, len(at)), "sum_d": np.concatenate(parts).ravel() if parts else np.zeros(0)})

    return _by_group(dealt, work, "row_id long, label int, m long, other int, sum_d double").select(*KEYS, "row_id", "label", "m", "other", "sum_d")


def kernel_fits(p: DataFrame, dim: int, bandwidth: float) -> bool:
    """Whether the grid of the kernel's boxes is small enough to be held."""
    spans = p.groupBy(*KEYS).agg(*((F.max(C("x")[i]) - F.min(C("x")[i])).alias(f"s{i}") for i in range(dim))).collect()  # a row a key
    return all(np.prod([NODES * max(1, np.ceil(r[f"s{i}"] / (2 * bandwidth))) for i in range(dim)]) <= GRID for r in spans)


def nearest_and_kernel(points: DataFrame, dim: int, bandwidth: float) -> DataFrame:
    """(keys, row_id, label, near, far, kernel): distances to the nearest other point of the same label and of others, and ``pair_stats``' kernel over all."""
    spark, scratch = points.sparkSession, Scratch(points.sparkSession)
    ship(spark)
    p = scratch.keep(_flat(points, dim, F.lit(1)))
    trees = _trees(p, scratch)
    for t in trees.values():
        t.reach()
    dealt = _dealt(p, trees, scratch)
    light = {k: (t.low, t.high, np.maximum(1, np.ceil((t.high - t.low) / (2 * bandwidth))).astype(int)) for k, t in trees.items()}

    def boxed(key, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(box by each coordinate, places of its points, their shares by each coordinate)"""
        low, high, n = light[key]
        side = np.where(high > low, (high - low) / n, 1.0)
        at = np.clip(((x - low) / side).astype(int), 0, n - 1)
        number = at[:, 0] * n[1] + at[:, 1]
        by = np.argsort(number, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(number[by])) + 1):
            a = low + at[rows[0]] * side
            yield (*at[rows[0]].tolist(), rows, *(shares(x[rows, k], a[k], a[k] + side[k], NODES) for k in (0, 1)))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, some in pdf.groupby(KEYS):
                made = [(*key, i, j, (sx.T @ sy).ravel()) for i, j, _, sx, sy in boxed(key, some[["x0", "x1"]].to_numpy())]
                yield pd.DataFrame(made, columns=[*KEYS, "i", "j", "w"])

    made = dealt.where("own").mapInPandas(weigh, f"{KEYED}, i int, j int, w array<double>").toArrow().to_pandas()  # some rows a box
    grids = {}
    for key, some in made.groupby(KEYS):
        low, high, n = light[key]
        w = np.zeros((n[0], NODES, n[1], NODES))
        for i, j, v in zip(some["i"], some["j"], some["w"], strict=True):
            w[i, :, j, :] += np.asarray(v).reshape(NODES, NODES)
        side = np.where(high > low, (high - low) / n, 1.0)
        at = [np.concatenate([nodes(low[k] + b * side[k], low[k] + (b + 1) * side[k], NODES) for b in range(n[k])]) for k in (0, 1)]
        gx, gy = (np.exp(-((v[:, None] - v[None, :]) ** 2) / (2 * bandwidth * bandwidth)) for v in at)
        grids[key] = (gx @ w.reshape(n[0] * NODES, n[1] * NODES) @ gy).reshape(w.shape)
    full = spark.sparkContext.broadcast((trees, grids))

    def work(key, c, where, own) -> pd.DataFrame:
        t, grid = full.value[0][key], full.value[1][key]
        place = np.searchsorted(t.labels, c["label"])
        at = np.concatenate([np.arange(where[i].start, where[i].stop) for i in own] or [np.zeros(0, np.int64)])
        least, end = np.full((len(at), len(t.labels)), np.inf), 0
        for leaf in own:
            mine = np.arange(where[leaf].start, where[leaf].stop)
            for rows in np.array_split(mine, -(-len(mine) // 256)):
                begin, end = end, end + len(rows)
                for j in t.near[leaf].tolist():
                    for a in range(where[j].start, where[j].stop, 4096):
                        to = np.arange(a, min(a + 4096, where[j].stop))
                        d = c["x"][rows, 0, None] - c["x"][None, to, 0]
                        e = c["x"][rows, 1, None] - c["x"][None, to, 1]
                        d *= d
                        e *= e
                        d += e
                        if j == leaf:
                            d[rows[:, None] == to[None, :]] = np.inf
                        heads = np.flatnonzero(np.r_[True, np.diff(place[to]) != 0])  # a leaf's points are in order of their label
                        for h, stop in zip(heads, np.r_[heads[1:], len(to)], strict=True):
                            v = place[to[h]]
                            least[begin:end, v] = np.minimum(least[begin:end, v], d[:, h:stop].min(axis=1))
        rows = np.arange(len(at))
        near = least[rows, place[at]].copy()
        least[rows, place[at]] = np.inf
        far, kernel = least.min(axis=1, initial=np.inf), np.zeros(len(at))
        if len(at):
            for i, j, some, sx, sy in boxed(key, c["x"][at]):
                kernel[some] = ((sx @ grid[i, :, j, :]) * sy).sum(axis=1)
        none = lambda v: pd.Series(np.sqrt(v), dtype="Float64").mask(np.isinf(v))
        return pd.DataFrame({"row_id": c["row_id"][at], "label": c["label"][at], "near": none(near), "far": none(far), "kernel": np.maximum(kernel, 1.0)})

    return _by_group(dealt, work, "row_id long, label int, near double, far double, kernel double").select(*KEYS, "row_id", "label", "near", "far", "kernel")
