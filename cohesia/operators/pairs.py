"""All-pairs work in blocks, without any pair ever leaving the task that made it.

Points are dealt into blocks of ``BLOCK`` rows. The square of all pairs of blocks is cut into a grid of about as many
cells as there are cores (more where a cell would hold over ``HELD`` blocks); a block is sent once for each cell of its row
and of its column, so what is shuffled grows with points x the square root of the tasks. A cell holds the blocks of
its column as matrices and takes those of its row one by one; it hands on sums, minima and maxima only,
added up over its column: by point and cluster (``pair_stats``) or by histogram bin (``pair_histogram``). Results grow with
points x clusters x the grid's side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from cohesia.operators import leaves
from cohesia.operators.attach import attach
from cohesia.operators.frames import KEYS
from cohesia.session import Scratch, ship

BLOCK = 1024
#: Blocks of a column that a cell holds at most.
HELD = 64
#: (row ids, labels, matrix of points, extra), and its number.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blocks(p: DataFrame, extra: str | None = None) -> DataFrame:
    """Points of each key in blocks: rows (keys, block, many, rows), block by a hash of row_id, many their number.

    extra: one more column of doubles to carry along.
    """
    sizes = p.groupBy(*KEYS).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("long").alias("many"))
    dealt = attach(p, sizes, KEYS).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("many")))
    more = F.col(extra).cast("double") if extra else F.lit(0.0)
    rows = F.sort_array(F.collect_list(F.struct("row_id", "label", "x", more.alias("extra"))))  # about BLOCK rows
    return dealt.groupBy(*KEYS, "block", "many").agg(rows.alias("rows"))


def unpack(rows: pa.StructArray) -> Block:
    ids, labels, xs, extra = rows.flatten()
    numbers = [c.to_numpy(zero_copy_only=False) for c in (ids, labels, extra)]
    return numbers[0].astype(np.int64), numbers[1].astype(np.int64), xs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1), numbers[2].astype(float)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distance matrix by coordinate sums, exact for equal points."""
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return 1 - (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300)
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        if metric in ("euclidean", "sqeuclidean"):
            d *= d
            out += d
        elif metric == "cityblock":
            out += np.abs(d)
        elif metric == "chebyshev":
            np.maximum(out, np.abs(d), out=out)
        else:
            raise ValueError(f"Unknown metric: {metric}")
    return np.sqrt(out, out=out) if metric == "euclidean" else out


#: Below this share of the squared lengths a squared distance by products is taken again by differences.
CLOSE = 1e-5


def by_products(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The distances for points of many coordinates by one matrix product; pairs so close that digits would cancel are taken again.

    Equal points have distance 0. Other last digits than those of ``distances`` are possible, also between (a, b) and (b, a).
    """
    if metric not in ("euclidean", "sqeuclidean") or a.shape[1] <= 8 or not len(a) or not len(b):
        return distances(a, b, metric)
    centre = b.mean(axis=0)
    p, q = a - centre, b - centre
    lengths = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
    out = p @ q.T
    out *= -2.0
    out += lengths
    lengths *= CLOSE
    i, j = np.nonzero(~(out >= lengths))  # and what is no number
    if 20 * len(i) > out.size:
        return distances(a, b, metric)
    for at in range(0, len(i), 65_536):
        r, c = i[at : at + 65_536], j[at : at + 65_536]
        out[r, c] = ((a[r] - b[c]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out) if metric == "euclidean" else out


def block_pairs(left: DataFrame, right: DataFrame, work: Callable[[Block, list[tuple[Block, bool]]], list[np.ndarray | pa.Array]], schema: str, ordered: bool = True) -> DataFrame:
    """work(left block, right blocks of a cell) for every cell, all blocks of one cell being of the same keys.

    Each right block comes with whether it is the left one itself. ordered: pairs are met as (a, b) and as (b, a); else once, and a
    block with itself. ``work`` returns the columns of ``schema`` after the keys.
    """
    ship(left.sparkSession)
    side = int(np.ceil(np.sqrt(2 * left.sparkSession.sparkContext.defaultParallelism)))
    most = right.groupBy(*KEYS).agg(F.max("many").alias("of_right"))
    grid = F.greatest(F.least(F.lit(side), F.greatest("many", "of_right")), F.ceil(F.col("of_right") / HELD)).cast("int")
    with_grid = lambda df: attach(df.withColumn("row_id", F.col("block")), most, KEYS).withColumn("grid", grid).withColumn("own", F.pmod("block", "grid").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    # a cell (i, j) has the left blocks of group i and the right blocks of group j
    rows = with_grid(left).withColumn("j", every).select(*KEYS, F.col("own").alias("i"), "j", F.lit(1).alias("turn"), "block", "rows")
    columns = with_grid(right).withColumn("i", every).select(*KEYS, "i", F.col("own").alias("j"), F.lit(0).alias("turn"), "block", "rows")
    cells = rows.unionByName(columns)
    cells = cells if ordered else cells.where("i <= j")
    cell = [*KEYS, "i", "j"]
    dealt = cells.repartition(*cell).sortWithinPartitions(*cell, "turn", "block")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in cell), strict=True))
            for k, (turn, number) in enumerate(zip(batch.column("turn").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                if keys[k] != at:
                    at, held = keys[k], []
                block = unpack(batch.column("rows")[k].values)
                if turn == 0:
                    held.append((number, block))
                    continue
                i, j = at[-2:]
                others = [(b, n == number) for n, b in held if ordered or i < j or n >= number]
                if not others:
                    continue
                out = work(block, others)
                if len(out[0]):
                    keyed = [pa.array([v] * len(out[0]), type=f.type) for v, f in zip(at[: len(KEYS)], arrow, strict=False)]
                    made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, list(arrow)[len(KEYS) :], strict=True)]
                    yield pa.RecordBatch.from_arrays([*keyed, *made], schema=arrow)

    return dealt.mapInArrow(run, schema)


def pair_stats(p: DataFrame, metric: str = "euclidean", bandwidth: float | None = None) -> DataFrame:
    """(keys, row_id, label, other, n, sum_d, min_d, max_d, kernel): each point against each cluster, itself left out.

    kernel: sum of exp(-d^2 / (2 bandwidth^2)), the point itself included; 0 without a bandwidth.
    """

    def work(a, others):
        ids, own_labels, xs, _ = a
        labels = np.unique(np.concatenate([b[1] for b, _ in others]))
        shape = (len(ids), len(labels))
        n, sums, kernel = np.zeros(shape, dtype=np.int64), np.zeros(shape), np.zeros(shape)
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for (jds, jlabels, ys, _), same in others:
            by = np.argsort(jlabels, kind="stable")
            jds, jlabels, ys = jds[by], jlabels[by], ys[by]
            d = by_products(xs, ys, metric)
            heads = np.flatnonzero(np.r_[True, np.diff(jlabels) != 0])
            at = np.searchsorted(labels, jlabels[heads])
            if bandwidth:
                near = np.exp((d * d if metric == "euclidean" else distances(xs, ys, "sqeuclidean")) / (-2 * bandwidth * bandwidth))
                kernel[:, at] += np.add.reduceat(near, heads, axis=1)
            count = np.broadcast_to(np.diff(np.r_[heads, len(by)]), (len(ids), len(heads)))
            if same:
                mine = ids[:, None] == jds[None, :]
                count = count - np.add.reduceat(mine, heads, axis=1, dtype=np.int64)
                sums[:, at] += np.add.reduceat(np.where(mine, 0.0, d), heads, axis=1)
                low[:, at] = np.minimum(low[:, at], np.minimum.reduceat(np.where(mine, np.inf, d), heads, axis=1))
                high[:, at] = np.maximum(high[:, at], np.maximum.reduceat(np.where(mine, -np.inf, d), heads, axis=1))
            else:
                sums[:, at] += np.add.reduceat(d, heads, axis=1)
                low[:, at] = np.minimum(low[:, at], np.minimum.reduceat(d, heads, axis=1))
                high[:, at] = np.maximum(high[:, at], np.maximum.reduceat(d, heads, axis=1))
            n[:, at] += count
        i, k = np.nonzero((n > 0) | (kernel > 0))
        none = n[i, k] == 0
        return [ids[i], own_labels[i].astype(np.int32), labels[k].astype(np.int32), n[i, k], sums[i, k], pa.array(low[i, k], mask=none), pa.array(high[i, k], mask=none), kernel[i, k]]

    made = blocks(p)
    parts = block_pairs(made, made, work, "dataset string, labelset string, row_id long, label int, other int, n long, sum_d double, min_d double, max_d double, kernel double")
    whole = ((F.sum("n"), "n"), (F.sum("sum_d"), "sum_d"), (F.min("min_d"), "min_d"), (F.max("max_d"), "max_d"), (F.sum("kernel"), "kernel"))
    return parts.groupBy(*KEYS, "row_id", "label", "other").agg(*(f.alias(c) for f, c in whole))


def distinct_sums(p: DataFrame, metric: str = "euclidean", dim: int | None = None) -> DataFrame:
    """(keys, row_id, label, m, other, sum_d): the sum of distances of each distinct point and label to all points of each cluster.

    m rows share the point and the label, row_id is the first of them. Copies are compared once and counted m times.
    dim: the number of coordinates, where known; many points of one or two go through ``leaves``.
    """

    def work(a, others):
        ids, own_labels, xs, many = a
        labels = np.unique(np.concatenate([b[1] for b, _ in others]))
        sums = np.zeros((len(ids), len(labels)))
        for (_, jlabels, ys, weights), _ in others:
            of = np.zeros((len(ys), len(labels)))
            of[np.arange(len(ys)), np.searchsorted(labels, jlabels)] = weights
            sums += by_products(xs, ys, metric) @ of
        i, k = (v.ravel() for v in np.indices(sums.shape))
        return [ids[i], own_labels[i].astype(np.int32), many[i].astype(np.int64), labels[k].astype(np.int32), sums.ravel()]

    once = Scratch(p.sparkSession).keep(p.groupBy(*KEYS, "label", "x").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("m")))
    if dim and metric == "euclidean" and leaves.fits(once, dim):
        return leaves.distance_sums(once, dim)
    made = blocks(once, "m")
    parts = block_pairs(made, made, work, "dataset string, labelset string, row_id long, label int, m long, other int, sum_d double")
    return parts.groupBy(*KEYS, "row_id", "label", "m", "other").agg(F.sum("sum_d").alias("sum_d"))


#: Distance bins of one refinement of a sum over the smallest or largest pairs.
BINS = 4096


def pair_histogram(made: DataFrame, low: float, high: float, metric: str = "euclidean") -> DataFrame:
    """(keys, bin, n, s): number and sum of unordered pair distances by equal bins from low to high; those below and above in bins -1 and BINS."""

    def work(a, others):
        n, s = np.zeros(BINS + 2, dtype=np.int64), np.zeros(BINS + 2)
        for b, same in others:
            d = by_products(a[2], b[2], metric)
            d = d[np.triu(np.ones(d.shape, dtype=bool), 1)] if same else d.ravel()
            at = np.ones(len(d), dtype=np.int64)
            if high > low:
                place = d - low
                place *= BINS / (high - low)
                place += 1.0  # bin -1 is place 0
                at = np.clip(place, 0.0, BINS + 1, out=place).astype(np.int64)
            n += np.bincount(at, minlength=BINS + 2)
            s += np.bincount(at, d, minlength=BINS + 2)
        has = np.flatnonzero(n)
        return [(has - 1).astype(np.int32), n[has], s[has]]

    parts = block_pairs(made, made, work, "dataset string, labelset string, bin int, n long, s double", ordered=False)
    return parts.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def nearest_reflected(p: DataFrame, q: DataFrame, k: int = 2, metric: str = "euclidean") -> DataFrame:
    """(keys, row_id, label, mean_k): mean distance of q's points to their k nearest in p's same cluster (a point of its own cluster may be itself)."""

    def work(a, others):
        ids, labels, xs, _ = a
        best = np.full((len(ids), k), np.inf)
        for (_, jlabels, ys, _), _ in others:
            for label in np.intersect1d(labels, jlabels):  # only points of one cluster are compared
                i = np.flatnonzero(labels == label)
                d = by_products(xs[i], ys[jlabels == label], metric)
                d = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > 4 * k else d
                best[i] = np.sort(np.concatenate([best[i], d], axis=1), axis=1)[:, :k]
        return [ids, labels.astype(np.int32), pa.array([row[np.isfinite(row)].tolist() for row in best], type=pa.list_(pa.float64()))]

    parts = block_pairs(blocks(q), blocks(p), work, "dataset string, labelset string, row_id long, label int, near array<double>")
    merged = parts.groupBy(*KEYS, "row_id", "label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))  # k values a block
    mean = F.when(F.size("near") == k, F.aggregate("near", F.lit(0.0), lambda s, v: s + v) / k)
    return merged.select(*KEYS, "row_id", "label", mean.alias("mean_k"))


def nearest_labelled(q: DataFrame, p: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(keys, row_id, label): for each point of q the label of the nearest point of p of the same keys, that of the lowest row_id on a tie."""

    def work(a, others):
        ids, _, xs, _ = a
        near, who, label = np.full(len(ids), np.inf), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int32)
        for (jds, jlabels, ys, _), _ in others:
            by = np.argsort(jds)
            d = distances(xs, ys[by], metric)
            at = d.argmin(axis=1)
            least, j = d[np.arange(len(ids)), at], jds[by][at]
            closer = (least < near) | (least == near) & (j < who)
            near, who, label = np.where(closer, least, near), np.where(closer, j, who), np.where(closer, jlabels[by][at], label).astype(np.int32)
        return [ids, near, who, label]

    parts = block_pairs(blocks(q), blocks(p), work, "dataset string, labelset string, row_id long, d double, who long, label int")
    return parts.groupBy(*KEYS, "row_id").agg(F.min(F.struct("d", "who", "label")).alias("m")).select(*KEYS, "row_id", F.col("m.label").alias("label"))


def bind_noise(p: DataFrame, noise: int = -1) -> DataFrame:
    """Each noise point gets the label of its nearest point that is no noise; a data set of nothing but noise stays as it is."""
    lost, rest = p.where(F.col("label") == noise), p.where(F.col("label") != noise)
    found = nearest_labelled(lost, rest).select(*KEYS, "row_id", F.col("label").alias("bound"))
    bound = lost.join(found, [*KEYS, "row_id"], "left").select(*KEYS, "row_id", "x", F.coalesce("bound", "label").cast("int").alias("label"))
    return rest.select(*KEYS, "row_id", "x", "label").unionByName(bound)
