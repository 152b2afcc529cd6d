"""Indices against small hand-made frames and plain NumPy."""

import math

import numpy as np
import pytest

from cohesia.functions import external
from cohesia.functions.density import cdbw_value, dbcv
from cohesia.functions.internal import LINEAR, imbalance_ratio, overlap_ratio
from cohesia.functions.pairwise import PAIRWISE
from cohesia.functions.tree import mst_calinski_harabasz, mst_silhouette
from cohesia.operators import edging, frames, grid, kmeans, mst, stats
from cohesia.operators.hull import hull_2d
from cohesia.plans import analyses, registry
from cohesia.sources import generators, report
from cohesia.streaming.incremental import indices, running_stats

SCHEMA = "dataset string, labelset string, row_id long, x array<double>, label int"


def frame(spark, xs, labels, labelset="gt"):
    return spark.createDataFrame([("d", labelset, i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(xs, labels, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.normal(c, 0.6, (12, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    return xs, np.repeat([0, 1, 2], 12)


def value(df):
    return df.collect()[0]["value"]


def dists(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


def test_linear_indices(spark, cloud):
    xs, y = cloud
    p = frame(spark, xs, y)
    mu, centre = np.array([xs[y == k].mean(0) for k in range(3)]), xs.mean(0)
    ssw, ssb = sum(((xs[y == k] - mu[k]) ** 2).sum() for k in range(3)), (12 * ((mu - centre) ** 2).sum(1)).sum()
    assert value(LINEAR["ch"][0](p, 2)) == pytest.approx((ssb / 2) / (ssw / 33))
    assert value(LINEAR["sse"][0](p, 2)) == pytest.approx(ssw)
    md, dc = np.array([dists(xs[y == k], mu[k : k + 1]).mean() for k in range(3)]), dists(mu, mu)
    db = np.mean([max((md[i] + md[j]) / dc[i, j] for j in range(3) if j != i) for i in range(3)])
    assert value(LINEAR["db"][0](p, 2)) == pytest.approx(db)
    # relabelling does not matter, nor do gaps between labels
    assert value(LINEAR["db"][0](frame(spark, xs, 7 - 3 * y), 2)) == pytest.approx(db)
    assert value(imbalance_ratio(p)) == 1.0
    assert 0 <= value(overlap_ratio(p, 2)) <= 1


def test_one_cluster_and_empty(spark):
    p = frame(spark, [[0, 0], [1, 0], [0, 1]], [5, 5, 5])
    assert value(LINEAR["ch"][0](p, 2)) is None
    assert value(LINEAR["np_silhouette"][0](p, 2)) == 0.0
    assert value(overlap_ratio(p, 2)) == 0.0
    assert value(PAIRWISE["silhouette"][0](p, 2)) is None
    none = spark.createDataFrame([], SCHEMA)
    for name in ("ch", "db", "xb", "np_silhouette"):
        assert LINEAR[name][0](none, 2).count() == 0
    assert PAIRWISE["silhouette"][0](none, 2).count() == 0


def test_pairwise_indices(spark, cloud):
    xs, y = cloud
    p, d = frame(spark, xs, y), dists(*([cloud[0]] * 2))
    s = []
    for i in range(36):
        means = [d[i, (y == k) & (np.arange(36) != i)].mean() for k in range(3)]
        a, b = means[y[i]], min(m for k, m in enumerate(means) if k != y[i])
        s.append((b - a) / max(a, b))
    assert value(PAIRWISE["silhouette"][0](p, 2)) == pytest.approx(np.mean(s))
    same = y[:, None] == y[None]
    assert value(PAIRWISE["dunn_paper"][0](p, 2)) == pytest.approx(d[~same].min() / d[same].max())
    up = np.triu_indices(36, 1)
    inside, every = d[up][same[up]], np.sort(d[up])
    n = len(inside)
    low, high = every[:n].sum(), every[-n:].sum()
    assert value(PAIRWISE["c_index"][0](p, 2)) == pytest.approx((inside.sum() - low) / (high - low))
    assert value(PAIRWISE["c_index"][0](frame(spark, xs[:4], [0, 1, 2, 3]), 2)) == 0.0


def test_several_blocks_agree(spark, cloud, monkeypatch):
    from cohesia.operators import pairs

    p = frame(spark, *cloud)
    whole = value(PAIRWISE["silhouette"][0](p, 2)), value(PAIRWISE["sym"][0](p, 2))
    monkeypatch.setattr(pairs, "BLOCK", 7)
    assert (value(PAIRWISE["silhouette"][0](p, 2)), value(PAIRWISE["sym"][0](p, 2))) == pytest.approx(whole)


def test_spanning_trees(spark, cloud, monkeypatch):
    p = frame(spark, *cloud)
    prim = {(r["u"], r["v"]) for r in mst.mst_edges(p).collect()}
    monkeypatch.setattr(mst, "PRIM_ROWS", 10)
    assert {(r["u"], r["v"]) for r in mst.mst_edges(p).collect()} == prim and len(prim) == 35
    everyone = {(r["u"], r["v"]) for r in mst.mst_edges(p, "knn_prim", 100).collect()}
    assert everyone == prim
    assert -1 <= value(mst_silhouette(p, 2)) <= 1 and value(mst_calinski_harabasz(p, 2)) > 0


def test_medoid_ties_take_the_first(spark):
    p = frame(spark, [[0, 0], [1, 0], [5, 5]], [0, 0, 1])
    assert {r["label"]: r["medoid_id"] for r in stats.medoids(p, 2).collect()} == {0: 0, 1: 2}


def test_external(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "t int, p string")
    assert value(external.ari(same, "t", "p")) == 1.0 and value(external.ami(same, "t", "p")) == pytest.approx(1.0)
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(1, 2)] * 3 + [(2, 2)] * 6
    df = spark.createDataFrame(rows, "t int, p int")
    table = np.zeros((3, 3))
    for t, q in rows:
        table[t, q] += 1
    c2 = lambda v: (v * (v - 1) / 2).sum()
    e = c2(table.sum(1)) * c2(table.sum(0)) / (20 * 19 / 2)
    assert value(external.ari(df, "t", "p")) == pytest.approx((c2(table) - e) / ((c2(table.sum(1)) + c2(table.sum(0))) / 2 - e))
    for method in external.METHODS:
        assert value(external.balanced_external(df, "t", "p", method=method)) <= 1
    with pytest.raises(ValueError):
        external.balanced_external(df, "t", "p", method="other")
    one = spark.createDataFrame([(1, 1), (1, 2)], "t int, p int")
    assert value(external.balanced_external(one, "t", "p")) == 1.0
    ids = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t int, p int")
    assert -1 <= value(external.stratified_subsample(ids, "t", "p", "i", rounds=3)) <= 1
    assert -1 <= value(external.weighted_bootstrap(ids, "t", "p", "i", rounds=3)) <= 1


def test_log_factorials(spark):
    from pyspark.sql import functions as F

    for r in spark.range(0, 400, 7).select("id", external._stirling(F.col("id")).alias("f")).collect():
        assert r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-13)


def test_preparation(spark):
    p = frame(spark, [[0, 3], [4, 3], [0, 3], [2, 3]], [9, 4, 4, 4])
    assert sorted(r["row_id"] for r in frames.dedup(p).collect()) == [0, 1, 3]
    assert {r["row_id"]: r["label"] for r in frames.reencode(p).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    assert {tuple(r["x"]) for r in frames.minmax_scale(p, 2).collect()} == {(-1.0, -1.0), (1.0, -1.0), (0.0, -1.0)}
    assert {r["row_id"]: r["label"] for r in frames.singletons_to_noise(p).collect()}[0] == -1
    assert {r["label"] for r in frames.comb_noise(frames.singletons_to_noise(p)).collect()} == {4, 5}
    sets = frames.label_sets(frame(spark, [[-1, -1], [1, 1], [-1, 1], [0.5, -0.2]], [0, 1, 1, 0]))
    assert {r["labelset"] for r in sets.collect()} == {"gt", "dfl", "dsl", "vl", "hl", "rl"}


def test_grid(spark, cloud):
    p = frame(spark, *cloud)
    settled, leaves = grid.grid_points(p, 2, 4, 6)
    assert settled.count() == 36 and leaves.agg({"n": "sum"}).collect()[0][0] == 36
    row = grid.grid_score(p, 2, 4, 6).collect()[0]
    assert 0 < row["purity"] <= 1 and row["value"] == pytest.approx(row["separation"] * (1 - row["normalized"]))
    assert grid.grid_diagnostics(p, 2, 4, 6).count() == 1


def test_density(spark, cloud):
    xs, y = cloud
    assert -1 <= value(dbcv(frame(spark, xs, y), 2)) <= 1
    with pytest.raises(ValueError):
        dbcv(frame(spark, [[0, 0], [0, 0], [1, 1], [2, 1]], [0, 0, 1, 1]), 2)
    assert cdbw_value(xs, y) > 0 and cdbw_value(xs, np.zeros(36, int)) is None
    assert sorted(hull_2d(np.array([[0, 0], [2, 0], [1, 0], [2, 2], [0, 2], [1, 1.0]])).tolist()) == [0, 1, 3, 4]


def test_edging(spark):
    x = np.array([[float(i), 0.0] for i in range(8)])
    assert edging.walk(x, 0, 7, 2) <= 2.0 and edging.walk(x, 3, 3) == 0.0
    p = frame(spark, [[0, 0], [0, 1], [1, 0], [9, 9], [9, 8], [8, 9]], [0, 0, 0, 1, 1, 1])
    assert value(edging.ed_silhouette(p, 2)) > 0.5 and value(edging.ed_davies_bouldin(p, 2)) < 1 and value(edging.ed_calinski_harabasz(p, 2)) > 1
    labels = {r["row_id"]: r["label"] for r in edging.ed_kmeans(p, 2, 2, rounds=3).collect()}
    assert len(labels) == 6


def test_kmeans(spark):
    p = frame(spark, [[0, 0], [0, 1], [1, 0], [9, 9], [9, 8], [8, 9]], [0] * 6)
    for got in (kmeans.kmeans(p, 2, 2), kmeans.ml_kmeans(p, 2, 2), kmeans.lloyd(p, 2, kmeans.first_rows(p, 2), 5)):
        y = {r["row_id"]: r["label"] for r in got.collect()}
        assert y[0] == y[1] == y[2] != y[3] == y[4] == y[5]
    assert kmeans.random_centres(p, 2).count() == 2


def test_reports_and_registry(spark, cloud):
    xs, y = cloud
    p = frame(spark, xs, y).unionByName(frame(spark, xs, np.arange(36) % 2, "odd"))
    scores = analyses.timed_score_table(p, 2, ("ch", "db"))
    table = report.score_report(scores, ["gt", "odd"])
    assert {r["name"] for r in table.collect()} == {"ch (↑)", "db (↓)"} and "time" in table.columns
    registry.register("points", lambda x, labels: float(len(x)))
    assert {r["value"] for r in registry.metric("points")[0](p, 2).collect()} == {36.0}
    with pytest.raises(ValueError):
        registry.metric("no such metric")


def test_generators_and_sweeps(spark):
    for name, make in generators.GENERATORS.items():
        assert make(spark, 60).count() == 60, name
    assert analyses.measure_sweep(spark, "imbalance", per_cluster=30, steps=3).count() == 3
    assert analyses.analyse_measure(spark, "overlap", per_cluster=20, steps=3).where("chosen").count() == 1


def test_stream(spark, cloud, tmp_path):
    xs, y = cloud
    path = str(tmp_path / "in")
    frame(spark, xs, y).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    q = running_stats(stream, 2).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = indices(spark.table("running"), 2).collect()[0]
    assert got["ch"] == pytest.approx(value(LINEAR["ch"][0](frame(spark, xs, y), 2)))


def test_edging_walk_states():
    begun, lost = edging.after_look(None, 2.0, 3.0, 4, 2)
    assert begun == edging.Detour(4, 2.0, 1) and not lost
    assert edging.after_look(begun, 3.0, 3.5, 5, 2) == (edging.Detour(4, 2.0, 0), True)  # it does not begin anew
    assert edging.after_look(begun, 1.5, 1.0, 5, 2) == (None, False)  # nearer than where it began
    assert edging.after_look(begun, 2.5, 1.0, 5, 2) == (edging.Detour(4, 2.0, 0), True)  # closer candidates alone do not end it
    assert edging.after_look(None, 2.0, 1.0, 4, 2) == (None, False)
    x = np.array([[0.0], [1.0], [2.0], [9.0]])
    assert edging.nearest_unseen(x, 1, np.array([False, True, False, False]), 2).tolist() == [0, 2]
    # a wall of points away from the end: the walker turns back and jumps
    x = np.array([[0.0, 0.0], [-1.0, 0.0], [-2.0, 0.0], [-3.0, 0.0], [-4.0, 0.0], [5.0, 0.0]])
    assert edging.walk(x, 0, 5, 1, 2) == 5.0
