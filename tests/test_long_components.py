"""Components of long paths, and the rounds over all pairs that need them for trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohesia.operators import components, mst
from cohesia.session import Scratch


def _edges(spark, a, b):
    rows = [("d", "gt", int(u), int(v)) for u, v in zip(a, b, strict=True)]
    return spark.createDataFrame(rows, "dataset string, labelset string, a long, b long")


@pytest.mark.parametrize("in_task", [500_000, 200])
def test_long_paths_settle(spark, monkeypatch, in_task):
    # 158 rounds of the smallest label of the neighbours, with jumps, on a path like this
    monkeypatch.setattr(components, "IN_TASK", in_task, raising=False)
    ids = np.random.default_rng(1).permutation(1500) + 10
    path, other = ids[:1000], np.sort(ids[1000:])
    a, b = np.r_[path[:-1], other[1:], 5, 4], np.r_[path[1:], other[:-1], 5, 2]
    got = {r["node"]: r["component"] for r in components.connected_components(_edges(spark, a, b), Scratch(spark)).collect()}
    assert got == {int(i): int(path.min()) for i in path} | {int(i): int(other[0]) for i in other} | {5: 5, 4: 2, 2: 2}


def test_smallest_reachable():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 400, (2, 260))
    want = {int(v): int(v) for v in np.r_[a, b]}
    for _ in range(400):
        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            want[u] = want[v] = min(want[u], want[v])
    nodes, up = components.smallest_reachable(a, b)
    assert dict(zip(nodes.tolist(), up.tolist(), strict=True)) == want


def test_rounds_over_all_pairs_on_a_long_line(spark, monkeypatch):
    # a tree that is one path: its components grow long before the last round
    monkeypatch.setattr(mst, "PRIM_ROWS", 100)
    rng = np.random.default_rng(3)
    n = 1500
    x = np.c_[rng.permutation(n).astype(float), rng.integers(0, 2, n)]
    x[:40] = x[40:80]
    rows = [("d", "gt", i, v, 0) for i, v in enumerate(x.tolist())]
    p = spark.createDataFrame(rows, "dataset string, labelset string, row_id long, x array<double>, label int").repartition(3)
    got = sorted((r["u"], r["v"], r["w"]) for r in mst.mst_edges(p).collect())
    assert got == sorted(mst.prim(x, np.arange(n)))
