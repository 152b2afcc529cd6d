"""Many points of two coordinates: leaves give what the pass over all pairs gives."""

import numpy as np
import pytest

from cohesia.functions import pairwise
from cohesia.operators import leaves, pairs


def _points(spark, kind):
    rng = np.random.default_rng(6)
    x = np.column_stack((rng.integers(-99985, 999980, 3000) / 100, rng.integers(0, 25, 3000))) if kind == "lines" else np.r_[rng.normal(0, 1, (2400, 2)), rng.normal(9, 0.01, (598, 2)), [[40.0, -3.0]] * 2]
    y = rng.integers(0, 4, 3000)
    y[-1] = 7  # alone in its cluster, and a copy of a point of another
    if kind == "scaled":
        x = (x - x.min(axis=0)) / np.ptp(x, axis=0) * 2 - 1
    return spark.createDataFrame([("d", "gt", i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "dataset string, labelset string, row_id long, x array<double>, label int")


@pytest.fixture
def small(monkeypatch):
    """Leaves from the first point on, and small ones; the pass over all pairs is out of bounds once that is asked for."""
    monkeypatch.setattr(leaves, "CAP", 40)
    monkeypatch.setattr(leaves, "GROUPS", 5)

    def only_leaves():
        monkeypatch.setattr(leaves, "FROM", 1)
        monkeypatch.setattr(pairs, "block_pairs", lambda *a, **k: pytest.fail("all pairs"))

    return only_leaves


@pytest.mark.parametrize("kind", ["lines", "plane"])
def test_sums_of_distances(spark, small, kind):
    p = _points(spark, kind)
    rows = lambda: {(r["row_id"], r["other"]): (r["m"], r["sum_d"]) for r in pairs.distinct_sums(p, dim=2).collect()}
    want = rows()
    small()
    got = rows()
    assert got.keys() == want.keys()
    assert all(got[k][0] == m and abs(got[k][1] - s) <= 1e-12 * s + 1e-9 for k, (m, s) in want.items())


def test_nearest_and_kernel(spark, small):
    p = _points(spark, "scaled")
    want = {r["row_id"]: r for r in pairwise._own_other(pairs.pair_stats(p, bandwidth=0.05)).collect()}
    small()
    got = leaves.nearest_and_kernel(p, 2, 0.05).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["row_id"]]
        assert (r["label"], r["near"], r["far"]) == (w["label"], w["near"], w["far"])
        assert abs(r["kernel"] - w["kernel"]) <= 1e-11 * w["kernel"]
    assert pairwise.viasckde(p, 2).collect()[0]["value"] is None  # as before for a cluster of one


@pytest.mark.parametrize("plan", [pairwise.viasckde, pairwise.viasckde_cumulative])
def test_viasckde_over_leaves(spark, small, plan):
    p = _points(spark, "scaled").where("label < 4")
    want = plan(p, 2).collect()[0]["value"]
    small()
    assert abs(plan(p, 2).collect()[0]["value"] - want) < 1e-10
