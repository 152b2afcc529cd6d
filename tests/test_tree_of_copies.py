"""Copies of points are tied to the first of them; the tree is the one of all points."""

import numpy as np

from cohesia.operators import mst


def test_tree_of_copies():
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 6, (300, 2)).astype(float), np.repeat(rng.normal(size=(40, 3)), 5, axis=0), rng.normal(size=(30, 2)), np.zeros((9, 2)), np.array([[0.0, 1e-200], [-0.0, 0.0], [0.0, 1e-200], [0.0, 0.0]])):
        ids = rng.permutation(10 * len(x))[: len(x)]
        assert sorted(mst.prim_of_copies(x, ids)) == sorted(mst.prim(x, ids))


def test_only_distinct_points_are_compared(monkeypatch):
    sizes, prim = [], mst.prim
    monkeypatch.setattr(mst, "prim", lambda x, ids: sizes.append(len(x)) or prim(x, ids))
    x = np.tile(np.random.default_rng(4).normal(size=(20, 2)), (50, 1))
    assert len(mst.prim_of_copies(x, np.arange(1000))) == 999
    assert sizes == [20]
