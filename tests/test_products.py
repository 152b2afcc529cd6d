"""Distances by products, and sums of least pairs in few rounds."""

import numpy as np

from cohesia.functions import pairwise
from cohesia.operators import pairs


def test_by_products_is_exact_where_digits_cancel():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 64)) + 100.0
    b = np.vstack((rng.normal(size=(300, 64)) + 100.0, a[:5], a[5:10] + 1e-9))
    plain, got = pairs.distances(a, b), pairs.by_products(a, b)
    np.testing.assert_allclose(got, plain, rtol=1e-9)
    assert (got[np.arange(5), 300 + np.arange(5)] == 0).all()
    assert (pairs.by_products(a, np.repeat(a[:3], 80, axis=0)) >= 0).all()


def test_few_histograms(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 9)), rng.integers(0, 3, 60)
    calls = []
    made = pairs.pair_histogram
    monkeypatch.setattr(pairwise.pp, "pair_histogram", lambda *a, **k: calls.append(1) or made(*a, **k))
    p = spark.createDataFrame([("d", "gt", i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "dataset string, labelset string, row_id long, x array<double>, label int")
    i, j = np.triu_indices(60, 1)
    d, same = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)), y[i] == y[j]
    s, m = np.sort(d), int(same.sum())
    want = (d[same].sum() - s[:m].sum()) / (s[-m:].sum() - s[:m].sum())
    assert abs(pairwise.c_index(p, 9).collect()[0]["value"] - want) < 1e-12
    assert len(calls) <= 3  # the first histogram serves both sums
