"""Copies of points are compared once."""

import numpy as np

from cohesia.functions import pairwise
from cohesia.operators import pairs


def test_silhouette_compares_copies_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, (200, 2)).astype(float), np.r_[rng.integers(0, 3, 199), 9]
    seen = []
    made = pairs.blocks
    monkeypatch.setattr(pairwise.pp, "blocks", lambda p, *a: seen.append(p.count()) or made(p, *a))
    p = spark.createDataFrame([("d", "gt", i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "dataset string, labelset string, row_id long, x array<double>, label int")
    got = pairwise.silhouette(p, 2).collect()[0]["value"]
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
    for i in range(200):
        mean = {c: d[i, y == c].sum() / max((y == c).sum() - (c == y[i]), 1) for c in set(y)}
        a, b = mean.pop(y[i]), min(v for c, v in mean.items() if c != y[i])
        want.append(0.0 if (y == y[i]).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b))
    assert abs(got - np.mean(want)) < 1e-12
    assert seen == [len({(*r, c) for r, c in zip(x.tolist(), y, strict=True)})]
