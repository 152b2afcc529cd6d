"""The minimum covariance determinant against NumPy, its levels, and odd rows."""

import numpy as np
import pytest

from cohesia.llm import quality
from cohesia.session import Scratch

P = len(quality.STATS)


def settle(x, subset):
    """Concentration steps from a subset until it stays: (log determinant, mean, regularised covariance)."""
    h = int(np.ceil(quality.KEEP * len(x)))
    add = np.diag([quality.FLOORS[s] ** 2 for s in quality.STATS])
    for _ in range(100):
        m, c = x[subset].mean(axis=0), np.cov(x[subset].T, bias=True) * quality.CONSISTENT + add
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        new = np.sort(np.argsort(d, kind="stable")[:h])
        if np.array_equal(new, subset):
            break
        subset = new
    return np.linalg.slogdet(c)[1], m, c


def least(x, rng, starts=60):
    return min((settle(x, rng.choice(len(x), 12, replace=False)) for _ in range(starts)), key=lambda f: f[0])


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    out = {}
    for gid, (n, share) in enumerate(((400, 0.15), (900, 0.2), (150, 0.1), (60, 0.0))):
        mix = rng.normal(size=(P, P)) * 0.05 + np.diag([0.2, 0.1, 0.1, 0.05, 0.1])
        x = rng.normal(size=(n, P)) @ mix.T + rng.normal(size=P)
        bad = int(share * n)
        x[:bad] = x.mean(axis=0) + rng.normal(size=P) * 0.1 + np.array([1.5, -1.0, 0.5, 1.0, 0.0]) + rng.normal(size=(bad, P)) * 0.03
        out[gid] = (x, bad)
    return out


def test_determinant_and_distances_as_numpy_finds_them(spark, groups):
    rows = spark.createDataFrame([(g, *map(float, r)) for g, (x, _) in groups.items() for r in x], "gid long, " + ", ".join(f"{s} double" for s in quality.STATS))
    found = {r["gid"]: r for r in quality.robust_estimates(rows, Scratch(spark), True).collect()}
    rng = np.random.default_rng(1)
    for g, (x, bad) in groups.items():
        log_det, m, c = least(x, rng)
        r = found[g]
        assert r["log_det_raw"] <= log_det + 0.1, g
        w = np.array([[r[f"w_{i}_{j}"] if j <= i else 0.0 for j in range(P)] for i in range(P)])
        mine = (((x - np.array([r[f"m_{s}"] for s in quality.STATS])) @ w.T) ** 2).sum(axis=1)
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = x[d <= quality.REWEIGHT]
        add = np.diag([quality.FLOORS[s] ** 2 for s in quality.STATS])
        c = np.cov(near.T, bias=True) * quality.CONSISTENT_ALL + add
        want = np.einsum("ij,jk,ik->i", x - near.mean(axis=0), np.linalg.inv(c), x - near.mean(axis=0))
        assert np.median(np.abs(mine / want - 1)) < 0.05, g
        assert ((mine > quality.CUTOFF) == (want > quality.CUTOFF)).mean() > 0.99
        assert (mine[:bad] > quality.CUTOFF).all()
        plain = np.cov(x.T, bias=True) + add  # what the mean and covariance of all rows would say
        if bad:
            assert (np.einsum("ij,jk,ik->i", x - x.mean(axis=0), np.linalg.inv(plain), x - x.mean(axis=0))[:bad] > quality.CUTOFF).mean() < 0.1


def test_levels_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(300)]
    text = lambda: " ".join(rng.choice(words, 60)) + "."
    rows = [(k, text(), "en", "big") for k in range(60)]
    rows += [(100 + k, text(), "en", f"s{k % 10}") for k in range(40)]
    rows += [(200 + k, text(), lang, "x") for k, lang in enumerate(["fr"] * 14 + ["de"] * 14)]
    rows += [(300 + k, text(), None, "big") for k in range(30)] + [(330 + k, text(), "big", None) for k in range(30)]
    rows += [(400, "#$%& |<>* " * 40 + text(), "en", "big"), (401, None, "en", "big"), (None, "", None, None), (400, text(), "en", "big")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, gid int, `level.x y` int")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    level = lambda ids: {x["level"] for x in got if x["doc_id"] in ids}
    assert level(range(60)) == {0} and level(range(100, 140)) == {1} and level(range(200, 228)) == {2} and level(range(300, 360)) == {0}
    assert sorted(x["kept"] for x in got if x["doc_id"] == 400) == [False, True]
    assert not any(x["kept"] for x in got if x["doc_id"] in (401, None))
    assert sum(x["kept"] for x in got) >= len(rows) - 8
    few = quality.judge(df.where("doc_id < 10")).collect()
    assert len(few) == 10 and all(x["kept"] and x["level"] == 3 for x in few)
    assert quality.judge(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = quality.statistics(spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, lang string, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
