"""Pairs of near copies: each is verified once, shingles of the same sets count as one, parities lose no link."""

import numpy as np
from pyspark.sql import functions as F

from cohesia.llm import near_copies as nc


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 700, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)])
        words = nc.parities(a) ^ nc.parities(b)
        differ = sum(bin(int(w) & (1 << 64) - 1).count("1") for w in words)
        assert differ <= len(np.setxor1d(a, b))
        assert not nc.similar(a, b) or 9 * differ <= len(a) + len(b)


def _families(spark):
    """Forty texts of one passage each in different surroundings, and near copies of ten others."""
    rng = np.random.default_rng(2)
    text = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    passage, rows = text(60), []
    for _ in range(40):
        rows.append(text(30) + passage + text(30))
    for _ in range(10):
        base = text(150)
        rows += [base, [*base[:70], "x", *base[71:]], [*base, "y"]]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")


def test_pairs_are_verified_once(spark, monkeypatch):
    seen, verify = [], nc._Verifier.__call__

    def noted(self, pairs):
        pairs = self.scratch.keep(pairs)
        seen.extend(tuple(sorted(r)) for r in pairs.collect())
        return verify(self, pairs)

    monkeypatch.setattr(nc._Verifier, "__call__", noted)
    monkeypatch.setattr(nc, "shingle_order", lambda texts: np.zeros(1 << nc.BITS, dtype=np.uint64))  # frequent shingles come first as often as rare ones
    kept = sorted(r["doc_id"] for r in nc.keep_one(_families(spark)).collect())
    assert kept == [*range(40), *range(40, 70, 3)]
    assert len(seen) == len(set(seen))
    assert len(seen) < 100  # forty texts of one passage make 780 pairs, which their parities rule out


def test_shingles_of_the_same_sets(spark):
    rows = [(s, rid, p) for s, p in ((11, 0), (12, 1), (13, 4)) for rid in (7, 8)] + [(14, 7, 2), (14, 8, 2), (14, 9, 0)]
    dealt = spark.createDataFrame(rows, "s long, rid long, p int").withColumn("n", F.lit(50))
    counts = dealt.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rid", "n")).alias("pivot"), *nc._members())
    assert sorted((r["s"], r["weight"]) for r in nc._leading(counts).collect()) == [(11, 3), (14, 1)]
