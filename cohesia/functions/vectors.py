"""Distance expressions over array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many dimensions distances are unrolled, so that they stay in generated code.
UNROLL = 128
METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine")


def total(terms: list[Column]) -> Column:
    """A sum as a balanced tree: deep chains of additions overflow the planner's stack."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def sq_dist(a: Column, b: Column, dim: int) -> Column:
    """Squared Euclidean distance of two arrays of dim doubles."""
    if dim <= UNROLL:
        return total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def sq_dist_of_few(a: Column, b: Column) -> Column:
    """Squared Euclidean distance for tables of clusters: compiles at once, whatever the dimension."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dist(a: Column, b: Column, dim: int, metric: str = "euclidean") -> Column:
    """Distance of two arrays by name of the metric."""
    if metric == "euclidean":
        return F.sqrt(sq_dist(a, b, dim))
    if metric == "sqeuclidean":
        return sq_dist(a, b, dim)
    if metric == "cityblock":
        return total([F.abs(a[i] - b[i]) for i in range(dim)])
    if metric == "chebyshev":
        return reduce(F.greatest, [F.abs(a[i] - b[i]) for i in range(dim)], F.lit(0.0))
    if metric == "cosine":
        dot, na, nb = (total([u[i] * v[i] for i in range(dim)]) for u, v in ((a, b), (a, a), (b, b)))
        return 1 - F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))
    raise ValueError(f"Unknown metric: {metric}")


def dimension(points: DataFrame) -> int:
    """Length of the point arrays, from one row."""
    row = points.select(F.size("x").alias("d")).first()
    return row["d"] if row else 0
