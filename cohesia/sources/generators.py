"""Seeded point generators. Every value is a function of the row number and the seed, so a lost task makes the same rows again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def _uniform(seed: int, k: int) -> Column:
    return (F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, k: int) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(-2 * F.log(_uniform(seed, 2 * k + 1000))) * F.cos(2 * math.pi * _uniform(seed, 2 * k + 1001))


def _frame(rows: DataFrame, x: Column, label: Column, dataset: str) -> DataFrame:
    return rows.select(F.lit(dataset).alias("dataset"), F.lit("gt").alias("labelset"), "row_id", x.alias("x"), label.cast("int").alias("label"))


def blobs(spark: SparkSession, centers: Sequence[Sequence[float]], sizes: Sequence[int], std: float | Sequence[float] = 1.0, seed: int = 42, dataset: str = "blobs") -> DataFrame:
    """Gaussian clusters of given sizes; std is one or one for each."""
    stds = [std] * len(sizes) if isinstance(std, int | float) else list(std)
    dim = len(centers[0])
    rows = spark.range(sum(sizes)).withColumnRenamed("id", "row_id")
    label, edge = F.lit(len(sizes) - 1), 0
    case = None
    for k, n in enumerate(sizes):
        edge += n
        case = F.when(C("row_id") < edge, k) if case is None else case.when(C("row_id") < edge, k)
    label = case if case is not None else label
    at = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (C("label") + 1).cast("int"))
    marked = rows.withColumn("label", label)
    x = F.array(*(at([c[i] for c in centers]) + at(stds) * _normal(seed, i) for i in range(dim)))
    return _frame(marked, x, C("label"), dataset)


def analysis_clusters(spark: SparkSession, centers: Sequence[Sequence[float]], sizes: Sequence[int], std: float = 1.0, seed: int = 42) -> DataFrame:
    return blobs(spark, centers, sizes, std, seed, "analysis")


def data1(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Three Gaussians."""
    return blobs(spark, [(0, 0), (5, 5), (10, 0)], [n // 3, n // 3, n - 2 * (n // 3)], 1.0, seed, "data1")


def data2(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Five Gaussians."""
    return blobs(spark, [(0, 0), (4, 4), (8, 0), (4, -4), (4, 0)], [n // 5] * 4 + [n - 4 * (n // 5)], 0.8, seed, "data2")


def data3(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Plain blobs."""
    return blobs(spark, [(-6, -6), (0, 6), (6, -2)], [n // 3, n // 3, n - 2 * (n // 3)], 1.0, seed, "data3")


def data4(spark: SparkSession, n: int = 1000, seed: int = 170) -> DataFrame:
    """Blobs stretched by [[0.6, -0.6], [-0.4, 0.8]]."""
    x = C("x")
    return data3(spark, n, seed).select(F.lit("data4").alias("dataset"), "labelset", "row_id", F.array(x[0] * 0.6 - x[1] * 0.4, x[0] * -0.6 + x[1] * 0.8).alias("x"), "label")


def data5(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Blobs of different widths."""
    return blobs(spark, [(-6, -6), (0, 6), (6, -2)], [n // 3, n // 3, n - 2 * (n // 3)], [1.0, 2.5, 0.5], seed, "data5")


def data6(spark: SparkSession, n: int = 1000, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """Two interleaved half circles."""
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumn("label", (C("row_id") >= n // 2).cast("int"))
    t = math.pi * _uniform(seed, 0)
    x = F.when(C("label") == 0, F.cos(t)).otherwise(1 - F.cos(t)) + noise * _normal(seed, 0)
    y = F.when(C("label") == 0, F.sin(t)).otherwise(0.5 - F.sin(t)) + noise * _normal(seed, 1)
    return _frame(rows, F.array(x, y), C("label"), "data6")


def data7(spark: SparkSession, n: int = 1000, seed: int = 42, factor: float = 0.5, noise: float = 0.05) -> DataFrame:
    """Two concentric circles."""
    rows = spark.range(n).withColumnRenamed("id", "row_id").withColumn("label", (C("row_id") >= n // 2).cast("int"))
    r, t = F.when(C("label") == 0, 1.0).otherwise(factor), 2 * math.pi * _uniform(seed, 0)
    return _frame(rows, F.array(r * F.cos(t) + noise * _normal(seed, 0), r * F.sin(t) + noise * _normal(seed, 1)), C("label"), "data7")


def multivariate(spark: SparkSession, stats: Sequence[tuple[int, Sequence[float], Sequence[float]]], minority: Sequence[int] = (), scale: float = 1.0, seed: int = 42, dataset: str = "unbalance") -> DataFrame:
    """Plane clusters from (n, mean, (var x, covar, var y)); the sizes of minority clusters are multiplied by scale."""
    sizes = [int(n * scale) if k in set(minority) else n for k, (n, _, _) in enumerate(stats)]
    rows = blobs(spark, [(0.0, 0.0)] * len(sizes), sizes, 1.0, seed, dataset)
    at = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (C("label") + 1).cast("int"))
    factor = []
    for _, _, (vx, cxy, vy) in stats:
        a = math.sqrt(vx)
        b = cxy / a if a else 0.0
        factor.append((a, b, math.sqrt(max(vy - b * b, 0.0))))
    z = C("x")
    x = F.array(at([m[0] for _, m, _ in stats]) + at([f[0] for f in factor]) * z[0], at([m[1] for _, m, _ in stats]) + at([f[1] for f in factor]) * z[0] + at([f[2] for f in factor]) * z[1])
    return rows.select("dataset", "labelset", "row_id", x.alias("x"), "label")


GENERATORS = {f"data{i}": f for i, f in enumerate((data1, data2, data3, data4, data5, data6, data7), 1)}
