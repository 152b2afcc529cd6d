"""Groups that one task was too strict with, or too slow for."""

import numpy as np
from pyspark.sql import functions as F

from cohesia.operators import mst
from cohesia.plans import registry


def test_user_metric_over_200_000_points(spark):
    registry.register("largest_share_", lambda x, labels: float(np.bincount(labels).max()) / len(labels) + x[0, 0])
    p = spark.range(200_003).select(F.lit("d").alias("dataset"), F.lit("gt").alias("labelset"), F.col("id").alias("row_id"), F.array((F.col("id") % 7).cast("double"), F.lit(0.5)).alias("x"), (F.col("id") % 2).cast("int").alias("label"))
    assert registry.metric("largest_share_")[0](p, 2).collect()[0]["value"] == 100_002 / 200_003


def test_tree_of_a_large_group_in_one_task(spark, monkeypatch):
    def never(p):
        raise AssertionError("rounds over all pairs are for more points")

    monkeypatch.setattr(mst, "boruvka", never)
    n = 8_300  # pairs of equal points along a line
    p = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("gt").alias("labelset"), F.col("id").alias("row_id"), F.array(F.floor(F.col("id") / 2).cast("double"), F.lit(0.0)).alias("x"), F.lit(0).alias("label"))
    edges = sorted((r["u"], r["v"], r["w"]) for r in mst.mst_edges(p).collect())
    # of the equal edges between two pairs that of the smaller ids
    assert edges == sorted([(i, i + 1, 0.0) for i in range(0, n, 2)] + [(i, i + 2, 1.0) for i in range(0, n - 2, 2)])
