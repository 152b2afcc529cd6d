"""Lloyd rounds do not depend on how the rows are dealt out, ties included."""

from pyspark.sql import functions as F

from cohesia.operators import kmeans


def _grid(spark):
    """All 50 x 1000 points of a grid; its second round leaves a thousand points as far from one centre as from another."""
    scaled = F.array((F.floor(F.col("id") / 1000) / 49 * 2 - 1), ((F.col("id") % 1000) / 999 * 2 - 1))
    return spark.range(50_000).select(F.lit("d").alias("dataset"), F.lit("gt").alias("labelset"), F.col("id").alias("row_id"), scaled.alias("x"), F.lit(0).alias("label"))


def test_means_whatever_the_order(spark):
    p = _grid(spark).withColumn("x", F.transform("x", lambda v: v / 3))
    first = kmeans.steady_means(p, 2).collect()
    for order, parts in ((F.xxhash64("row_id"), 3), (-F.col("row_id"), 7), (F.col("x")[1], 1)):
        assert kmeans.steady_means(p.repartition(parts, "row_id").sortWithinPartitions(order), 2).collect() == first


def test_labels_whatever_the_order(spark):
    p = _grid(spark)
    starts = [(s - 1) * 1000 + i for i, s in enumerate((44, 49, 8, 29))]
    centres = p.where(F.col("row_id").isin(starts)).select("dataset", "labelset", (F.col("row_id") % 1000).cast("int").alias("label"), F.col("x").alias("mu"))
    runs = []
    for order, parts in ((F.col("row_id"), 1), (F.xxhash64("row_id"), 3), (-F.col("row_id"), 5), (F.col("x")[1], 8)):
        q = p.repartition(parts, "row_id").sortWithinPartitions(order)
        runs.append(sorted((r["row_id"], r["label"]) for r in kmeans.lloyd(q, 2, centres, 3).select("row_id", "label").collect()))
    assert all(r == runs[0] for r in runs)


def test_numbers_that_decimals_cannot_hold(spark):
    p = spark.createDataFrame([("d", "gt", 0, [1e300, 2.0], 1), ("d", "gt", 1, [3e300, 4.0], 1), ("d", "gt", 2, [float("inf"), 5.0], 2)], "dataset string, labelset string, row_id long, x array<double>, label int")
    assert {r["label"]: r["mu"] for r in kmeans.steady_means(p, 2).collect()} == {1: [2e300, 3.0], 2: [float("inf"), 5.0]}
