"""Point frames: one row for each point and label set.

Columns: ``dataset``, ``labelset`` (strings), ``row_id`` (long, the order of the
points), ``x`` (array of doubles), ``label`` (int). All operators group by dataset
and label set, so one plan scores many of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohesia.operators.attach import attach

KEYS = ["dataset", "labelset"]


def points(df: DataFrame, row_id: Column, x: Column, label: Column, dataset: str = "data", labelset: str = "gt") -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), F.lit(labelset).alias("labelset"), row_id.cast("long").alias("row_id"), x.cast("array<double>").alias("x"), label.cast("int").alias("label"))


def dedup(p: DataFrame) -> DataFrame:
    """Exact duplicate points: the first by row_id stays. A minimum by point is a partial aggregation."""
    first = p.groupBy(*KEYS, "x").agg(F.min(F.struct("row_id", "label")).alias("f"))
    return first.select(*KEYS, F.col("f.row_id").alias("row_id"), "x", F.col("f.label").alias("label"))


def _codes(p: DataFrame, column: str) -> DataFrame:
    """Distinct values with their dense rank by value; only distinct values are ranked."""
    values = p.select(*KEYS, F.col(column).alias("v")).distinct()
    return values.withColumn("code", F.row_number().over(Window.partitionBy(*KEYS).orderBy("v")) - 1)


def reencode(p: DataFrame, column: str = "label") -> DataFrame:
    """Labels become 0 to k - 1 in order of their values (numbers or strings)."""
    codes = _codes(p, column).withColumnRenamed("v", column)
    return attach(p, codes, [*KEYS, column]).select(*(c for c in p.columns if c not in (column, "label")), F.col("code").cast("int").alias("label"))


def _extremes(p: DataFrame, dim: int, keys: list[str]) -> DataFrame:
    return p.groupBy(*keys).agg(F.array(*(F.min(F.col("x")[i]) for i in range(dim))).alias("lo"), F.array(*(F.max(F.col("x")[i]) for i in range(dim))).alias("hi"))


def minmax_scale(p: DataFrame, dim: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Each coordinate to [low, high]; a constant one becomes low."""
    box = _extremes(p, dim, KEYS)
    span = lambda i: F.when(F.col("hi")[i] == F.col("lo")[i], F.lit(1.0)).otherwise(F.col("hi")[i] - F.col("lo")[i])
    scaled = F.array(*((F.col("x")[i] - F.col("lo")[i]) / span(i) * (high - low) + low for i in range(dim)))
    return attach(p, box, KEYS, 2 * dim).select(*KEYS, "row_id", scaled.alias("x"), "label")


def singletons_to_noise(p: DataFrame, noise: int = -1) -> DataFrame:
    """Members of clusters of one point get the noise label."""
    sizes = p.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("size"))
    return attach(p, sizes, [*KEYS, "label"]).select(*KEYS, "row_id", "x", F.when(F.col("size") == 1, noise).otherwise(F.col("label")).cast("int").alias("label"))


def drop_noise(p: DataFrame, noise: int = -1) -> DataFrame:
    return p.where(F.col("label") != noise)


def comb_noise(p: DataFrame, noise: int = -1) -> DataFrame:
    """Noise becomes one more cluster."""
    top = p.groupBy(*KEYS).agg(F.max("label").alias("top"))
    return attach(p, top, KEYS).select(*KEYS, "row_id", "x", F.when(F.col("label") == noise, F.col("top") + 1).otherwise(F.col("label")).cast("int").alias("label"))


def collapse_labels(p: DataFrame, above: int = 3) -> DataFrame:
    """Labels over a bound become the bound."""
    return p.withColumn("label", F.least("label", F.lit(above)))


# Label sets drawn with lines over the bounding box of two-dimensional points.


def bounding_lines(p: DataFrame) -> DataFrame:
    """End points of both diagonals and of the vertical and horizontal middle line: (line, x1, y1, x2, y2)."""
    box = _extremes(p, 2, ["dataset"])
    lo, hi = F.col("lo"), F.col("hi")
    mid = [(lo[i] + hi[i]) / 2 for i in (0, 1)]
    lines = {"dfl": (lo[0], lo[1], hi[0], hi[1]), "dsl": (lo[0], hi[1], hi[0], lo[1]), "vl": (mid[0], lo[1], mid[0], hi[1]), "hl": (lo[0], mid[1], hi[0], mid[1])}
    rows = F.array(*(F.struct(F.lit(k).alias("line"), *(c.alias(n) for c, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True))) for k, v in lines.items()))
    return box.select("dataset", F.explode(rows).alias("l")).select("dataset", "l.*")


def line_side(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 on the labelled side of a line, strictly: left of a vertical, below a horizontal, above a sloped one."""
    slope = (y2 - y1) / (x2 - x1)
    return F.when(x1 == x2, (x < x1).cast("int")).when(y1 == y2, (y < y1).cast("int")).otherwise((y > slope * x + (y1 - slope * x1)).cast("int"))


def plane_side(x: Column, kind: str = "vertical", p: tuple = (0, 0, 0), v1: tuple = (1, 0, 0), v2: tuple = (0, 1, 0)) -> Column:
    """1 on the labelled side of a plane through three-dimensional points."""
    if kind == "vertical":
        return (x[0] < 0).cast("int")
    if kind == "horizontal":
        return (x[2] < 0).cast("int")
    n = (v1[1] * v2[2] - v1[2] * v2[1], v1[2] * v2[0] - v1[0] * v2[2], v1[0] * v2[1] - v1[1] * v2[0])
    return (sum((x[i] - float(p[i])) * float(n[i]) for i in range(3)) > 0).cast("int")


def line_label_sets(p: DataFrame) -> DataFrame:
    """The points once for each of dfl, dsl, vl and hl, labelled by side."""
    lines = bounding_lines(p)
    x = F.col("x")
    side = line_side(x[0], x[1], F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return p.select("dataset", "row_id", "x").join(F.broadcast(lines), "dataset").select("dataset", F.col("line").alias("labelset"), "row_id", "x", side.alias("label"))  # four rows a data set


def midpoint_label_sets(p: DataFrame) -> DataFrame:
    """The points split at the middle of their range: above it in y (hl) and in x (vl)."""
    box = _extremes(p, 2, ["dataset"])
    above = lambda i: (F.col("x")[i] > (F.col("lo")[i] + F.col("hi")[i]) / 2).cast("int")
    both = F.array(F.struct(F.lit("hl").alias("labelset"), above(1).alias("label")), F.struct(F.lit("vl").alias("labelset"), above(0).alias("label")))
    return attach(p.select("dataset", "row_id", "x"), box, ["dataset"]).select("dataset", "row_id", "x", F.explode(both).alias("s")).select("dataset", "s.labelset", "row_id", "x", "s.label")


def random_labels(p: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Labels 0 to k - 1 by a hash of the row and the seed, so that a lost task draws the same again."""
    return p.select("dataset", F.lit("rl").alias("labelset"), "row_id", "x", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(k)).cast("int").alias("label"))


def randomise_minority(p: DataFrame, minority: list[int], k: int, seed: int = 42) -> DataFrame:
    """Labels of the minority clusters are drawn anew."""
    drawn = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(k)).cast("int")
    return p.withColumn("label", F.when(F.col("label").isin(minority), drawn).otherwise(F.col("label")))


def label_sets(p: DataFrame, seed: int = 42) -> DataFrame:
    """gt, the four line sets and the random one, in long form."""
    truth = reencode(p).select("dataset", F.lit("gt").alias("labelset"), "row_id", "x", "label")
    k = truth.agg(F.max("label")).first()[0]
    return truth.unionByName(line_label_sets(p)).unionByName(random_labels(p, (k or 0) + 1, seed))
