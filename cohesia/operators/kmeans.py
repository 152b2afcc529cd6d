"""k-means: deterministic Lloyd rounds, k-means++ starts, and the library's own with several starts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.functions.vectors import sq_dist
from cohesia.operators.attach import attach
from cohesia.operators.frames import KEYS
from cohesia.operators.stats import centroids
from cohesia.session import Scratch

C = F.col


def assign(p: DataFrame, centres: DataFrame, dim: int) -> DataFrame:
    """Each point with the label of its nearest centre (keys, label, mu), the lowest on a tie, and the squared distance d2.

    The centres of a key are one small array, joined to the points; nothing is exploded or shuffled by point.
    """
    lists = centres.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("label", "mu"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(sq_dist(C("x"), c["mu"], dim).alias("d2"), c["label"].alias("label"))))
    return attach(p.select(*KEYS, "row_id", "x"), lists, KEYS, F.size("cs") * (dim + 4)).withColumn("near", near).select(*KEYS, "row_id", "x", C("near.label").cast("int").alias("label"), C("near.d2").alias("d2"))


def first_rows(p: DataFrame, k: int) -> DataFrame:
    """(keys, label, mu): the first k rows by row_id as centres."""
    parts, rest = [], p.select(*KEYS, "row_id", "x")
    for j in range(k):  # k partial minima rather than one ordered window over all rows
        least = rest.groupBy(*KEYS).agg(F.min(F.struct("row_id", "x")).alias("m")).select(*KEYS, C("m.row_id").alias("row_id"), C("m.x").alias("mu"))
        parts.append(least.select(*KEYS, F.lit(j).alias("label"), "mu"))
        rest = rest.join(least.select(*KEYS, C("row_id").alias("used")), KEYS).where("row_id > used").drop("used")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Eighteen digits after the point: sums of them are exact, so they do not depend on the order of the rows.
EXACT = "decimal(38,18)"


def steady_means(p: DataFrame, dim: int) -> DataFrame:
    """(keys, label, mu): means that are the same however the rows are dealt out.

    Sums of doubles differ in their last digits with the order of the rows, and points on a regular grid are often as far from one
    centre as from another: there the last digit decides. Coordinates that the decimals cannot hold have plain means.
    """
    exact = lambda i: F.col("x")[i].try_cast(EXACT)
    held = lambda i: F.count(exact(i)) == F.count(F.col("x")[i])
    mean = lambda i: F.coalesce(F.when(held(i), F.try_sum(exact(i)).cast("double") / F.count(exact(i))), F.avg(F.col("x")[i]))
    return p.groupBy(*KEYS, "label").agg(F.array(*(mean(i) for i in range(dim))).alias("mu"))


def lloyd(p: DataFrame, dim: int, centres: DataFrame, rounds: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """(keys, row_id, x, label, d2) after a fixed number of rounds; an empty cluster's centre becomes the origin."""
    scratch = scratch or Scratch(p.sparkSession)
    names = scratch.keep(centres)
    current = names
    for _ in range(rounds):
        mu = steady_means(assign(p, current, dim), dim)
        zero = F.array(*(F.lit(0.0) for _ in range(dim)))
        current = scratch.keep(names.select(*KEYS, "label").join(mu, [*KEYS, "label"], "left").select(*KEYS, "label", F.coalesce("mu", zero).alias("mu")))
    return assign(p, current, dim)


def plus_plus(p: DataFrame, dim: int, k: int, seed: int = 42) -> DataFrame:
    """k-means++ starts: each drawn in proportion to the squared distance to those before, by a seeded hash of the row."""
    u = lambda j: (F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(j)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scratch = Scratch(p.sparkSession)
    centres = scratch.keep(p.groupBy(*KEYS).agg(F.max_by("x", u(0)).alias("mu")).select(*KEYS, F.lit(0).alias("label"), "mu"))
    for j in range(1, k):
        far = assign(p, centres, dim).where("d2 > 0")
        drawn = far.groupBy(*KEYS).agg(F.max_by("x", F.log(u(j)) / C("d2")).alias("mu")).select(*KEYS, F.lit(j).alias("label"), "mu")
        centres = scratch.keep(centres.unionByName(drawn))
    return centres


def kmeans(p: DataFrame, dim: int, k: int, max_rounds: int = 100, seed: int = 42) -> DataFrame:
    """k-means++ and Lloyd rounds until the error (summed Frobenius norms of the clusters) rises or the centres stay; the best labels."""
    scratch = Scratch(p.sparkSession)
    centres = plus_plus(p, dim, k, seed)
    best, least, before = None, float("inf"), None
    for _ in range(max_rounds):
        now = scratch.keep(assign(p, centres, dim))
        # centres are k rows a key
        mu = centroids(now, dim).select(*KEYS, "label", "mu")
        new = scratch.keep(mu)
        residual = now.drop("d2").join(new, [*KEYS, "label"]).groupBy(*KEYS, "label").agg(F.sqrt(F.sum(sq_dist(C("x"), C("mu"), dim))).alias("e"))
        error = residual.agg(F.sum("e")).first()[0] or 0.0
        if error > least:
            break
        best, least = now, error
        state = sorted((r["dataset"], r["labelset"], r["label"], tuple(r["mu"])) for r in new.collect())
        if state == before:
            break
        before, centres = state, new
    return best.drop("d2")


def ml_kmeans(p: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """The library's k-means over one data set, the best of several starts by cost."""
    vectors = p.select(*KEYS, "row_id", "x", array_to_vector("x").alias("v"))
    fit = lambda s: KMeans(k=k, seed=seed + s, featuresCol="v", predictionCol="label", maxIter=100).fit(vectors)
    with ThreadPoolExecutor(min(starts, 8)) as pool:  # starts are independent of each other
        fits = list(pool.map(fit, range(starts)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).select(*KEYS, "row_id", "x", C("label").cast("int").alias("label"))


def random_centres(p: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(keys, label, mu): k rows drawn by a seeded hash."""
    u = lambda j: F.xxhash64("row_id", F.lit(seed), F.lit(j))
    rows = p.groupBy(*KEYS).agg(*(F.max_by("x", u(j)).alias(f"m{j}") for j in range(k)))
    return rows.select(*KEYS, F.posexplode(F.array(*(f"m{j}" for j in range(k)))).alias("label", "mu"))


def project_2d(p: DataFrame) -> DataFrame:
    """Points of any dimension on their first two principal components."""
    vectors = p.withColumn("v", array_to_vector("x"))
    return PCA(k=2, inputCol="v", outputCol="w").fit(vectors).transform(vectors).select(*KEYS, "row_id", vector_to_array("w").alias("x"), "label")
