"""Linear indices over a stream of labelled points.

Counts, coordinate sums and sums of squares merge, so a running aggregation holds one row a cluster
whatever the length of the stream; indices follow from those rows at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohesia.functions.internal import ratio
from cohesia.functions.vectors import total
from cohesia.operators.frames import KEYS

C = F.col


def running_stats(stream: DataFrame, dim: int) -> DataFrame:
    """(keys, label, n, s, q): counts, coordinate sums and sums of squares. For complete or update output mode."""
    return stream.groupBy(*KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(C("x")[i]) for i in range(dim))).alias("s"), F.sum(total([C("x")[i] * C("x")[i] for i in range(dim)])).alias("q"))


def windowed_stats(stream: DataFrame, dim: int, time: str, window: str, late: str) -> DataFrame:
    """The same by event-time window, with rows later than ``late`` left out by a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *KEYS, "label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(C("x")[i]) for i in range(dim))).alias("s"), F.sum(total([C("x")[i] * C("x")[i] for i in range(dim)])).alias("q"))


def indices(stats: DataFrame, dim: int) -> DataFrame:
    """(keys, sse, ch, wb, bh) from running statistics."""
    norm = total([C("s")[i] * C("s")[i] for i in range(dim)])
    by = stats.select(*KEYS, "n", "s", (C("q") - norm / C("n")).alias("ssw"), (norm / C("n")).alias("m"))
    whole = by.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("ssw").alias("ssw"), F.sum("m").alias("m"), F.array(*(F.sum(C("s")[i]) for i in range(dim))).alias("s"))
    ssb = C("m") - total([C("s")[i] * C("s")[i] for i in range(dim)]) / C("n")
    return whole.withColumn("ssb", ssb).select(*KEYS, C("ssw").alias("sse"), ratio(ratio(C("ssb"), C("k") - 1), ratio(C("ssw"), C("n") - C("k"))).alias("ch"), ratio(C("k") * C("ssw"), C("ssb")).alias("wb"), ratio(C("ssw"), C("k")).alias("bh"))
