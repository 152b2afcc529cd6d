"""Joining points to small tables of their data set or cluster, without shuffling the points where the table is small enough.

The size of such a table (a row a cluster, or a row a data set) is known once it has been aggregated, so it is written
first and measured. Up to ``LIMIT`` bytes it is broadcast; beyond, the join key is salted, so that one data set or cluster
with most of the points is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohesia.session import Scratch

LIMIT = 64 << 20
SALTS = 64


def attach(points: DataFrame, table: DataFrame, on: list[str], doubles: Column | int = 8, how: str = "inner") -> DataFrame:
    """``points`` with the columns of ``table`` (one row for each value of ``on``); doubles: about how many numbers a row of it holds."""
    kept = Scratch(points.sparkSession).keep(table)
    size = kept.agg(F.sum((doubles if isinstance(doubles, Column) else F.lit(doubles)) * 8 + 64)).first()[0] or 0
    if size <= LIMIT:
        return points.join(F.broadcast(kept), on, how)
    salted = points.withColumn("salt_", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    copies = kept.withColumn("salt_", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    return salted.join(copies, [*on, "salt_"], how).drop("salt_")
