"""Report sinks: the metric x label-set table with arrows and flags, and plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def _number(value: Column, decimals: int) -> Column:
    text = F.format_string(f"%.{decimals}f", F.bround(value, decimals))
    return F.when(value.isNull() | F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(text)


def flags(scores: DataFrame, reference: str = "gt", decimals: int = 3) -> DataFrame:
    """Adds flagged: whether a label set beats the reference one, on rounded values.

    scores: (dataset, metric, higher, labelset, value).
    """
    base = scores.where(C("labelset") == reference).select("dataset", "metric", F.bround("value", decimals).alias("base"))
    mine = F.bround("value", decimals)
    better = F.when(C("higher"), mine > C("base")).otherwise(mine < C("base"))
    return scores.join(base, ["dataset", "metric"], "left").withColumn("flagged", F.coalesce((C("labelset") != reference) & better, F.lit(False))).drop("base")


def score_report(scores: DataFrame, labelsets: list[str], decimals: int = 3) -> DataFrame:
    """One row a metric: its name with an arrow, a cell for each label set (* if it beats the first), and seconds if known."""
    shown = flags(scores, labelsets[0], decimals)
    cell = F.concat(_number(C("value"), decimals), F.when(C("flagged"), "*").otherwise(""))
    name = F.concat("metric", F.when(C("higher"), " (↑)").otherwise(" (↓)"))
    table = shown.withColumn("cell", cell).withColumn("name", name).groupBy("dataset", "name").pivot("labelset", labelsets).agg(F.first("cell"))
    if "seconds" in scores.columns:
        mean = shown.groupBy("dataset", F.concat("metric", F.when(C("higher"), " (↑)").otherwise(" (↓)")).alias("name")).agg(F.concat(_number(F.avg("seconds"), 3), F.lit("s")).alias("time"))
        table = table.join(mean, ["dataset", "name"])
    return table


def plain_report(scores: DataFrame, labelsets: list[str], decimals: int = 3) -> DataFrame:
    """One row a metric with rounded numbers."""
    return scores.withColumn("v", F.bround("value", decimals)).groupBy("dataset", "metric").pivot("labelset", labelsets).agg(F.first("v"))


def write_csv(table: DataFrame, path: str) -> None:
    """A report (a few rows) as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
