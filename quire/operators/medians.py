"""The upper median: the value at position n / 2 (whole division) of the sorted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name). Equal values are counted before the shuffle, so a large group is as wide as it has different values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    by_value = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_n").over(by_value)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias(name))
