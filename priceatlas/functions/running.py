"""Running sums over many groups without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_start(counts: DataFrame, keys: list[str], bucket: str, n: str, into: str) -> DataFrame:
    """For each row (keys, bucket), the sum of n over the buckets before it. Two levels, so that no task holds all buckets."""
    coarse = counts.withColumn("__hi", F.floor(F.col(bucket) / 1024))
    inner = Window.partitionBy(*keys, "__hi").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)
    highs = coarse.groupBy(*keys, "__hi").agg(F.sum(n).alias("__sum"))
    highs = highs.select(*keys, "__hi", F.coalesce(F.sum("__sum").over(outer), F.lit(0)).alias("__base"))
    fine = coarse.withColumn("__in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return fine.join(highs, [*keys, "__hi"]).withColumn(into, F.col("__base") + F.col("__in")).drop("__hi", "__base", "__in")
