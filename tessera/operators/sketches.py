"""Mergeable quantile sketches with relative error, as plain aggregations.

A value's bucket is the ceiling of its logarithm to a base near one; counts per
bucket are the sketch, so building is a ``groupBy`` and merging is a sum.  A
quantile is read from the running count.  With ``accuracy`` a the base is
(1 + a) / (1 - a), and a value read back is off by a factor of at most 1 + a.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base(accuracy: float = 0.01) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket_key(v: Column, accuracy: float = 0.01) -> Column:
    """Signed: positive values above the middle, zero in it, negative below."""
    size = F.ceil(F.ln(F.abs(v)) / math.log(base(accuracy))).cast("int") + 1_000_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.when(v.isNotNull(), 0))


def bucket_value(key: Column, accuracy: float = 0.01) -> Column:
    g = base(accuracy)
    middle = F.pow(F.lit(g), F.abs(key) - 1_000_000) * 2 / (g + 1)
    return F.when(key > 0, middle).when(key < 0, -middle).otherwise(F.lit(0.0))


def sketch(df: DataFrame, keys: list[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """Rows (keys, bucket, count)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket_key(F.col(value).cast("double"), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("count").alias("count"))


def quantile(sketches: DataFrame, keys: list[str], q: float, accuracy: float = 0.01) -> DataFrame:
    """Rows (keys, quantile)."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    total = F.sum("count").over(Window.partitionBy(*keys))
    at = sketches.withColumn("_n", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_want", F.floor(F.lit(q) * (total - 1)) + 1)
    return at.where("_n >= _want").groupBy(*keys).agg(bucket_value(F.min("bucket"), accuracy).alias("quantile"))


def histogram(sketches: DataFrame, keys: list[str], accuracy: float = 0.01) -> DataFrame:
    """Rows (keys, buckets): an ordered list of (lo, hi, count)."""
    g = base(accuracy)
    high = F.pow(F.lit(g), F.abs("bucket") - 1_000_000)
    lo = F.when(F.col("bucket") > 0, high / g).when(F.col("bucket") < 0, -high).otherwise(F.lit(0.0))
    hi = F.when(F.col("bucket") > 0, high).when(F.col("bucket") < 0, -high / g).otherwise(F.lit(0.0))
    return sketches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi"), F.col("count")))).alias("buckets"))
