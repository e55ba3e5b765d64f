"""Fits of distributions to a column, by group, from moments that one aggregation gives.

Normal, lognormal and exponential parameters come from sums; the best is the one with the smallest Kolmogorov-Smirnov distance over a quantile sketch, so
that no group is ever gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    positive = F.when(v > 0, F.ln(v))
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(positive).alias("log_mean"), F.stddev_pop(positive).alias("log_std")
    )


def _erf(x):
    """The error function to 1.5e-7, as an expression (a published rational approximation)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def _normal(x, mean, std):
    return 0.5 * (1 + _erf((x - mean) / (std * math.sqrt(2))))


def best_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, distribution, distance, mean, std): the closest of normal, lognormal and exponential."""
    from pyspark.sql import Window

    m = moments(df, keys, value)
    counts = sketches.sketch(df, keys, value)
    w = Window.partitionBy(*keys).orderBy("bucket")
    cdf = counts.withColumn("p", F.sum("count").over(w) / F.sum("count").over(Window.partitionBy(*keys))).withColumn("x", sketches.bucket_value(F.col("bucket")))
    both = cdf.join(m.select(*[F.col(k).alias(f"_{k}") for k in keys], "mean", "std", "low", "log_mean", "log_std"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or F.lit(True))
    x = F.col("x")
    models = {
        "normal": _normal(x, F.col("mean"), F.col("std")),
        "lognormal": F.when((x > 0) & (F.col("low") > 0), _normal(F.ln(x), F.col("log_mean"), F.col("log_std"))),
        "exponential": F.when(F.col("low") >= 0, 1 - F.exp(-x / F.col("mean"))),
    }
    far = both.groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("std").alias("std"), *[F.when(F.count(c) == F.count(F.lit(1)), F.max(F.abs(c - F.col("p")))).alias(n) for n, c in models.items()])
    options = F.filter(F.array(*[F.struct(F.col(n).alias("distance"), F.lit(n).alias("distribution")) for n in models]), lambda s: s["distance"].isNotNull())
    best = F.array_min(options)
    return far.select(*keys, best["distribution"].alias("distribution"), best["distance"].alias("distance"), "mean", "std")
