"""Concurrency-aware time: how long a group of intervals is busy, how busy, and how deep.

Intervals are half-open, [start, start + duration).  Busy time is the length of
their union: a running maximum of ends over the intervals in order of start finds
what each adds.  Depth is a running sum over endpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(df: DataFrame, start: str, duration: str, low: int | None = None, high: int | None = None, cell: int | None = None) -> DataFrame:
    """Rows with ``_s`` and ``_e`` inside [low, high), snapped outwards to cells."""
    s: Column = F.col(start).cast("bigint")
    e: Column = s + F.coalesce(F.col(duration), F.lit(0)).cast("bigint")
    if cell:
        s, e = s - F.pmod(s, F.lit(cell)), e + F.pmod(-e, F.lit(cell))
    if low is not None:
        s = F.greatest(s, F.lit(low))
    if high is not None:
        e = F.least(e, F.lit(high))
    return df.withColumn("_s", s).withColumn("_e", e).where("_e > _s")


def split_by_bucket(df: DataFrame, width: int, name: str = "bucket") -> DataFrame:
    """Each interval cut at bucket borders: its part in every bucket it meets."""
    first = F.col("_s") - F.pmod(F.col("_s"), F.lit(width))
    last = (F.col("_e") - 1) - F.pmod(F.col("_e") - 1, F.lit(width))
    out = df.withColumn(name, F.explode(F.sequence(first, last, F.lit(width).cast("bigint"))))
    return out.withColumn("_s", F.greatest("_s", name)).withColumn("_e", F.least(F.col("_e"), F.col(name) + width))


def occupancy(df: DataFrame, keys: list[str], start: str, duration: str, bucket: int | None = None, low: int | None = None, high: int | None = None, cell: int | None = None) -> DataFrame:
    """One row per group: busy, total, concurrency (total / busy), utilization (busy / span or bucket) and active (peak depth)."""
    rows = clipped(df, start, duration, low, high, cell)
    groups = list(keys)
    if bucket:
        rows = split_by_bucket(rows, bucket)
        groups.append("bucket")
    order = Window.partitionBy(*groups).orderBy("_s", "_e")
    before = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_add", F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), F.coalesce(before, F.col("_s")))))
    span = F.lit(bucket) if bucket else F.lit(high - low) if low is not None and high is not None else F.max("_e") - F.min("_s")
    busy, total = F.sum("_add"), F.sum(F.col("_e") - F.col("_s"))
    summed = rows.groupBy(*groups).agg(busy.alias("busy"), total.alias("total"), F.try_divide(total.cast("double"), busy.cast("double")).alias("concurrency"), F.try_divide(busy.cast("double"), span.cast("double")).alias("utilization"))
    # Ends come before starts at one time: half-open intervals that touch do not overlap.
    ends = rows.select(*groups, F.explode(F.array(F.struct(F.col("_s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("_e").alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*groups, "x.t", "x.d")
    steps = ends.groupBy(*groups, "t").agg(F.sum("d").alias("d"))
    depth = steps.withColumn("depth", F.sum("d").over(Window.partitionBy(*groups).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    peaks = depth.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.max("depth").alias("active"))
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return summed.join(peaks, on).drop(*[f"_g{i}" for i in range(len(groups))])
