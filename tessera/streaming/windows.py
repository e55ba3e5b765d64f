"""Structured Streaming forms of the time-window operators.

An extension beyond batch semantics: rows later than the watermark are dropped,
and a window is final once the watermark has passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tail(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files as they arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def bucketed(stream: DataFrame, time: str, width: str, every: str | None = None, keys: list[str] | None = None, late: str = "0 seconds", **aggs) -> DataFrame:
    """Tumbling or hopping windows; ``aggs``: name=Column."""
    window = F.window(time, width, every) if every else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(window, *(keys or [])).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("window.start").alias("bucket"), *(keys or []), *aggs)


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str = "0 seconds", **aggs) -> DataFrame:
    """Sessions that end after a gap; one row for each when it has ended."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggs)


def distinct(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's delay; state is dropped after it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def busy(stream: DataFrame, time: str, duration_us: str, width: str, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """Busy time of each window: the union of its rows' intervals, clipped to it, as a fold over the sorted intervals of a window."""
    spans = F.array_sort(F.collect_list(F.struct(F.unix_micros(time).alias("s"), (F.unix_micros(time) + F.col(duration_us)).alias("e"))))
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(spans.alias("spans"))
    zero = F.struct(F.lit(-(1 << 62)).alias("far"), F.lit(0).cast("bigint").alias("sum"))
    end = F.unix_micros("window.end")

    def step(a, x):
        stop = F.least(x["e"], end)
        return F.struct(F.greatest(a["far"], stop).alias("far"), (a["sum"] + F.greatest(F.lit(0).cast("bigint"), stop - F.greatest(x["s"], a["far"]))).alias("sum"))

    return rows.select(F.col("window.start").alias("bucket"), *keys, F.aggregate("spans", zero, step, lambda a: a["sum"]).alias("busy"))


def run_once(result: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """All that is there now, into an in-memory table; for tests and small reports."""
    writer = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
