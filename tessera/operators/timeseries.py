"""Time windows, gap filling and sessions over integer or timestamp time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate


def ticks(time: str | Column) -> Column:
    return (F.col(time) if isinstance(time, str) else time).cast("bigint")


def hopping(df: DataFrame, time: str, width: int, every: int | None = None, origin: int = 0, name: str = "bucket") -> DataFrame:
    """Rows with the start of each window [s, s + width) that holds them; one row for each window.

    Starts are ``origin`` plus multiples of ``every``.  A tumbling window makes no
    further rows; a hopping one makes about width / every.
    """
    every = every or width
    t = ticks(time) - origin
    last = t - F.pmod(t, F.lit(every))
    if every == width:
        return df.withColumn(name, last + origin)
    first = last - F.lit((width - 1) // every * every)
    first = F.when(first + width > t, first).otherwise(first + every)
    return df.withColumn(name, F.explode(F.sequence(first + origin, last + origin, F.lit(every).cast("bigint"))))


def group_by_dynamic(df: DataFrame, time: str, every: int, period: int, aggs: dict[str, tuple], keys: list[str] | None = None, origin: int = 0) -> DataFrame:
    """Aggregates of windows [s, s + period) every ``every``; ``aggs``: name -> (function, column[, parameter])."""
    rows = hopping(df, time, period, every, origin)
    made = [aggregate(a[0], F.col(a[1]) if a[1] else None, pos=F.col(time), param=a[2] if len(a) > 2 else None).alias(n) for n, a in aggs.items()]
    return rows.groupBy(*(keys or []), "bucket").agg(*made)


def gap_fill(df: DataFrame, partition: list[str], time: str, width: int, values: list[str], mode: str = "none", low: int | None = None, high: int | None = None, most: int = 10_000_000) -> DataFrame:
    """A regular grid for each partition; the first row of each bucket is kept. ``mode``: none, locf or linear.

    More than ``most`` points in one partition are an error.
    """
    rows = df.withColumn("_b", ticks(time) - F.pmod(ticks(time), F.lit(width)))
    first = rows.where(F.col("_b").isNotNull()).groupBy(*partition, "_b").agg(*[F.min_by(F.struct(v), F.col(time))[v].alias(v) for v in values])
    bounds = first.groupBy(*partition).agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    lo = F.lit(low - low % width).cast("bigint") if low is not None else F.col("_lo")
    hi = F.lit(high - high % width).cast("bigint") if high is not None else F.col("_hi")
    many = (hi - lo) / width + 1
    grid = bounds.withColumn("_g", F.explode(F.when(many <= most, F.sequence(lo, hi, F.lit(width).cast("bigint"))).otherwise(F.raise_error(F.lit("gap_fill: too many points")).cast("array<bigint>")))).drop("_lo", "_hi")
    renamed = first.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)], F.col("_b"), *values)
    on = F.col("_g") == F.col("_b")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"_p{i}"))
    full = grid.join(renamed, on, "left")
    w = Window.partitionBy(*partition).orderBy("_g")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = []
    for v in values:
        c = F.col(v)
        if mode == "locf":
            c = F.last(v, True).over(back)
        elif mode == "linear":
            known = F.when(F.col(v).isNotNull(), F.col("_g"))
            a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
            x, y = F.last(v, True).over(back), F.first(v, True).over(ahead)
            c = F.coalesce(F.col(v).cast("double"), x + (y - x) * (F.col("_g") - a) / (b - a))
        out.append(c.alias(v))
    return full.select(*partition, F.col("_g").alias(time), *out)


def sessions(df: DataFrame, partition: list[str], time: str, gap: int, duration: str | None = None, longest: int | None = None, tie: list[str] | None = None, name: str = "session") -> DataFrame:
    """Rows with a 1-based session number: a new one starts when a row begins more than ``gap`` after all before have ended.

    With ``longest``, also when it begins more than that after its session's first
    row; that rule depends on the sessions before it and is a fold over the
    partition's rows in order.
    """
    start = ticks(time)
    end = start + (F.coalesce(F.col(duration), F.lit(0)).cast("bigint") if duration else F.lit(0))
    order = Window.partitionBy(*partition).orderBy(start, *(tie or []))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (start > before + gap)).cast("int")
    if longest is None:
        return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    # Gap sessions bound the fold: ``longest`` only splits them further.
    rough = df.withColumn("_new", fresh).withColumn("_gap", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    grouped = rough.groupBy(*partition, "_gap").agg(F.array_sort(F.collect_list(F.struct(start.alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie or [])], F.struct(*df.columns).alias("row")))).alias("rows"))
    state = F.struct(F.lit(None).cast("bigint").alias("first"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        split = a["first"].isNull() | (x["t"] > a["first"] + longest)
        n = a["n"] + split.cast("int")
        return F.struct(F.when(split, x["t"]).otherwise(a["first"]).alias("first"), n.alias("n"), F.concat(a["out"], F.array(n)).alias("out"))

    folded = grouped.withColumn("_a", F.aggregate("rows", state, step)).withColumn("_many", F.col("_a.n"))
    w = Window.partitionBy(*partition).orderBy("_gap").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("_before", F.coalesce(F.sum("_many").over(w), F.lit(0)))
    return folded.select("_before", F.explode(F.arrays_zip(F.col("rows.row").alias("row"), F.col("_a.out").alias("n"))).alias("x")).select("x.row.*", (F.col("_before") + F.col("x.n")).cast("bigint").alias(name))
