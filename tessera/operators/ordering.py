"""Global row order without one global partition.

Up to ``SMALL`` rows, counted first, are ordered by one window.  More are cut into
ranges of all order keys together at quantiles of a sample, so that few values in
the first key do not matter; positions and running totals are taken inside each
range and offset by the totals of the ranges before, of which there are at most
``RANGES``.  Only rows that are equal in every key share a range of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL, RANGES, SAMPLED = 1 << 20, 4096, 32


def _tuple(values: list[Column], nulls: list[Column]) -> Column:
    """Compares as the keys do in ascending order with nulls last."""
    return F.struct(*[x for i, (v, n) in enumerate(zip(values, nulls, strict=True)) for x in (n.alias(f"n{i}"), v.alias(f"v{i}"))])


def ranged(df: DataFrame, order: list[str], rows: int, small: int = SMALL) -> DataFrame:
    """Rows with ``_range``, which never falls along the order: about ``small`` of the ``rows`` in each.

    The edges are constants of the plan, so that every use of it cuts alike; the sample
    decides on the balance alone.
    """
    ranges = min(RANGES, rows // max(1, small) + 2)
    keys = [F.col(c) for c in order]
    sample = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).sample(min(1.0, SAMPLED * ranges / max(1, rows)), seed=7).limit(2 * SAMPLED * ranges)
    picked = sample.orderBy(*[F.col(c).asc_nulls_last() for c in sample.columns]).collect()
    edges = list(dict.fromkeys(tuple(picked[i * len(picked) // ranges]) for i in range(1, ranges))) if picked else []
    if not edges:
        return df.withColumn("_range", F.lit(0))
    kinds = [f.dataType for f in df.select(*keys).schema]
    edge = F.array(*[_tuple([F.lit(v).cast(kind) for v, kind in zip(e, kinds, strict=True)], [F.lit(v is None) for v in e]) for e in edges])
    own = _tuple(keys, [k.isNull() for k in keys])
    steps = [1 << b for b in reversed(range(len(edges).bit_length()))]

    def climb(at: Column, step: Column) -> Column:
        """How many edges lie below the row, by halving."""
        return F.when((at + step <= len(edges)) & (F.get(edge, at + step - 1) < own), at + step).otherwise(at)

    return df.withColumn("_range", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), climb))


def _before(rows: DataFrame, total: Column) -> DataFrame:
    """The total of all ranges before each; one row a range."""
    sums = rows.groupBy("_range").agg(total.alias("_n"))
    return F.broadcast(sums.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_off")))


def with_row_index(df: DataFrame, order: list[str], name: str = "index", small: int = SMALL) -> DataFrame:
    by = [F.col(c).asc_nulls_last() for c in order]
    n = df.count()
    if n <= small:
        rows, at = df, F.row_number().over(Window.orderBy(*by)) - 1
    else:
        rows = ranged(df, order, n, small)
        at = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1 + F.col("_off")
        rows = rows.join(_before(rows, F.count(F.lit(1))), "_range")
    return rows.withColumn(name, at).select(F.col(name).cast("bigint").alias(name), *df.columns)


def with_group_index(df: DataFrame, keys: list[str], name: str, small: int = SMALL) -> DataFrame:
    """The number, from 0, of each row's keys among the distinct keys in order; only these are numbered, and joined back."""
    groups = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    numbered = with_row_index(groups, groups.columns, "_group", small)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(numbered, same).withColumn(name, F.col("_group").cast("int")).drop(*numbered.columns)


def running_total(df: DataFrame, order: list[str], value: str, name: str = "running", small: int = SMALL) -> DataFrame:
    """Running sum over the whole table in order; null where the value is null."""
    by = [F.col(c).asc_nulls_last() for c in order]
    n = df.count()
    if n <= small:
        rows, total = df, F.sum(value).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    else:
        rows = ranged(df, order, n, small)
        rows = rows.join(_before(rows, F.coalesce(F.sum(value), F.lit(0))), "_range")
        total = F.sum(value).over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_off")
    return rows.withColumn(name, F.when(F.col(value).isNotNull(), total)).select(*df.columns, name)
