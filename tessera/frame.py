"""An ordered, typed frame: a DataFrame and the columns that give its rows their order.

Row order is meaningful for head, tail, first, shift and the like.  ``order`` names
stable key columns (an event number, a timestamp and a tie-breaker); operations
that do not depend on order never touch it.  Nulls come last in both directions.
Everything is lazy; nothing runs before a terminal method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.functions.aggregates import aggregate
from tessera.operators import joins, ordering, timeseries

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


class Frame:
    def __init__(self, df: DataFrame, order: list[str] | None = None):
        self.df, self.order = df, list(order or [])

    # -- plumbing -----------------------------------------------------------

    def _new(self, df: DataFrame, order: list[str] | None = None) -> Frame:
        keep = self.order if order is None else order
        return Frame(df, [c for c in keep if c in df.columns])

    def _need_order(self) -> list[str]:
        if not self.order:
            raise ValueError("this operation needs the frame's order")
        return self.order

    @property
    def pos(self) -> Column:
        own = self._need_order()
        return F.col(own[0]) if len(own) == 1 else F.struct(*own)

    def _sorted(self, reverse: bool = False) -> DataFrame:
        own = self._need_order()
        return self.df.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in own])

    def numeric(self) -> list[str]:
        return [c for c, t in self.df.dtypes if t.split("(")[0] in NUMERIC]

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # -- rows ---------------------------------------------------------------

    def head(self, n: int = 5) -> Frame:
        return self._new(self._sorted().limit(n))

    def tail(self, n: int = 5) -> Frame:
        return self._new(self._sorted(True).limit(n))

    def slice(self, offset: int, length: int) -> Frame:
        return self._new(self._sorted().offset(offset).limit(length))

    def reverse(self) -> Frame:
        return self._new(self._sorted(True))

    def filter(self, condition: Column | str) -> Frame:
        return self._new(self.df.where(condition))

    def drop_nulls(self, subset: list[str] | None = None) -> Frame:
        """NaN is kept."""
        keep = F.lit(True)
        for c in subset or self.columns:
            keep = keep & F.col(c).isNotNull()
        return self._new(self.df.where(keep))

    def drop_nans(self, subset: list[str] | None = None) -> Frame:
        keep = F.lit(True)
        for c in subset or [c for c, t in self.df.dtypes if t in ("float", "double")]:
            keep = keep & ~F.coalesce(F.isnan(c), F.lit(False))
        return self._new(self.df.where(keep))

    def fill_null(self, value) -> Frame:
        """Columns whose type does not take the value pass through."""
        kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"
        fits = [c for c, t in self.df.dtypes if t == kind or (kind == "number" and t.split("(")[0] in NUMERIC)]
        return self._new(self.df.withColumns({c: F.coalesce(F.col(c), F.lit(value).cast(dict(self.df.dtypes)[c])) for c in fits}))

    def fill_nan(self, value: float) -> Frame:
        return self._new(self.df.withColumns({c: F.nanvl(c, F.lit(value)) for c, t in self.df.dtypes if t in ("float", "double")}))

    def unique(self, subset: list[str] | None = None) -> Frame:
        """The first row of each distinct key (or row)."""
        keys = subset or self.columns
        if not self.order or not subset:
            return self._new(self.df.dropDuplicates(keys))
        rest = [c for c in self.columns if c not in keys]
        if not rest:
            return self._new(self.df.dropDuplicates(keys))
        # A partial minimum instead of a window: no task holds all rows of a key.
        first = self.df.groupBy(*keys).agg(F.min_by(F.struct(*rest), self.pos).alias("_r"))
        return self._new(first.select(*keys, "_r.*").select(*self.columns))

    unique_by = drop_duplicates = unique

    def head_by(self, keys: list[str], n: int) -> Frame:
        w = Window.partitionBy(*keys).orderBy(*self._need_order())
        return self._new(self.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))

    def is_duplicated(self, name: str = "is_duplicated") -> Frame:
        return self._marked(name, lambda n: n > 1)

    def is_unique(self, name: str = "is_unique") -> Frame:
        return self._marked(name, lambda n: n == 1)

    def _marked(self, name: str, test: Callable[[Column], Column]) -> Frame:
        return self._new(self.df.withColumn(name, test(F.count(F.lit(1)).over(Window.partitionBy(*self.columns)))))

    def sample(self, n: int, seed: int = 0) -> Frame:
        """The same n rows for a seed: those with the smallest hash of order and seed."""
        return self._new(self.df.orderBy(F.xxhash64(*self._need_order(), F.lit(seed)), *self.order).limit(n))

    def take(self, index: list[int]) -> Frame:
        """Rows by place; a negative index gives a row of nulls."""
        spark = self.df.sparkSession
        wanted = spark.createDataFrame([(i, v) for i, v in enumerate(index)], "_at int, _want bigint")
        rows = ordering.with_row_index(self.df, self._need_order(), "_row")
        return Frame(F.broadcast(wanted).join(rows, F.col("_want") == F.col("_row"), "left").select("_at", *self.columns), ["_at"])

    def gather_every(self, n: int, offset: int = 0) -> Frame:
        rows = ordering.with_row_index(self.df, self._need_order(), "_row")
        return self._new(rows.where(F.pmod(F.col("_row") - offset, F.lit(n)) == 0).where(F.col("_row") >= offset).drop("_row"))

    def topk(self, key: str, k: int, largest: bool = True) -> Frame:
        own = F.col(key).desc_nulls_last() if largest else F.col(key).asc_nulls_last()
        return self._new(self.df.orderBy(own, *self.order).limit(k))

    def sort_by(self, keys: str | list[str], descending: bool | list[bool] = False) -> Frame:
        keys = [keys] if isinstance(keys, str) else keys
        flags = [descending] * len(keys) if isinstance(descending, bool) else descending
        return self._new(self.df.orderBy(*[F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_last() for k, d in zip(keys, flags, strict=True)], *[c for c in self.order if c not in keys]))

    sort_by_multi = sort_by_multi_per_col = sort_by

    # -- columns ------------------------------------------------------------

    def select(self, *columns) -> Frame:
        return self._new(self.df.select(*columns))

    def with_column(self, name: str, value: Column) -> Frame:
        return self._new(self.df.withColumn(name, value))

    def drop(self, *names: str) -> Frame:
        return self._new(self.df.drop(*names))

    def rename(self, names: list[str] | dict[str, str]) -> Frame:
        pairs = names if isinstance(names, dict) else dict(zip(self.columns, names, strict=True))
        return Frame(self.df.withColumnsRenamed(pairs), [pairs.get(c, c) for c in self.order])

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename({c: prefix + c for c in self.columns})

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename({c: c + suffix for c in self.columns})

    def with_row_index(self, name: str = "index") -> Frame:
        return self._new(ordering.with_row_index(self.df, self._need_order(), name))

    def column_op(self, fn: Callable[[Column], Column], column: str, into: str | None = None) -> Frame:
        return self._new(self.df.withColumn(into or column, fn(F.col(column))))

    def select_dtypes(self, include: Iterable[str]) -> Frame:
        return self._new(self.df.select([c for c, t in self.df.dtypes if t.split("(")[0].split("<")[0] in set(include)]))

    def to_dummies(self, column: str, values: list | None = None) -> Frame:
        """A 0/1 column for each distinct value, in order, in place of the column."""
        if values is None:
            values = [r[0] for r in self.df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1025).collect()]
            if len(values) > 1024:
                raise ValueError(f"more than 1024 distinct values in {column}")
        made = [(F.coalesce(F.col(column) == v, F.lit(False))).cast("tinyint").alias(f"{column}_{v}") for v in values]
        at = self.columns.index(column)
        return self._new(self.df.select(*self.columns[:at], *made, *self.columns[at + 1 :]))

    def horizontal(self, how: str, columns: list[str] | None = None, name: str | None = None) -> Frame:
        """Across the columns of a row, nulls skipped: sum, mean, min or max."""
        cols = [F.col(c).cast("double") for c in columns or self.numeric()]
        known = F.filter(F.array(*cols), lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
        made = {"sum": total, "mean": F.try_divide(total, F.size(known).cast("double")), "min": F.array_min(known), "max": F.array_max(known)}[how]
        return self._new(self.df.withColumn(name or how, made))

    # -- reshaping ----------------------------------------------------------

    def explode(self, column: str) -> Frame:
        """Empty and null lists give one row with null."""
        at = self.columns.index(column)
        return self._new(self.df.select(*self.columns[:at], F.explode_outer(column).alias(column), *self.columns[at + 1 :]))

    def unnest(self, column: str, keep_empty: bool = True) -> Frame:
        inner = F.explode_outer(column) if keep_empty else F.explode(column)
        return self._new(self.df.withColumn("_e", inner).drop(column).select(*[c for c in self.columns if c != column], "_e.*"))

    def unpivot(self, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> Frame:
        return self._new(self.df.unpivot(ids, values, variable, value))

    melt = unpivot

    def pivot(self, index: list[str], on: str, values: str, agg: str = "first", labels: list | None = None) -> Frame:
        """Null keys are dropped; labels ascend."""
        rows = self.df.where(F.col(on).isNotNull())
        for k in index:
            rows = rows.where(F.col(k).isNotNull())
        if labels is None:
            labels = [r[0] for r in rows.select(on).distinct().orderBy(on).limit(1025).collect()]
            if len(labels) > 1024:
                raise ValueError(f"more than 1024 distinct values in {on}")
        pos = self.pos if self.order else None
        return self._new(rows.groupBy(*index).pivot(on, labels).agg(aggregate(agg, F.col(values), pos=pos)), index)

    def concat(self, other: Frame, how: str = "vertical") -> Frame:
        return self._new(self.df.unionByName(other.df, allowMissingColumns=how == "diagonal"))

    def union(self, other: Frame) -> Frame:
        return self._new(self.df.unionByName(other.df).distinct())

    def intersect(self, other: Frame) -> Frame:
        return self._new(self.df.intersect(other.df))

    def subtract(self, other: Frame) -> Frame:
        return self._new(self.df.subtract(other.df))

    # -- aggregation --------------------------------------------------------

    def group_by(self, keys: list[str], aggs: dict[str, tuple], dropna: bool = False) -> Frame:
        """``aggs``: name -> (function, column[, by[, parameter]]). A null key is a group of its own unless ``dropna``."""
        rows = self.df
        if dropna:
            for k in keys:
                rows = rows.where(F.col(k).isNotNull())
        pos = self.pos if self.order else None
        made = [aggregate(a[0], F.col(a[1]) if a[1] else None, F.col(a[2]) if len(a) > 2 and a[2] else None, pos, a[3] if len(a) > 3 else None).alias(n) for n, a in aggs.items()]
        return Frame(rows.groupBy(*keys).agg(*made) if keys else rows.agg(*made), keys)

    def reduce(self, agg: str) -> Frame:
        pos = self.pos if self.order else None
        cols = self.columns if agg in ("first", "last", "count_valid", "min", "max") else self.numeric()
        return Frame(self.df.agg(*[aggregate(agg, F.col(c), pos=pos).alias(c) for c in cols]))

    def describe(self) -> Frame:
        """Rows count, null_count, mean, std, min and max; a column for each numeric one; one pass over the data."""
        cols = self.numeric()
        stats = {"count": lambda c: F.count(c), "null_count": lambda c: F.count_if(F.col(c).isNull()), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        one = self.df.agg(*[f(c).cast("double").alias(f"{s}_{i}") for s, f in stats.items() for i, c in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(s).alias("statistic"), *[F.col(f"{s}_{i}").alias(c) for i, c in enumerate(cols)]) for s in stats])
        return Frame(one.select(F.explode(rows).alias("r")).select("r.*"))

    def null_count(self) -> Frame:
        return Frame(self.df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.columns]))

    def value_counts(self, column: str) -> Frame:
        out = self.df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        return Frame(out.orderBy(F.desc("count"), "value"))

    def n_unique(self, subset: list[str] | None = None) -> int:
        return self.df.select(*(subset or self.columns)).distinct().count()

    def corr(self, method: str = "corr") -> Frame:
        """The matrix of pairwise correlations (or ``covar_samp``), in one pass."""
        cols = self.numeric()
        f = {"corr": F.corr, "covar_samp": F.covar_samp}[method]
        one = self.df.agg(*[f(a, b).alias(f"_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(a).alias("column"), *[F.col(f"_{i}_{j}").alias(b) for j, b in enumerate(cols)]) for i, a in enumerate(cols)])
        return Frame(one.select(F.explode(rows).alias("r")).select("r.*"))

    def group_by_dynamic(self, time: str, every: int, period: int, aggs: dict[str, tuple], keys: list[str] | None = None, origin: int = 0) -> Frame:
        return Frame(timeseries.group_by_dynamic(self.df, time, every, period, aggs, keys, origin), [*(keys or []), "bucket"])

    resample = group_by_dynamic

    def compare_agg(self, other: Frame, keys: list[str]) -> Frame:
        return Frame(joins.compare(self.df, other.df, keys), keys)

    # -- windows ------------------------------------------------------------

    def window(self, partition: list[str], order: list[str], columns: dict[str, tuple]) -> Frame:
        """``columns``: name -> (function, column or None, options)."""
        w = W.spec(partition, [F.col(c).asc_nulls_last() if not c.startswith("-") else F.col(c[1:]).desc_nulls_last() for c in order])
        made = {}
        for name, (fn, column, *rest) in columns.items():
            options = {k: F.col(v) if k in ("by", "time", "pos") else v for k, v in (rest[0] if rest else {}).items()}
            made[name] = W.WINDOWS[fn](w, F.col(column), **options) if column else W.WINDOWS[fn](w, **options)
        return self._new(self.df.withColumns(made))

    def group_transform(self, keys: list[str], op: str, column: str, into: str | None = None, **options) -> Frame:
        if op == "n_group":
            return self._new(ordering.with_group_index(self.df, keys, into or f"{op}_{column}"))
        return self._new(self.df.withColumn(into or f"{op}_{column}", W.TRANSFORMS[op](keys, F.col(column), self.pos, **options)))

    def cumsum(self, column: str, into: str = "cumsum") -> Frame:
        """Over the whole frame, without one global partition."""
        return self._new(ordering.running_total(self.df, self._need_order(), column, into))

    def gap_fill(self, partition: list[str], time: str, width: int, values: list[str], mode: str = "none", low: int | None = None, high: int | None = None) -> Frame:
        return Frame(timeseries.gap_fill(self.df, partition, time, width, values, mode, low, high), [*partition, time])

    def sessions(self, partition: list[str], time: str, gap: int, **options) -> Frame:
        return self._new(timeseries.sessions(self.df, partition, time, gap, tie=self.order, **options))

    # -- joins --------------------------------------------------------------

    def join(self, other: Frame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_right", nulls_equal: bool = False) -> Frame:
        return self._new(joins.join(self.df, other.df, left_on, right_on, how, suffix, nulls_equal))

    def asof(self, other: Frame, on: str, by: list[str] | None = None, direction: str = "backward", tolerance: float | None = None, right_on: str | None = None) -> Frame:
        return self._new(joins.asof(self.df, other.df, on, by, direction, tolerance, right_on, other.order))

    join_asof = asof

    def interval(self, other: Frame, point: str, low: str, high: str, by: list[str] | None = None, outer: bool = False) -> Frame:
        return self._new(joins.interval(self.df, other.df, point, low, high, by, outer))

    def combine_first(self, other: Frame, keys: list[str]) -> Frame:
        both = joins.join(self.df, other.df, keys, how="outer", suffix="_other")
        out = [F.coalesce(F.col(c), F.col(f"{c}_other")).alias(c) if f"{c}_other" in both.columns else F.col(c) for c in self.columns]
        return self._new(both.select(*out))

    # -- distribution -------------------------------------------------------

    def partition_id(self, keys: list[str], n: int, name: str = "partition_id") -> Frame:
        return self._new(self.df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(n))))

    def hash_partition(self, keys: list[str], n: int) -> Frame:
        return self._new(self.df.repartition(n, *keys))

    def map_batches(self, fn: Callable, schema: str) -> Frame:
        return Frame(self.df.mapInArrow(fn, schema))

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    def memory_budget(self, _bytes: int) -> Frame:
        """Spark spills under its own unified memory; kept so that plans can be carried over."""
        return self

    def auto_spill(self) -> Frame:
        return self

    # -- terminals ----------------------------------------------------------

    def collect(self) -> list:
        return (self._sorted() if self.order else self.df).collect()

    def stream(self):
        return (self._sorted() if self.order else self.df).toLocalIterator()

    def schema(self):
        return self.df.schema

    def explain(self) -> None:
        self.df.explain("formatted")

    def to_arrow(self):
        return self.df.toArrow()

    def to_pandas(self):
        return self.df.toPandas()
