"""Column-wise spellings of a frame: arithmetic, comparison, running and rolling forms over all numeric columns at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.functions import scalar as S
from tessera.functions.aggregates import AGGREGATES, aggregate
from tessera.functions.windows import TRANSFORMS, running
from tessera.operators import ordering

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": S.add, "sub": S.sub, "mul": S.mul, "div": S.div, "floordiv": S.floordiv, "mod": S.mod, "pow": S.power,
    "radd": lambda a, b: S.add(b, a), "rsub": lambda a, b: S.sub(b, a), "rmul": lambda a, b: S.mul(b, a), "rdiv": lambda a, b: S.div(b, a), "rfloordiv": lambda a, b: S.floordiv(b, a), "rmod": lambda a, b: S.mod(b, a), "rpow": lambda a, b: S.power(b, a),
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}


class Columns:
    """All numeric columns of a frame (those that give the order and the keys stay as they are)."""

    def __init__(self, frame: Frame, keys: list[str] | None = None):
        self.frame, self.keys = frame, keys or []
        self.names = [c for c in frame.numeric() if c not in {*frame.order, *self.keys}]

    def map(self, fn: Callable[[Column], Column]) -> Frame:
        return self.frame._new(self.frame.df.withColumns({c: fn(F.col(c)) for c in self.names}))

    def binary(self, op: str, other) -> Frame:
        return self.map(lambda c: _BINARY[op](c, S.lit(other)))

    def abs(self) -> Frame:
        return self.map(F.abs)

    def round(self, digits: int = 0) -> Frame:
        """Half to even."""
        return self.map(lambda c: F.bround(c, digits))

    def clip(self, low, high) -> Frame:
        return self.map(lambda c: S.clip(c, low, high))

    def isna(self) -> Frame:
        return self.map(lambda c: c.isNull())

    def notna(self) -> Frame:
        return self.map(lambda c: c.isNotNull())

    def where(self, condition: Callable[[Column], Column], other=None) -> Frame:
        return self.map(lambda c: F.when(condition(c), c).otherwise(S.lit(other)))

    def mask(self, condition: Callable[[Column], Column], other=None) -> Frame:
        return self.map(lambda c: F.when(~condition(c), c).otherwise(S.lit(other)))

    def replace(self, old, new) -> Frame:
        return self.map(lambda c: F.when(c == old, S.lit(new)).otherwise(c))

    def isin(self, values: list) -> Frame:
        return self.map(lambda c: c.isin(*values))

    def transform(self, op: str, **options) -> Frame:
        """A group-wise transform (``cum_sum``, ``shift``, ``diff``, ``pct_change``, ``rank``, ``ffill``, ``rolling_mean``, ``ewm_mean``, ...)."""
        if op == "n_group":
            rows = ordering.with_group_index(self.frame.df, self.keys, "_n")
            return self.frame._new(rows.withColumns({c: F.col("_n") for c in self.names}).drop("_n"))
        return self.map(lambda c: TRANSFORMS[op](self.keys, c, self.frame.pos, **options))

    def rolling(self, n: int, agg: str, min_count: int | None = None, **options) -> Frame:
        w = Window.partitionBy(*self.keys).orderBy(self.frame.pos).rowsBetween(-(n - 1), 0)
        return self.map(lambda c: F.when(F.count(c).over(w) >= (min_count or n), AGGREGATES[agg](c, **options).over(w)))

    def expanding(self, agg: str, min_count: int = 1, **options) -> Frame:
        w = running(Window.partitionBy(*self.keys).orderBy(self.frame.pos))
        return self.map(lambda c: F.when(F.count(c).over(w) >= min_count, AGGREGATES[agg](c, **options).over(w)))

    def agg(self, name: str, **options) -> Frame:
        pos = self.frame.pos if self.frame.order else None
        made = [aggregate(name, F.col(c), pos=pos, **options).alias(c) for c in self.names]
        rows = self.frame.df
        for k in self.keys:  # null keys make no group here
            rows = rows.where(F.col(k).isNotNull())
        return Frame(rows.groupBy(*self.keys).agg(*made) if self.keys else rows.agg(*made), self.keys)

    def idxmax(self, index: str) -> Frame:
        return Frame(self.frame.df.groupBy(*self.keys).agg(*[F.max_by(F.col(index), F.struct(F.col(c), -F.col(index))).alias(c) for c in self.names]), self.keys)

    def idxmin(self, index: str) -> Frame:
        return Frame(self.frame.df.groupBy(*self.keys).agg(*[F.min_by(F.col(index), F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col(index)))).alias(c) for c in self.names]), self.keys)

    def corrwith(self, other: str) -> Frame:
        return Frame(self.frame.df.agg(*[F.corr(c, other).alias(c) for c in self.names if c != other]))

    def describe(self) -> Frame:
        return self.frame.select(*self.names).describe()


class Grouped:
    """A frame by keys, as a whole: sizes, filters and functions of groups."""

    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys
        self.columns = Columns(frame, keys)

    def size(self) -> Frame:
        return self.frame.group_by(self.keys, {"size": ("count", None)}, dropna=True)

    def ngroups(self) -> int:
        return self.size().df.count()

    def get_group(self, *key) -> Frame:
        keep = F.lit(True)
        for k, v in zip(self.keys, key, strict=True):
            keep = keep & (F.col(k) == v)
        return self.frame.filter(keep)

    def filter(self, test: Callable[[], Column]) -> Frame:
        """Rows of the groups for which an aggregate expression is true."""
        good = self.frame.df.groupBy(*self.keys).agg(test().alias("_good")).where("_good").drop("_good")
        return self.frame._new(self.frame.df.join(good, self.keys, "left_semi"))

    def transform(self, agg: str) -> Frame:
        """Each row with its group's aggregate in place of the value."""
        w = Window.partitionBy(*self.keys)
        return self.frame._new(self.frame.df.withColumns({c: AGGREGATES[agg](F.col(c)).over(w) for c in self.columns.names}))

    def apply(self, fn: Callable, schema: str) -> Frame:
        """A function of a whole group as an Arrow table or pandas frame; a group must fit in a task's memory."""
        return Frame(self.frame.df.groupBy(*self.keys).applyInPandas(fn, schema), self.keys)

    def sample(self, n: int, seed: int = 0) -> Frame:
        w = Window.partitionBy(*self.keys).orderBy(F.xxhash64(*self.frame._need_order(), F.lit(seed)), *self.frame.order)
        return self.frame._new(self.frame.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))

    def value_counts(self, column: str) -> Frame:
        return self.frame.group_by([*self.keys, column], {"count": ("count", None)}, dropna=True)

    def ohlc(self, column: str) -> Frame:
        out = self.frame.df.groupBy(*self.keys).agg(aggregate("ohlc", F.col(column), pos=self.frame.pos).alias("x"))
        return Frame(out.select(*self.keys, "x.*"), self.keys)


# -- whole frames -------------------------------------------------------------


def mask(frame: Frame, predicate: str, name: str = "mask") -> Frame:
    """A predicate of the pipe language as a column; unknown is null."""
    from tessera.plans.compiler import Compiler, Context
    from tessera.plans.syntax import Parser

    compiler = Compiler(Context(frame.df.sparkSession))
    return frame.with_column(name, compiler.boolean(compiler.value(frame.df, Parser(predicate).expr())))


def equals(a: Frame, b: Frame) -> bool:
    """The same rows, however often each, in any order."""
    return a.df.schema.names == b.df.schema.names and a.df.exceptAll(b.df).isEmpty() and b.df.exceptAll(a.df).isEmpty()


def update(frame: Frame, other: Frame, keys: list[str]) -> Frame:
    """Non-null cells of the other frame replace those with the same keys."""
    shared = [c for c in frame.columns if c in other.columns and c not in keys]
    right = other.df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_u_{c}") for c in shared])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{i}"))
    out = frame.df.join(right, on, "left")
    return frame._new(out.select(*[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in frame.columns]))


def compare(frame: Frame, other: Frame, keys: list[str]) -> Frame:
    """Cells that differ, side by side, for rows with the same keys: (keys, column, self, other) as text."""
    shared = [c for c in frame.columns if c in other.columns and c not in keys]
    right = other.df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_u_{c}") for c in shared])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("self"), F.col(f"_u_{c}").cast("string").alias("other")) for c in shared])
    out = frame.df.join(right, on).select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
    return Frame(out.where(~F.col("self").eqNullSafe(F.col("other"))), keys)


def hstack(frame: Frame, other: Frame) -> Frame:
    """Columns of two frames side by side, row by row in their orders."""
    from tessera.operators.ordering import with_row_index

    a, b = with_row_index(frame.df, frame._need_order(), "_row"), with_row_index(other.df, other._need_order(), "_other")
    clash = {c: f"{c}_right" for c in other.columns if c in frame.columns}
    return frame._new(a.join(b.withColumnsRenamed(clash), F.col("_row") == F.col("_other"), "left").drop("_row", "_other"))


def between_time(frame: Frame, column: str, start: str, end: str, inclusive: str = "both") -> Frame:
    """Rows whose time of day lies between; a range over midnight wraps."""
    t = F.date_format(column, "HH:mm:ss.SSSSSS")
    low, high = ((x + ":00" if x.count(":") == 1 else x) + ("" if "." in x else ".000000") for x in (start, end))
    a = t >= low if inclusive in ("both", "left") else t > low
    b = t <= high if inclusive in ("both", "right") else t < high
    return frame.filter(a & b if low <= high else a | b)


def at_time(frame: Frame, column: str, time: str) -> Frame:
    return between_time(frame, column, time, time)


def first_span(frame: Frame, time: str, span: int) -> Frame:
    """Rows less than ``span`` after the first."""
    low = frame.df.agg(F.min(time).alias("_lo"))  # one row
    return frame._new(frame.df.crossJoin(F.broadcast(low)).where(F.col(time) < F.col("_lo") + span).drop("_lo"))


def last_span(frame: Frame, time: str, span: int) -> Frame:
    high = frame.df.agg(F.max(time).alias("_hi"))
    return frame._new(frame.df.crossJoin(F.broadcast(high)).where(F.col(time) > F.col("_hi") - span).drop("_hi"))


def truncate(frame: Frame, column: str, before=None, after=None) -> Frame:
    keep = F.lit(True)
    if before is not None:
        keep = keep & (F.col(column) >= before)
    if after is not None:
        keep = keep & (F.col(column) <= after)
    return frame.filter(keep)


def asfreq(frame: Frame, time: str, step: int, values: list[str], keys: list[str] | None = None, method: str = "none") -> Frame:
    return frame.gap_fill(keys or [], time, step, values, method)


def transpose(frame: Frame, index: str) -> Frame:
    """Columns as rows; a frame of few rows, whose index values become columns."""
    return Frame(frame.df.transpose(F.col(index)))


def str_get_dummies(frame: Frame, column: str, sep: str = "|", values: list[str] | None = None) -> Frame:
    """A 0/1 column for each part of a separated text."""
    parts = S.split(F.col(column), sep)
    if values is None:
        values = [r[0] for r in frame.df.select(F.explode(parts).alias("v")).where("v <> ''").distinct().orderBy("v").limit(1025).collect()]
        if len(values) > 1024:
            raise ValueError(f"more than 1024 distinct parts in {column}")
    return frame._new(frame.df.withColumns({v: F.coalesce(F.array_contains(parts, v), F.lit(False)).cast("tinyint") for v in values}))
