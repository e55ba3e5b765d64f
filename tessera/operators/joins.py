"""Joins: the classic kinds, lookup and nest, as-of, interval and overlap.

Equi-joins are left to Catalyst and adaptive execution.  As-of joins are one
union and one window per direction, never a comparison of all pairs.  Interval
and overlap joins are equi-joins on bins.  Every range has the level of its length,
a power of 16, and lies in at most 17 bins of that level's grid, so that one long
range among short ones costs no more than they do; a pair meets in one bin, on the
grid of the longer one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def _equal(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str], nulls_equal: bool) -> Column:
    out = F.lit(True)
    for a, b in zip(lk, rk, strict=True):
        out = out & (left[a].eqNullSafe(right[b]) if nulls_equal else left[a] == right[b])
    return out


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", suffix: str = "_right", nulls_equal: bool = False) -> DataFrame:
    """``how``: inner, left, right, outer, semi, anti, cross, lookup or nest. Clashing right names get the suffix."""
    rk = right_on or left_on
    if how == "nest":
        return nest(left, right, left_on, rk)
    if how == "lookup":
        return lookup(left, right, left_on, rk)
    renamed = {c: f"_r_{i}" for i, c in enumerate(right.columns)}
    other = right.select(*[F.col(c).alias(n) for c, n in renamed.items()])
    if how == "cross":
        both = left.crossJoin(other)
    else:
        both = left.join(other, _equal(left, other, left_on, [renamed[c] for c in rk], nulls_equal), KINDS[how])
    if how in ("semi", "anti"):
        return both
    out = []
    for c in left.columns:
        twin = renamed[rk[left_on.index(c)]] if c in left_on and how in ("right", "outer") else None
        out.append(F.coalesce(F.col(c), F.col(twin)).alias(c) if twin else F.col(c))
    drop = set() if how == "cross" else set(rk)
    out += [F.col(n).alias(c + suffix if c in left.columns else c) for c, n in renamed.items() if c not in drop]
    return both.select(*out)


def lookup(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], kind: str = "left") -> DataFrame:
    """Each left row once with the right side's other columns; right rows that disagree on a key are an error.

    A null cell of a left column with the same name is filled.  ``kind`` may be
    left, inner (matched rows alone) or anti (unmatched rows alone).
    """
    others = [c for c in right.columns if c not in right_on]
    if kind == "anti":
        return left.join(right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(right_on)]), _pairs(left_on), "left_anti")
    agreed = [F.when(F.min(c).eqNullSafe(F.max(c)), F.first(c, True)).otherwise(F.raise_error(F.lit(f"lookup: rows disagree on {c}"))).alias(f"_v{i}") for i, c in enumerate(others)]
    one = right.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(right_on)]).agg(F.lit(True).alias("_found"), *agreed)
    both = left.join(one, _pairs(left_on), "inner" if kind == "inner" else "left")
    out = [F.coalesce(F.col(c), F.col(f"_v{others.index(c)}")).alias(c) if c in others else F.col(c) for c in left.columns]
    return both.select(*out, *[F.col(f"_v{i}").alias(c) for i, c in enumerate(others) if c not in left.columns])


def _pairs(left_on: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(left_on):
        out = out & (F.col(k) == F.col(f"_k{i}"))
    return out


def nest(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], into: str = "matches") -> DataFrame:
    """Each left row once with the list of its matches, ordered; empty if there are none."""
    others = [c for c in right.columns if c not in right_on]
    lists = right.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(right_on)]).agg(F.array_sort(F.collect_list(F.struct(*others))).alias(into))
    both = left.join(lists, _pairs(left_on), "left")
    return both.select(*left.columns, F.coalesce(F.col(into), F.array().cast(lists.schema[into].dataType)).alias(into))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, direction: str = "backward", tolerance: float | None = None, right_on: str | None = None, key: list[str] | None = None, suffix: str = "_right") -> DataFrame:
    """The nearest right row at or before (backward), at or after (forward), or on either side (nearest) of each left row.

    Null ``by`` values match each other; a null time matches nothing.  Of right
    rows with one time the last in the order of ``key`` wins; of two equally near
    rows the earlier.
    """
    by, right_on = by or [], right_on or on
    others = [c for c in right.columns if c not in (*by, right_on)]
    payload = F.struct(F.col(right_on).alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)])
    rank = F.struct(*[F.col(k) for k in key]) if key else F.lit(0)
    one = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_t")).agg(F.max_by(payload, rank).alias("_p"))
    kinds = dict(left.dtypes)
    carried = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), carried.alias("_l"))
    marks = one.select(*by, F.col("_t").cast(kinds[on]).alias("_t"), F.lit(0).alias("_side"), "_p")
    both = rows.unionByName(marks, allowMissingColumns=True)
    keys = [F.col(b) for b in by]
    before = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    if direction == "backward":
        both = both.withColumn("_m", F.last("_p", True).over(before))
    elif direction == "forward":
        both = both.withColumn("_m", F.last("_p", True).over(after))
    else:
        both = both.withColumn("_b", F.last("_p", True).over(before)).withColumn("_a", F.last("_p", True).over(after))
        gap = _number("_t") - _number("_b._t")
        both = both.withColumn("_m", F.when(F.col("_a").isNull() | (gap <= _number("_a._t") - _number("_t")), F.coalesce("_b", "_a")).otherwise(F.col("_a")))
    both = both.where("_side = 1")
    good = F.col("_t").isNotNull()
    if tolerance is not None:
        good = good & (F.abs(_number("_t") - _number("_m._t")) <= tolerance)
    return both.select("_l.*", *[F.when(good, F.col(f"_m._c{i}")).alias(c + suffix if c in left.columns else c) for i, c in enumerate(others)], F.when(good, F.col("_m._t")).alias(f"{right_on}{suffix}"))


def _number(c: str) -> Column:
    return F.col(c).cast("double")


BASE = 16.0


def _power(length: Column) -> Column:
    return F.floor(F.log(BASE, F.when(length > 0, length))).cast("int")


def _level(low: Column, high: Column, finest: int) -> Column:
    """The power of ``BASE`` of a range's length, ``finest`` at least; ``finest`` too for an empty range or a null."""
    return F.greatest(F.lit(finest), F.coalesce(_power(high - low), F.lit(finest)))


def _levels(width: float | None, *sides: tuple[DataFrame, Column, Column]) -> tuple[int, list[int]]:
    """The finest level, by ``width`` or the shortest range, and those in use: a few numbers, whatever the size of the tables.

    The finest is not so fine that the number of a bin would overflow.
    """
    powers, largest = set(), 0.0
    for df, low, high in sides:
        row = df.select(_power(high - low).alias("power"), F.greatest(F.abs(low), F.abs(high)).alias("size")).agg(F.collect_set("power").alias("powers"), F.max("size").alias("size")).first()
        powers |= set(row["powers"])
        largest = max(largest, float(row["size"] or 0.0))
    finest = math.floor(math.log(width, BASE)) if width else min(powers, default=0)
    if largest > 0:
        finest = max(finest, math.ceil(math.log(largest, BASE)) - 13)
    return finest, sorted({max(finest, x) for x in powers} | {finest})


def _bin_of(level: int) -> Callable[[Column], Column]:
    return lambda at: F.struct(F.lit(level).alias("level"), at.alias("at"))


def _bins(low: Column, high: Column, level: Column, levels: list[int], own: bool) -> Column:
    """Bins (level, at) of a range: those of its own level (or ``own``: no other), and of all higher levels in use."""
    parts = []
    for x in levels:
        width = BASE**x
        first, last = F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint")
        hit = F.transform(F.sequence(first, last), _bin_of(x))
        parts.append(F.when((last >= first) & ((level == x) if own else (level <= x)), hit))
    none = F.expr("cast(array() as array<struct<level: int, at: bigint>>)")
    return F.concat(none, *[F.coalesce(x, none) for x in parts])


def _renamed(right: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    others = [c for c in right.columns if c not in by]
    return right.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)]), others


def interval(left: DataFrame, right: DataFrame, point: str, low: str, high: str, by: list[str] | None = None, outer: bool = False, width: float | None = None) -> DataFrame:
    """Left rows with every right row whose closed range holds the point; ``outer`` keeps the others.

    Ranges shorter than ``width``, by default none, share the finest grid.
    """
    by = by or []
    side, others = _renamed(right, by)
    lo, hi = F.col(f"_c{others.index(low)}"), F.col(f"_c{others.index(high)}")
    a, b, at = lo.cast("double"), hi.cast("double"), F.col(point).cast("double")
    finest, levels = _levels(width, (side, a, b), (left, at, at))
    side = side.withColumn("_bin", F.explode(_bins(a, b, _level(a, b, finest), levels, True)))
    rows = left.withColumn("_lbin", F.explode(_bins(at, at, F.lit(finest), levels, False)))
    on = (F.col("_lbin") == F.col("_bin")) & (F.col(point) >= lo) & (F.col(point) <= hi)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    columns = [F.col(f"_c{i}").alias(c + "_right" if c in left.columns else c) for i, c in enumerate(others)]
    if outer:
        rows = left.distinct().withColumn("_lbin", F.explode(_bins(at, at, F.lit(finest), levels, False)))
        return _with_unmatched(left, rows.join(side, on), columns)
    return rows.join(side, on).select(*left.columns, *columns)


def _with_unmatched(left: DataFrame, pairs: DataFrame, columns: list[Column]) -> DataFrame:
    """Every row of ``left`` with its pairs, or with nulls; ``pairs`` are of its distinct rows, so a repeated one has each pair as often as it occurs."""
    found = pairs.select(F.struct(*left.columns).alias("_of"), *columns)
    return left.withColumn("_row", F.struct(*left.columns)).join(found, F.col("_row").eqNullSafe(F.col("_of")), "left").select(*left.columns, *found.columns[1:])


def overlap(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, by: list[str] | None = None, how: str = "inner", width: float | None = None) -> DataFrame:
    """Pairs of half-open ranges that intersect: ``a.start < b.end`` and ``b.start < a.end``; ``how`` is inner or left.

    Both sides lie in the bins of their own level and of every higher one in use; a
    pair counts on the higher of its two levels, in the bin where the later of the
    two starts lies, so that it is produced once.
    """
    by = by or []
    side, others = _renamed(right, by)
    s, e = F.col(f"_c{others.index(right_start)}"), F.col(f"_c{others.index(right_end)}")
    ls, le, rs, re = (c.cast("double") for c in (F.col(left_start), F.col(left_end), s, e))
    finest, levels = _levels(width, (left, ls, le), (side, rs, re))
    side = side.withColumn("_rlevel", _level(rs, re, finest)).withColumn("_bin", F.explode(_bins(rs, re, F.col("_rlevel"), levels, False)))
    rows = (left.distinct() if how == "left" else left).withColumn("_llevel", _level(ls, le, finest)).withColumn("_lbin", F.explode(_bins(ls, le, F.col("_llevel"), levels, False)))
    later = F.coalesce(*[F.when(F.col("_bin.level") == x, F.floor(F.greatest(ls, rs) / BASE**x)) for x in levels])
    meet = (F.col("_lbin") == F.col("_bin")) & (F.col(left_start) < e) & (s < F.col(left_end)) & (F.col("_bin.level") == F.greatest("_llevel", "_rlevel")) & (later == F.col("_bin.at"))
    for i, c in enumerate(by):
        meet = meet & (F.col(c) == F.col(f"_by{i}"))
    columns = [F.col(f"_c{i}").alias(c + "_right" if c in left.columns else c) for i, c in enumerate(others)]
    pairs = rows.join(side, meet)
    return _with_unmatched(left, pairs, columns) if how == "left" else pairs.select(*left.columns, *columns)


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregated frames side by side: l_, r_, delta_ and pct_ of every numeric metric."""
    metrics = [c for c, t in left.dtypes if c not in keys and c in right.columns and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    a = left.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], *[F.col(m).alias(f"l_{m}") for m in metrics])
    b = right.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[F.col(m).alias(f"r_{m}") for m in metrics])
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    out = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    for m in metrics:
        x, y = F.col(f"l_{m}").cast("double"), F.col(f"r_{m}").cast("double")
        out += [F.col(f"l_{m}"), F.col(f"r_{m}"), (y - x).alias(f"delta_{m}"), (F.try_divide(y - x, x) * 100).alias(f"pct_{m}")]
    return a.join(b, on, "full").select(*out)
