"""Aggregates by name, as mergeable built-in expressions.

``value`` is what is aggregated; ``by`` a second column for the aggregates that
take one; ``pos`` the column (or struct) that orders rows, for those that depend
on order; ``param`` a number.  Nulls are skipped; of ties the earliest row wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Agg = Callable[..., Column]


def _ordered(by: Column, pos: Column | None, largest: bool) -> Column:
    """A struct whose largest (smallest) is at the extreme of ``by`` and then the first row."""
    if pos is None:
        return F.struct(by)
    return F.struct(by, -pos if largest else pos)


def _guard(moment: Column, value: Column) -> Column:
    """0 where all values are equal."""
    return F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(moment)


def _k(rows: Column, k: int) -> Column:
    return F.transform(F.slice(rows, 1, k), lambda x: x["v"])


#: Powers of two at which ``exact_mean`` cuts doubles; pieces have 31 bits, so that longs hold the sums of 2^31 rows.
PLACES = (31, 0, -31, -62, -93)


def exact_mean(value: Column) -> Column:
    """The mean of doubles from exact sums: the same in whatever order rows and partial sums meet.

    Each value is cut into pieces at fixed places, the pieces are summed as longs and the
    sums divided place by place.  A group with a value of 2^62 or more, finer than 2^-93 or
    not finite has the plain mean.
    """
    v = value.cast("double")
    rest, pieces = F.abs(v), []
    for p in PLACES:
        piece = F.floor(rest * 2.0**-p)
        rest = rest - piece * 2.0**p
        pieces.append(F.when(v < 0, -piece).otherwise(piece))
    n, carry, digits = F.nullif(F.count(v), F.lit(0)), F.lit(0).cast("bigint"), []
    for piece in pieces:
        total = F.try_add(F.try_sum(piece), F.try_multiply(carry, F.lit(1 << 31)))
        carry = total % n
        digits.append(F.call_function("div", total - carry, n))
    exact = F.bool_and((F.abs(v) < 2.0**62) & (rest == 0)) & (n < 1 << 31)
    high = digits[0] * 2.0**31 + digits[1] + digits[2] * 2.0**-31
    low = digits[3] * 2.0**-62 + (digits[4] + carry / n) * 2.0**-93
    return F.when(exact, high + low).otherwise(F.avg(v))


AGGREGATES: dict[str, Agg] = {
    "count": lambda v=None, **_: F.count(F.lit(1)),
    "count_valid": lambda v, **_: F.count(v),
    "count_if": lambda v, **_: F.count_if(v),
    "sum": lambda v, **_: F.try_sum(v),
    "min": lambda v, **_: F.min(v),
    "max": lambda v, **_: F.max(v),
    "mean": lambda v, **_: F.avg(v),
    "exact_mean": lambda v, **_: exact_mean(v),
    "var": lambda v, **_: F.var_samp(v),
    "std": lambda v, **_: F.stddev_samp(v),
    "skew": lambda v, **_: _guard(F.skewness(v), v),
    "kurt": lambda v, **_: _guard(F.kurtosis(v), v),
    "first": lambda v, pos, **_: F.min_by(v, F.when(v.isNotNull(), pos)),
    "last": lambda v, pos, **_: F.max_by(v, F.when(v.isNotNull(), pos)),
    "quantile": lambda v, param, **_: F.percentile_approx(v, param, 10_000),
    "quantile_exact": lambda v, param, **_: F.percentile(v, param),
    "median": lambda v, **_: F.median(v),
    "arg_max": lambda v, by, pos=None, **_: F.max_by(v, F.when(by.isNotNull(), _ordered(by, pos, True))),
    "arg_min": lambda v, by, pos=None, **_: F.min_by(v, F.when(by.isNotNull(), _ordered(by, pos, False))),
    "sum_sq": lambda v, **_: F.sum(v * v),
    "set_union": lambda v, **_: F.array_sort(F.collect_set(v)),
    "set_union_text": lambda v, **_: F.array_join(F.array_sort(F.collect_set(v.cast("string"))), "\u001e"),
    "bit_or": lambda v, **_: F.bit_or(v),
    "distinct": lambda v, **_: F.approx_count_distinct(v, 0.01),
    "count_distinct": lambda v, **_: F.count_distinct(v),
    "list_sorted": lambda v, by, pos=None, **_: F.transform(F.array_sort(F.collect_list(F.struct(by.alias("b"), (pos if pos is not None else F.lit(0)).alias("p"), v.alias("v")))), lambda x: x["v"]),
    "collect": lambda v, pos, **_: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(pos.alias("p"), v.alias("v"))))), lambda x: x["v"]),
    "top_k": lambda v, by, param, **_: _k(F.sort_array(F.collect_list(F.when(by.isNotNull(), F.struct(by.alias("b"), v.alias("v")))), False), param),
    "bottom_k": lambda v, by, param, **_: _k(F.sort_array(F.collect_list(F.when(by.isNotNull(), F.struct(by.alias("b"), v.alias("v"))))), param),
    "approx_top_k": lambda v, param, **_: F.call_function("approx_top_k", v, F.lit(param), F.lit(max(100, 10 * param))),
    "sample": lambda v, param, **_: F.array_sort(_k(F.array_sort(F.collect_set(F.struct(F.xxhash64(v).alias("h"), v.alias("v")))), param)),
    "corr": lambda v, by, **_: F.corr(by, v),
    "covar_pop": lambda v, by, **_: F.covar_pop(by, v),
    "covar_samp": lambda v, by, **_: F.covar_samp(by, v),
    "regr_slope": lambda v, by, **_: F.regr_slope(v, by),
    "regr_intercept": lambda v, by, **_: F.regr_intercept(v, by),
    "regr_r2": lambda v, by, **_: F.regr_r2(v, by),
    "prod": lambda v, **_: F.coalesce(F.product(v), F.lit(1.0)),
    "mode": lambda v, **_: F.mode(v, True),
    "any": lambda v, **_: F.bool_or(v),
    "all": lambda v, **_: F.bool_and(v),
    "sem": lambda v, **_: F.stddev_samp(v) / F.sqrt(F.count(v)),
    "nunique": lambda v, **_: F.count_distinct(v),
    "dot": lambda v, by, **_: F.sum(v * by),
    "ohlc": lambda v, pos, **_: F.struct(F.min_by(v, pos).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, pos).alias("close")),
    "hll": lambda v, **_: F.hll_sketch_estimate(F.hll_sketch_agg(v, F.lit(13))),
}


def aggregate(name: str, value: Column | None = None, by: Column | None = None, pos: Column | None = None, param=None) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    given = {k: v for k, v in (("by", by), ("pos", pos), ("param", param)) if v is not None}
    return AGGREGATES[name](value, **given)
