"""Window functions and group-wise transforms by name.

A window is a partition and an order; framed functions take ``rows`` (how many
rows the frame ends with at the current one) or ``span`` (a range of the single
ordering value), and are null below ``min_count`` values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED, CURRENT, END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def spec(partition: list, order: list) -> WindowSpec:
    """Nulls come last, whatever the direction."""
    w = Window.partitionBy(*partition)
    return w.orderBy(*order) if order else w


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(UNBOUNDED, CURRENT)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(UNBOUNDED, END)


def frame(w: WindowSpec, rows: int | None = None, span: int | None = None) -> WindowSpec:
    if rows is not None:
        return w.rowsBetween(-(rows - 1), CURRENT)
    if span is not None:
        return w.rangeBetween(-span, CURRENT)
    return running(w)


def _framed(make: Callable[[Column], Column]) -> Callable[..., Column]:
    def run(w, v, rows=None, span=None, min_count=1, **_):
        f = frame(w, rows, span)
        return F.when(F.count(v).over(f) >= min_count, make(v).over(f))

    return run


def _rate(w, v, time, reset=False, **_):
    before, t = F.lag(v).over(w), F.lag(time).over(w)
    delta = F.when(v < before, v).otherwise(v - before) if reset else v - before
    return F.try_divide(delta.cast("double"), (time - t).cast("double"))


WINDOWS: dict[str, Callable[..., Column]] = {
    "row_number": lambda w, **_: F.row_number().over(w),
    "rank": lambda w, **_: F.rank().over(w),
    "dense_rank": lambda w, **_: F.dense_rank().over(w),
    "percent_rank": lambda w, **_: F.percent_rank().over(w),
    "cume_dist": lambda w, **_: F.cume_dist().over(w),
    "ntile": lambda w, n, **_: F.ntile(n).over(w),
    "lag": lambda w, v, n=1, default=None, **_: F.lag(v, n, default).over(w),
    "lead": lambda w, v, n=1, default=None, **_: F.lead(v, n, default).over(w),
    "running_sum": lambda w, v, **_: F.sum(v).over(running(w)),
    "running_min": lambda w, v, **_: F.min(v).over(running(w)),
    "running_max": lambda w, v, **_: F.max(v).over(running(w)),
    "running_mean": lambda w, v, **_: F.avg(v).over(running(w)),
    "running_count": lambda w, **_: F.count(F.lit(1)).over(running(w)),
    "running_prod": lambda w, v, **_: F.product(v).over(running(w)),
    "delta": lambda w, v, **_: v - F.lag(v).over(w),
    "rate": _rate,
    "first_value": lambda w, v, **_: F.first(v).over(whole(w)),
    "last_value": lambda w, v, **_: F.last(v).over(whole(w)),
    "nth_value": lambda w, v, n, **_: F.nth_value(v, n).over(whole(w)),
    "fill_forward": lambda w, v, **_: F.last(v, True).over(running(w)),
    "fill_backward": lambda w, v, **_: F.first(v, True).over(w.rowsBetween(CURRENT, END)),
    "frame_sum": _framed(F.sum),
    "frame_min": _framed(F.min),
    "frame_max": _framed(F.max),
    "frame_mean": _framed(F.avg),
    "frame_count": lambda w, v, rows=None, span=None, **_: F.count(v).over(frame(w, rows, span)),
    "frame_var": _framed(F.var_samp),
    "frame_std": _framed(F.stddev_samp),
    "frame_quantile": lambda w, v, q, rows=None, span=None, **_: F.percentile(v, q).over(frame(w, rows, span)),
    "frame_count_distinct": lambda w, v, rows=None, span=None, **_: F.size(F.collect_set(v).over(frame(w, rows, span))),
    "frame_collect": lambda w, v, rows=None, span=None, **_: F.collect_list(v).over(frame(w, rows, span)),
    "frame_arg_max": lambda w, v, by, pos, rows=None, span=None, **_: F.max_by(v, F.when(by.isNotNull(), F.struct(by, -pos))).over(frame(w, rows, span)),
    "frame_arg_min": lambda w, v, by, pos, rows=None, span=None, **_: F.min_by(v, F.when(by.isNotNull(), F.struct(by, pos))).over(frame(w, rows, span)),
}


def _keep(v: Column, made: Column) -> Column:
    return F.when(v.isNotNull(), made)


def _rank(keys: list, v: Column, method: str, ascending: bool, pos: Column) -> Column:
    own = v.asc_nulls_last() if ascending else v.desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(own)
    if method == "dense":
        out = F.dense_rank().over(w)
    elif method == "ordinal":
        out = F.row_number().over(Window.partitionBy(*keys).orderBy(own, pos))
    else:
        low, many = F.rank().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys, v))
        out = {"min": low, "max": low + many - 1, "average": low + (many - 1) / 2}[method]
    return _keep(v, out.cast("double"))


def _rolling(make: Callable[[Column], Column]) -> Callable[..., Column]:
    def run(keys, v, pos, n, **_):
        f = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(n - 1), CURRENT)
        return F.when(F.count(v).over(f) >= n, make(v).over(f))

    return run


def _over(make: Callable[[Column, WindowSpec], Column]) -> Callable[..., Column]:
    return lambda keys, v, pos, **_: make(v, Window.partitionBy(*keys).orderBy(pos))


#: One value for each input row; ``keys`` group, ``pos`` orders.  ``n_group`` is no window: see ``ordering.with_group_index``.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "cum_sum": _over(lambda v, w: _keep(v, F.sum(v).over(running(w)))),
    "cum_max": _over(lambda v, w: _keep(v, F.max(v).over(running(w)))),
    "cum_min": _over(lambda v, w: _keep(v, F.min(v).over(running(w)))),
    "cum_prod": _over(lambda v, w: _keep(v, F.product(v).over(running(w)))),
    "cum_count": _over(lambda v, w: F.row_number().over(w) - 1),
    "shift": lambda keys, v, pos, n=1, **_: F.lag(v, n).over(Window.partitionBy(*keys).orderBy(pos)),
    "diff": _over(lambda v, w: v - F.lag(v).over(w)),
    "pct_change": _over(lambda v, w: F.try_divide(v, F.lag(v).over(w)) - 1),
    "rank": lambda keys, v, pos, method="average", ascending=True, **_: _rank(keys, v, method, ascending, pos),
    "head": lambda keys, v, pos, n=1, **_: F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) <= n,
    "tail": lambda keys, v, pos, n=1, **_: F.row_number().over(Window.partitionBy(*keys).orderBy(pos.desc())) <= n,
    "nth": lambda keys, v, pos, n=0, **_: F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) == n + 1,
    "ffill": _over(lambda v, w: F.last(v, True).over(running(w))),
    "bfill": _over(lambda v, w: F.first(v, True).over(w.rowsBetween(CURRENT, END))),
    "rolling_sum": _rolling(F.sum),
    "rolling_mean": _rolling(F.avg),
    "rolling_min": _rolling(F.min),
    "rolling_max": _rolling(F.max),
    "rolling_var": _rolling(F.var_samp),
    "rolling_std": _rolling(F.stddev_samp),
    "rolling_median": _rolling(lambda v: F.percentile(v, 0.5)),
    "rolling_quantile": lambda keys, v, pos, n, q, **_: _rolling(lambda x: F.percentile(x, q))(keys, v, pos, n),
    "interpolate": lambda keys, v, pos, **_: _interpolate(keys, v, pos),
    "ewm_mean": lambda keys, v, pos, **by: _ewm(keys, v, pos, decay(**by), False),
    "ewm_std": lambda keys, v, pos, **by: _ewm(keys, v, pos, decay(**by), True),
}


def _interpolate(keys: list, v: Column, pos: Column) -> Column:
    """Nulls between two values lie on the line between them, by place."""
    w = Window.partitionBy(*keys).orderBy(pos)
    at = F.row_number().over(w)
    known = F.when(v.isNotNull(), at)
    a, b = F.last(known, True).over(running(w)), F.first(known, True).over(w.rowsBetween(CURRENT, END))
    x, y = F.last(v, True).over(running(w)), F.first(v, True).over(w.rowsBetween(CURRENT, END))
    return F.coalesce(v.cast("double"), x + (y - x) * (at - a) / (b - a))


def decay(alpha: float | None = None, span: float | None = None, com: float | None = None, halflife: float | None = None) -> float:
    """The weight of the newest value, given as itself, a span, a centre of mass or a half-life; exactly one of them."""
    given = {"alpha": alpha, "span": span, "com": com, "halflife": halflife}
    given = {k: x for k, x in given.items() if x is not None}
    if len(given) != 1:
        raise ValueError("give exactly one of alpha, span, com, halflife")
    (kind, x), = given.items()
    out = {"alpha": lambda: x, "span": lambda: 2.0 / (x + 1.0), "com": lambda: 1.0 / (1.0 + x), "halflife": lambda: 1.0 - 0.5 ** (1.0 / x)}[kind]()
    if not 0.0 < out <= 1.0:
        raise ValueError(f"{kind} = {x} is out of range")
    return out


def _ewm(keys: list, v: Column, pos: Column, alpha: float, spread: bool) -> Column:
    """Exponentially weighted with adjusted weights: a fold over the values so far, in order."""
    values = F.collect_list(v.cast("double")).over(running(Window.partitionBy(*keys).orderBy(pos)))
    keep = 1.0 - alpha
    zero = F.lit(0.0)
    start = F.struct(zero.alias("w"), zero.alias("s"), zero.alias("w2"), zero.alias("q"))

    def step(a, x):
        return F.struct((a["w"] * keep + 1).alias("w"), (a["s"] * keep + x).alias("s"), (a["w2"] * keep * keep + 1).alias("w2"), (a["q"] * keep + x * x).alias("q"))

    def finish(a):
        mean = a["s"] / a["w"]
        if not spread:
            return mean
        return F.when(a["w"] * a["w"] > a["w2"], F.sqrt(F.greatest(a["q"] / a["w"] - mean * mean, zero) * a["w"] * a["w"] / (a["w"] * a["w"] - a["w2"])))

    return F.when(F.size(values) > 0, F.aggregate(values, start, step, finish))
