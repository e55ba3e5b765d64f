"""Whole-frame access in the style of in-memory tables: labels, positions, rows, renderings.

Operations on columns and labels stay lazy.  Those that hand rows to Python say so:
``iter_rows`` and its kin stream one partition at a time, ``rows``, ``to_dicts``,
``to_numpy`` and ``to_records`` hold the frame in the driver as their caller asks,
and renderings take a number of rows.  The index of a frame is its first order column.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.operators.ordering import with_row_index

# -- labels and columns ---------------------------------------------------------


def from_records(spark: SparkSession, records: list, columns: list[str] | str, order: list[str] | None = None) -> Frame:
    return Frame(spark.createDataFrame(records, columns), order)


def copy(frame: Frame, deep: bool = True) -> Frame:
    """Frames never change, so a copy is the same plan."""
    return Frame(frame.df, frame.order)


def set_axis(frame: Frame, labels: list[str]) -> Frame:
    if len(labels) != len(frame.columns):
        raise ValueError(f"{len(frame.columns)} columns, {len(labels)} labels")
    new = dict(zip(frame.columns, labels, strict=True))
    return Frame(frame.df.toDF(*labels), [new[c] for c in frame.order])


def rename_axis(frame: Frame, name: str) -> Frame:
    """The index column under another name."""
    old = frame._need_order()[0]
    return Frame(frame.df.withColumnRenamed(old, name), [name, *frame.order[1:]])


def insert(frame: Frame, at: int, name: str, value: Column | Any) -> Frame:
    if name in frame.columns:
        raise ValueError(f"column {name} exists")
    made = (value if isinstance(value, Column) else F.lit(value)).alias(name)
    return frame._new(frame.df.select(*frame.columns[:at], made, *frame.columns[at:]))


def pop(frame: Frame, name: str) -> tuple[Frame, Frame]:
    """The column (with the order) and the frame without it."""
    keep = [c for c in frame.order if c != name]
    return Frame(frame.df.select(*keep, name), keep), frame._new(frame.df.drop(name))


def get_column(frame: Frame, name: str) -> Frame:
    if name not in frame.columns:
        raise KeyError(name)
    return frame._new(frame.df.select(name))


def get_columns(frame: Frame) -> list[Frame]:
    return [get_column(frame, c) for c in frame.columns]


def get_column_index(frame: Frame, name: str) -> int:
    return frame.columns.index(name)


def to_series(frame: Frame, at: int = 0) -> Frame:
    return get_column(frame, frame.columns[at])


def items(frame: Frame) -> Iterator[tuple[str, Frame]]:
    return ((c, get_column(frame, c)) for c in frame.columns)


def keys(frame: Frame) -> list[str]:
    return frame.columns


def ndim(frame: Frame) -> int:
    return 2


def axes(frame: Frame) -> tuple[list[str], list[str]]:
    return frame.order, frame.columns


def is_empty(frame: Frame) -> bool:
    return frame.df.isEmpty()


empty = is_empty


def applymap(frame: Frame, fn: Callable[[Column], Column]) -> Frame:
    """``fn`` of every cell, given as an expression of the column; the order stays as it is."""
    return frame._new(frame.df.select(*[F.col(c) if c in frame.order else fn(F.col(c)).alias(c) for c in frame.columns]))


def combine(frame: Frame, other: Frame, fn: Callable[[Column, Column], Column]) -> Frame:
    """``fn`` of the columns that both have, row by row in their orders; the shorter one has nulls at its end."""
    shared = [c for c in frame.columns if c in other.columns]
    a = with_row_index(frame.df, frame._need_order(), "_row").select("_row", *[F.col(c).alias(f"a{i}") for i, c in enumerate(shared)])
    b = with_row_index(other.df, other._need_order(), "_row").select("_row", *[F.col(c).alias(f"b{i}") for i, c in enumerate(shared)])
    made = [fn(F.col(f"a{i}"), F.col(f"b{i}")).alias(c) for i, c in enumerate(shared)]
    return Frame(a.join(b, "_row", "full").select("_row", *made), ["_row"])


# -- index and positions --------------------------------------------------------


def xs(frame: Frame, key: Any, index: str | None = None) -> Frame:
    """Rows with this index value, without the index."""
    at = index or frame._need_order()[0]
    return frame._new(frame.df.where(F.col(at).eqNullSafe(F.lit(key))).drop(at))


def sort_index(frame: Frame, ascending: bool = True, axis: int = 0) -> Frame:
    if axis == 1:
        return frame._new(frame.df.select(*sorted(frame.columns, reverse=not ascending)))
    own = [F.col(c) for c in frame._need_order()]
    return frame._new(frame.df.orderBy(*[c.asc_nulls_last() if ascending else c.desc_nulls_last() for c in own]))


def first_valid_index(frame: Frame, column: str) -> Any:
    """The index of the first non-null value; null where there is none."""
    return frame.df.where(F.col(column).isNotNull()).agg(F.min(frame.pos).alias("p")).select(_index(frame)).first()[0]


def last_valid_index(frame: Frame, column: str) -> Any:
    return frame.df.where(F.col(column).isNotNull()).agg(F.max(frame.pos).alias("p")).select(_index(frame)).first()[0]


def _index(frame: Frame) -> Column:
    return F.col("p") if len(frame.order) == 1 else F.col("p")[frame.order[0]]


def argsort(frame: Frame, column: str, name: str = "position") -> Frame:
    """For each place in the order of the column (nulls last, ties as they stand): the position of its row."""
    rows = with_row_index(frame.df.select(*dict.fromkeys([*frame._need_order(), column])), frame.order, name)
    return Frame(with_row_index(rows.select(F.col(column).alias("_v"), name), ["_v", name], "_at").select("_at", name), ["_at"])


def is_sorted(frame: Frame, column: str) -> bool:
    """Whether the column never falls along the frame's order; nulls last."""
    found = argsort(frame, column).df
    return found.where(F.col("_at") != F.col("position")).isEmpty()


def groups(frame: Frame, by: list[str], name: str = "positions") -> Frame:
    """One row for each position with its group's keys: (keys, position); a list for each group would not be bounded."""
    return Frame(with_row_index(frame.df, frame._need_order(), name).select(*by, name), [name])


def partition_by(frame: Frame, by: str | list[str], as_dict: bool = False, most: int = 1024) -> list[Frame] | dict[tuple, Frame]:
    """A lazy frame for each key, in key order; more than ``most`` keys are refused, none is dropped."""
    by = [by] if isinstance(by, str) else by
    found = frame.df.select(*by).distinct().orderBy(*[F.col(c).asc_nulls_last() for c in by]).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} keys; use group_by or partition_id")
    out = {}
    for row in found:
        keep = F.lit(True)
        for c in by:
            keep = keep & F.col(c).eqNullSafe(F.lit(row[c]))
        out[tuple(row)] = frame.filter(keep)
    return out if as_dict else list(out.values())


def item(frame: Frame, at: int | None = None, column: str | int = 0) -> Any:
    """One cell: the only one, or that at a row and column."""
    if at is None:
        if len(frame.columns) != 1:
            raise ValueError("more than one column")
        found = frame.df.limit(2).collect()
        if len(found) != 1:
            raise ValueError("not exactly one row")
        return found[0][0]
    name = frame.columns[column] if isinstance(column, int) else column
    return row(frame, at, named=True)[name]


def squeeze(frame: Frame) -> Any:
    """The cell of a frame of one, or the frame itself."""
    if len(frame.columns) == 1:
        found = frame.df.limit(2).collect()
        if len(found) == 1:
            return found[0][0]
    return frame


def row(frame: Frame, at: int, named: bool = False) -> tuple | dict:
    """The row at a position; negative ones count from the end."""
    found = (frame.head(at + 1) if at >= 0 else frame.tail(-at)).df
    rows = found.orderBy(*[F.col(c).asc_nulls_last() for c in frame.order]).collect()
    if len(rows) < (at + 1 if at >= 0 else -at):
        raise IndexError(at)
    return rows[at].asDict() if named else tuple(rows[at])


# -- rows to Python --------------------------------------------------------------


def _in_order(frame: Frame):
    return frame.df.orderBy(*[F.col(c).asc_nulls_last() for c in frame.order]) if frame.order else frame.df


def iter_rows(frame: Frame, named: bool = False) -> Iterator[tuple | dict]:
    """One partition in memory at a time."""
    for r in _in_order(frame).toLocalIterator():
        yield r.asDict() if named else tuple(r)


def iterrows(frame: Frame) -> Iterator[tuple[int, dict]]:
    return enumerate(iter_rows(frame, named=True))


def itertuples(frame: Frame, index: bool = True, name: str = "Row") -> Iterator[tuple]:
    make = namedtuple(name, [*(["Index"] if index else []), *frame.columns], rename=True)
    for i, r in enumerate(iter_rows(frame)):
        yield make(*([i] if index else []), *r)


def rows(frame: Frame, named: bool = False) -> list:
    return list(iter_rows(frame, named))


def to_dicts(frame: Frame) -> list[dict]:
    return rows(frame, named=True)


def to_numpy(frame: Frame):
    return _in_order(frame).toPandas().to_numpy()


values = to_numpy


def to_records(frame: Frame):
    return _in_order(frame).toPandas().to_records(index=False)


# -- renderings --------------------------------------------------------------------


def _shown(frame: Frame, most: int) -> list[list[str]]:
    found = _in_order(frame).limit(most).select(*[F.col(c).cast("string") for c in frame.columns]).collect()
    return [["null" if x is None else x for x in r] for r in found]


def to_string(frame: Frame, most: int = 60) -> str:
    body = [frame.columns, *_shown(frame, most)]
    width = [max(len(r[i]) for r in body) for i in range(len(frame.columns))]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, width, strict=True)) for r in body)


def to_markdown(frame: Frame, most: int = 60) -> str:
    line = lambda cells: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in cells) + " |"
    return "\n".join([line(frame.columns), "|" + "-|" * len(frame.columns), *map(line, _shown(frame, most))])


def to_html(frame: Frame, most: int = 60) -> str:
    from html import escape

    def line(tag, cells):
        return "<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in cells) + "</tr>"

    return "<table>" + "".join([line("th", frame.columns), *(line("td", r) for r in _shown(frame, most))]) + "</table>"


def info(frame: Frame) -> Frame:
    """A row for each column: its type and non-null count; one pass."""
    counts = frame.df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(frame.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col(f"n{i}").alias("non_null")) for i, (c, kind) in enumerate(frame.df.dtypes)])
    return Frame(counts.select(F.inline(cells)))


def memory_usage(frame: Frame) -> int:
    """Bytes of the plan's result as the optimizer estimates them; nothing runs."""
    return int(frame.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def swapaxes(frame: Frame, index: str) -> Frame:
    from tessera.facade import transpose

    return transpose(frame, index)
