"""User functions: scalar, aggregate and table functions in one registry, for the frame API and the pipe language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Registry:
    """Functions by ``namespace.name``."""

    scalars: dict[str, Callable[..., Column]] = field(default_factory=dict)
    tables: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def expression(self, name: str) -> Callable:
        """A function of columns that returns a column: it is inlined and stays in code generation."""

        def take(fn: Callable[..., Column]) -> Callable[..., Column]:
            self.scalars[name] = fn
            return fn

        return take

    def batch(self, name: str, returns: str) -> Callable:
        """A function of pandas series: it runs over Arrow batches, never row by row."""

        def take(fn: Callable) -> Callable[..., Column]:
            made = F.pandas_udf(fn, returns, F.PandasUDFType.SCALAR)
            self.scalars[name] = lambda *xs: made(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
            return self.scalars[name]

        return take

    def table(self, name: str) -> Callable:
        """A function from a DataFrame (and constants) to a DataFrame, called with ``call``."""

        def take(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.tables[name] = fn
            return fn

        return take


def fold(df: DataFrame, keys: list[str], partial: Callable, combine: Callable, finish: Callable, state: str, result: str) -> DataFrame:
    """A user-defined aggregate in two steps, so that no task gathers all rows of a group.

    ``partial`` maps an Arrow table of one partition's rows of a key to a table of
    one state row, ``combine`` a table of states to one, ``finish`` a state to
    result rows.  ``state`` and ``result`` are schemas without the keys.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def split(table: pa.Table):
        distinct = table.select(keys).group_by(keys).aggregate([])
        for row in distinct.to_pylist():
            mask = None
            for k in keys:
                own = pc.is_null(table[k]) if row[k] is None else pc.equal(table[k], row[k])
                own = pc.fill_null(own, False)
                mask = own if mask is None else pc.and_(mask, own)
            yield row, table.filter(mask)

    def keyed(row: dict, out: pa.Table) -> pa.Table:
        for i, k in enumerate(keys):
            out = out.add_column(i, k, pa.array([row[k]] * out.num_rows))
        return out

    def first(batches):
        for batch in batches:
            for row, part in split(pa.Table.from_batches([batch])):
                yield from keyed(row, partial(part)).to_batches()

    def last(key, table):
        row = {k: v.as_py() for k, v in zip(keys, key, strict=True)}
        return keyed(row, finish(combine(table.drop_columns(keys))))

    return df.mapInArrow(first, f"{head}, {state}").groupBy(*keys).applyInArrow(last, f"{head}, {result}")
