"""Nesting of intervals in lanes: call trees and flame graphs.

A lane's intervals either nest or are apart.  The stack walk needs a lane's rows
in order of start, longest first.  Rows are cut along that order into ranges of
about ``RANGE`` rows, wherever in a lane that falls.  One walk over each range finds
what it leaves on the stack; these remainders, one stack for each range, are joined
up in order; a second walk starts each range with the stack left before it.  The
first walk holds a batch and the stack, the second a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ordering

Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows between two places where the stack is carried over.
RANGE = 1 << 18
#: Rows of Python results at once.
BATCH = 10_000


def _in_order(rows: DataFrame, lane: list[str]) -> DataFrame:
    """Each range in order, numbered by ``_n``; ``_new`` where a range or a lane begins."""
    w = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_last() for c in (*lane, "_s", "_down", "id")])
    own = F.struct(F.lit(0), *lane)
    return rows.withColumns({"_n": F.row_number().over(w), "_new": ~F.lag(own).over(w).eqNullSafe(own)}).sortWithinPartitions("_range", "_n")


def _remainders(lane: list[str]) -> Walk:
    """Of each range, a row ``_at`` -1 with its first lane, then the stack that its last lane leaves.

    The first row has the lane's latest end and the start at which the range's own stack was last
    empty (a row from before is open after it if it ends later than that), and whether it is the only lane.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        at, keys, head, stack = None, {}, {}, []

        def close() -> None:
            out.append(head)
            top: int | None = None
            rows = []
            for i, n, e in reversed(stack):  # open as long as any row above it
                top = e if top is None else max(top, e)
                rows.append({"id": i, "name": n, "_e": top})
            out.extend({"_range": at, "_at": j, **keys, **row} for j, row in enumerate(reversed(rows)))

        for b in batches:
            columns = {c: b[c] for c in lane}
            schema = pa.schema([("_range", pa.int32()), ("_at", pa.int32()), *[(c, v.type) for c, v in columns.items()], ("id", pa.int64()), ("name", pa.string()), ("_e", pa.int64()), ("_empty", pa.int64()), ("_only", pa.bool_())])
            for j, (r, i, n, s, e, new) in enumerate(zip(*(b[c].to_pylist() for c in ("_range", "id", "name", "_s", "_e", "_new")), strict=True)):
                if new:
                    if r == at:
                        head["_only"] = False
                    elif at is not None:
                        close()
                    keys, stack = {c: v[j].as_py() for c, v in columns.items()}, []
                    if r != at:
                        at, head = r, {"_range": r, "_at": -1, **keys, "_e": None, "_empty": None, "_only": True}
                if s is None:
                    continue
                while stack and stack[-1][2] <= s:
                    stack.pop()
                if head["_only"]:
                    if not stack:
                        head["_empty"] = s
                    if head["_e"] is None or e > head["_e"]:
                        head["_e"] = e
                stack.append((i, n, e))
            while len(out) > BATCH:
                yield pa.RecordBatch.from_pylist(out[:BATCH], schema)
                out = out[BATCH:]
        if at is not None:
            close()
            for k in range(0, len(out), BATCH):
                yield pa.RecordBatch.from_pylist(out[k : k + BATCH], schema)

    return walk


def _carried(lane: list[str]) -> Walk:
    """From all remainders in order, the stack before each range."""

    def same(a: list, b: list) -> bool:
        return len(a) == len(b) and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        stack: list[tuple] = []
        for b in batches:
            out: list[dict] = []
            schema = pa.schema([b.schema.field(c) for c in ("_range", "_at", *lane, "id", "name", "_e")])
            for row in b.to_pylist():
                here = [row[c] for c in lane]
                if row["_at"] >= 0:
                    keys = here
                    stack.append((row["id"], row["name"], row["_e"]))
                    continue
                if not same(keys, here):
                    stack = []
                for j, (i, n, e) in enumerate(stack):
                    out.append({"_range": row["_range"], "_at": j, **{c: row[c] for c in lane}, "id": i, "name": n, "_e": e})
                    if len(out) >= BATCH:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                keys = here
                if not row["_only"]:
                    stack = []
                elif row["_empty"] is not None:
                    stack = [(i, n, max(e, row["_e"])) for i, n, e in stack if e > row["_empty"]]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return walk


def _levels(lane: list[str], paths: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def walk(rows: pa.Table, carried: pa.Table) -> pa.Table:
        stack: list[tuple] = []

        def path(n: str | None) -> str | None:
            return ((stack[-1][2] + ";" if stack else "") + (n or "")) if paths else None

        for row in carried.sort_by("_at").to_pylist():
            stack.append((row["id"], row["_e"], path(row["name"])))
        out, begun = [], False
        for b in rows.sort_by("_n").to_batches(max_chunksize=BATCH):
            levels, parents, texts = [], [], []
            for i, n, s, e, new in zip(*(b[c].to_pylist() for c in ("id", "name", "_s", "_e", "_new")), strict=True):
                if (new and begun) or s is None:  # no row with a start comes after one without in its lane
                    stack = []
                begun = True
                while stack and stack[-1][1] <= s:
                    stack.pop()
                text = path(n)
                levels.append(len(stack))
                parents.append(stack[-1][0] if stack else -1)
                texts.append(text)
                if s is not None:
                    stack.append((i, e, text))
            out.append(pa.table({"id": b["id"], **{c: b[c] for c in lane}, "name": b["name"], "start": b["_s"], "duration": pc.subtract(b["_e"], b["_s"]), "level": pa.array(levels, pa.int32()), "parent_id": pa.array(parents, pa.int64()), "path": pa.array(texts, pa.string())}))
        return pa.concat_tables(out)

    return walk


def call_tree(df: DataFrame, lane: list[str], start: str, duration: str, name: str, key: str, paths: bool = True, rows_in_range: int = RANGE) -> DataFrame:
    """Rows (key, lane, name, start, duration, level, parent_id, path): level 0 and parent -1 for roots; path joins the names.

    A row without a start is a root without children.  Without ``paths``, path is null.
    """
    begin, length = F.col(start).cast("bigint"), F.coalesce(F.col(duration), F.lit(0)).cast("bigint")
    rows = df.select(F.col(key).cast("bigint").alias("id"), *lane, F.col(name).cast("string").alias("name"), begin.alias("_s"), (begin + length).alias("_e"))
    rows = rows.withColumn("_down", F.bitwise_not("_e"))  # the latest end first
    n = rows.count()
    rows = ordering.ranged(rows, [*lane, "_s", "_down", "id"], n, rows_in_range)
    # Both walks read one exchange, of about a range a task.
    rows = _in_order(rows.repartition(min(ordering.RANGES, n // rows_in_range + 2), "_range"), lane)
    kinds = dict(rows.dtypes)
    lanes = "".join(f"`{c}` {kinds[c]}, " for c in lane)
    left = rows.mapInArrow(_remainders(lane), f"_range int, _at int, {lanes}id bigint, name string, _e bigint, _empty bigint, _only boolean")
    # One task: a row and a stack for each range.
    before = left.repartition(1).sortWithinPartitions("_range", "_at").mapInArrow(_carried(lane), f"_range int, _at int, {lanes}id bigint, name string, _e bigint")
    return rows.groupBy("_range").cogroup(before.groupBy("_range")).applyInArrow(_levels(lane, paths), f"id bigint, {lanes}name string, start bigint, duration bigint, level int, parent_id bigint, path string")


def flamegraph(tree: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per distinct path (and group): name, level, count, total and self time."""
    if group:
        children = tree.where("level > 0").groupBy(F.col("parent_id").alias("_of")).agg(F.sum("duration").alias("_inner"))
        own = tree.join(children, F.col("id") == F.col("_of"), "left")
        return own.groupBy(*group, "path").agg(F.first("name").alias("name"), F.first("level").alias("level"), F.count(F.lit(1)).alias("count"), F.sum("duration").alias("total"), F.sum(F.col("duration") - F.coalesce("_inner", F.lit(0))).alias("self"))
    # A row's time counts for its own path, and against the path above it, which is its own without the name.
    above = F.col("path").substr(F.lit(1), F.char_length("path") - F.char_length(F.coalesce("name", F.lit(""))) - 1)
    node = F.struct("level", "name")
    own = F.struct(F.col("path").alias("path"), node.alias("node"), F.lit(1).alias("count"), F.col("duration").alias("total"), F.col("duration").alias("self"))
    taken = F.struct(above.alias("path"), F.when(F.lit(False), node).alias("node"), F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("total"), (-F.col("duration")).alias("self"))
    parts = tree.select(F.explode(F.when(F.col("level") > 0, F.array(own, taken)).otherwise(F.array(own))).alias("x")).select("x.*")
    out = parts.groupBy("path").agg(F.max("node").alias("node"), *[F.sum(c).alias(c) for c in ("count", "total", "self")])
    return out.select("path", "node.name", "node.level", "count", "total", "self")
