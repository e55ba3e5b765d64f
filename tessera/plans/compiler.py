"""The pipe language compiled to DataFrame calls.

Types decide at compile time: values of different kinds do not compare (the
result is unknown), arithmetic gives null instead of an error, and a field inside
a JSON text column is read as the type it is compared with.  Everything becomes
built-in expressions; Catalyst sees one logical plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import windows as W
from tessera.functions.aggregates import AGGREGATES, aggregate
from tessera.operators import calltree, joins, occupancy, ordering, timeseries

from .syntax import UNITS, Node, QueryError, parse

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
OCCUPANCY = ("busy", "concurrency", "utilization", "active")
_AGG_NAMES = {"count", "count_if", "sum", "min", "max", "mean", "var", "std", "first", "last", "quantile", "histogram", "count_distinct", "collect", "arg_max", "arg_min", *OCCUPANCY}


@dataclass
class Roles:
    """Which columns are a row's start, duration, lane and name, and the unit of time."""

    time: str = "ts"
    duration: str = "dur"
    lane: tuple[str, ...] = ("pid", "tid")
    name: str = "name"
    unit: str = "us"


@dataclass
class Context:
    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    roles: Roles = field(default_factory=Roles)
    order: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    table_functions: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    now: Callable[[], int] | None = None


@dataclass
class Value:
    col: Column
    kind: str  # number, string, bool, time, array, object, json, null
    name: str | None = None


def kind_of(dtype: str) -> str:
    base = dtype.split("(")[0].split("<")[0]
    if base in NUMBERS:
        return "number"
    return {"string": "string", "boolean": "bool", "array": "array", "struct": "object", "map": "object", "void": "null"}.get(base, "time")


def text_of(e: Node) -> str:
    """An entry's text, from which it is named."""
    match e[0]:
        case "call":
            return f"{e[1]}({', '.join(text_of(a) for a in e[2])})"
        case "path":
            return ".".join(e[1])
        case "lit":
            return str(e[1])
        case "arith" | "cmp":
            return f"{text_of(e[2])} {e[1]} {text_of(e[3])}"
        case "over":
            return f"{text_of(e[1])} over {text_of(e[2])}"
        case "duration":
            return "".join(e[1:])
        case _:
            return " ".join(text_of(x) if isinstance(x, tuple) else str(x) for x in e[1:])


def entry_name(e: Node) -> str:
    name = re.sub(r"[^A-Za-z0-9_]+", "_", text_of(e)).strip("_")
    return f"_{name}" if name[:1].isdigit() else name


class Compiler:
    def __init__(self, context: Context):
        self.c = context
        self.macros: dict[str, Node] = {}
        self.lets: dict[str, list[Node]] = {}

    # -- entry --------------------------------------------------------------

    def query(self, text: str, df: DataFrame | None = None) -> DataFrame:
        decls, stages = parse(text)
        for d in decls:
            if d[0] == "let":
                self.lets[d[1]] = d[2]
            else:
                self.macros[d[1]] = d
        return self.run(stages, df)

    def run(self, stages: list[Node], df: DataFrame | None) -> DataFrame:
        state = _State(df, [c for c in self.c.order if df is not None and c in df.columns])
        for stage in self._expanded(stages):
            if stage[0] == "from":
                sides = [self.source(s) for s in stage[1]]
                whole = sides[0]
                for s in sides[1:]:
                    whole = whole.unionByName(s, allowMissingColumns=True)
                state = _State(whole, [c for c in self.c.order if c in whole.columns])
                continue
            if state.df is None:
                raise QueryError("the query has no input: begin with from")
            if stage[0] not in ("where", "time_range", "bucket", "group"):
                state = state.but(wide=None)  # only filters may stand between a window and its occupancy
            state = getattr(self, f"_{stage[0]}")(state, *stage[1:])
        if state.bucket:
            raise QueryError("bucket needs a group or agg after it")
        return state.df

    def _expanded(self, stages: list[Node]) -> list[Node]:
        out: list[Node] = []
        for s in stages:
            macro = None
            if s[0] == "macro":
                macro, args = self.macros.get(s[1]), s[2]
                if macro is None:
                    s = ("where", ("call", s[1], s[2]))
            elif s[0] == "where" and s[1][0] == "path" and len(s[1][1]) == 1 and s[1][1][0] in self.macros:
                macro, args = self.macros[s[1][1][0]], []
            if macro is not None and macro[3][0] == "stages":
                out += self._expanded(_substitute(macro[3][1], dict(zip(macro[2], args, strict=True))))
            elif macro is not None:
                out.append(("where", _substitute(macro[3][1], dict(zip(macro[2], args, strict=True)))))
            else:
                out.append(s)
        return out

    def source(self, s: Node) -> DataFrame:
        if s[0] == "pipeline":
            return self.run(s[1], None)
        if s[0] == "file":
            from tessera.sources.io import read

            return read(self.c.spark, s[1])
        if s[1] in self.lets:
            return self.run(self.lets[s[1]], None)
        if s[1] in self.c.tables:
            return self.c.tables[s[1]]
        raise QueryError(f"unknown table {s[1]!r}")

    # -- expressions --------------------------------------------------------

    def value(self, df: DataFrame, e: Node, current: Column | None = None) -> Value:
        ev = lambda x: self.value(df, x, current)
        match e[0]:
            case "lit":
                v = e[1]
                kind = "null" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
                return Value(F.lit(v), kind)
            case "param":
                if e[1] not in self.c.params:
                    raise QueryError(f"parameter ${e[1]} is not bound")
                return self.value(df, ("lit", self.c.params[e[1]]))
            case "duration":
                ticks = float(e[1]) * UNITS[e[2]] / UNITS[self.c.roles.unit]
                return Value(F.lit(int(ticks) if ticks == int(ticks) else ticks), "number")
            case "path":
                return self.path(df, e[1])
            case "outer":
                return self.path(df, e[1])
            case "current":
                col = current
                for k in e[1]:
                    col = col[k]
                return self.typed(df, col) if not e[1] else Value(col, "any")
            case "array":
                return Value(F.array(*[ev(x).col for x in e[1]]), "array")
            case "and" | "or":
                a, b = self.boolean(ev(e[1])), self.boolean(ev(e[2]))
                return Value(a & b if e[0] == "and" else a | b, "bool")
            case "not":
                return Value(~self.boolean(ev(e[1])), "bool")
            case "is_null":
                return Value(ev(e[1]).col.isNull(), "bool")
            case "cmp":
                return Value(self.compare(e[1], ev(e[2]), ev(e[3])), "bool")
            case "in":
                out = F.lit(False)
                left = ev(e[1])
                for x in e[2]:
                    out = out | self.compare("==", left, ev(x))
                return Value(out, "bool")
            case "in_param":
                return self.value(df, ("in", e[1], [("lit", x) for x in self.c.params[e[2]]]), current)
            case "text_in":
                a, b = ev(e[1]), ev(e[2])
                if b.kind == "array":
                    return Value(F.array_contains(b.col, a.col), "bool")
                return Value(F.contains(S.lower(b.col), S.lower(a.col)), "bool")
            case "match":
                pattern = ev(e[2]) and (e[2][1] if e[2][0] == "lit" else self.c.params[e[2][1]])
                return Value(self.string(ev(e[1])).rlike(("(?i)" if e[3] else "") + pattern), "bool")
            case "like":
                pattern = e[2][1] if e[2][0] == "lit" else self.c.params[e[2][1]]
                left = self.string(ev(e[1]))
                return Value(S.like(S.lower(left) if e[3] else left, pattern.lower() if e[3] else pattern, e[4]), "bool")
            case "neg":
                return Value(S.sub(F.lit(0), self.number(ev(e[1]))), "number")
            case "arith":
                a, b = self.number(ev(e[2])), self.number(ev(e[3]))
                made = {"+": S.add, "-": S.sub, "*": S.mul, "/": S.div, "//": S.floordiv, "%": S.mod}[e[1]](a, b)
                return Value(made, "number")
            case "index":
                i = e[2][1] if e[2][0] == "lit" else self.number(ev(e[2]))
                if e[2][0] == "neg" and e[2][1][0] == "lit":
                    i = -e[2][1][1]
                return self.typed(df, S.list_get(ev(e[1]).col, i))
            case "field":
                return Value(ev(e[1]).col[e[2]], "any")
            case "call":
                return self.call(df, e[1], e[2], current)
        raise QueryError(f"{e[0]} cannot be used here")

    def typed(self, df: DataFrame, col: Column) -> Value:
        return Value(col, kind_of(df.select(col.alias("x")).dtypes[0][1]))

    def path(self, df: DataFrame, keys: list[str]) -> Value:
        names = {c: t for c, t in df.dtypes}
        whole = ".".join(keys)
        if whole in names:
            return Value(F.col(f"`{whole}`"), kind_of(names[whole]), whole)
        if keys[0] not in names:
            macro = self.macros.get(keys[0])
            if macro is not None and len(keys) == 1 and macro[3][0] == "expr":
                return self.value(df, macro[3][1])
            raise QueryError(f"unknown column {whole!r}; there are {', '.join(names)}")
        col, dtype = F.col(f"`{keys[0]}`"), names[keys[0]]
        if kind_of(dtype) == "string":  # JSON text
            return Value(F.get_json_object(col, "$." + ".".join(keys[1:])), "json", whole)
        for k in keys[1:]:
            col = col[k]
        return Value(col, self.typed(df, col).kind, whole)

    def number(self, v: Value) -> Column:
        if v.kind == "json":
            return v.col.try_cast("double")
        if v.kind == "time":
            return S.micros(v.col)
        if v.kind in ("number", "null", "any"):
            return v.col
        return F.lit(None).cast("double")

    def string(self, v: Value) -> Column:
        return v.col if v.kind in ("string", "json", "any") else F.lit(None).cast("string")

    def boolean(self, v: Value) -> Column:
        if v.kind == "json":
            return v.col.try_cast("boolean")
        return v.col if v.kind in ("bool", "any") else F.lit(None).cast("boolean")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        kinds = {a.kind, b.kind}
        if "any" in kinds or "null" in kinds:
            x, y = a.col, b.col
        elif kinds <= {"number", "json", "time"} and "number" in kinds:
            x, y = self.number(a), self.number(b)
        elif len(kinds) == 1 and not kinds & {"array", "object"} or kinds == {"json", "string"}:
            x, y = a.col, b.col
        else:
            return F.lit(None).cast("boolean")
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def call(self, df: DataFrame, name: str, args: list[Node], current: Column | None) -> Value:
        if name in self.macros and self.macros[name][3][0] == "expr":
            _, _, params, body = self.macros[name]
            return self.value(df, _substitute(body[1], dict(zip(params, args, strict=True))), current)
        if name in ("any", "all") and len(args) == 2:
            xs = self.value(df, args[0], current).col
            fn = F.exists if name == "any" else F.forall
            return Value(fn(xs, lambda x: self.boolean(self._element(df, args[0], args[1], x))), "bool")
        if name in self.c.functions:
            return self.typed(df, self.c.functions[name](*[self.value(df, a, current).col if a[0] != "lit" else a[1] for a in args]))
        vs = [self.value(df, a, current) for a in args]
        col = [v.col for v in vs]
        raw = [a[1] if a[0] == "lit" else self.c.params.get(a[1]) if a[0] == "param" else -a[1][1] if a[0] == "neg" and a[1][0] == "lit" else None for a in args]
        num = lambda i=0: self.number(vs[i])
        txt = lambda i=0: self.string(vs[i])
        n, b, s, arr = "number", "bool", "string", "array"
        same = next((v.kind for v in vs if v.kind != "null"), "null")
        match name:
            case "exists":
                return Value(col[0].isNotNull(), b)
            case "coalesce":
                return Value(F.coalesce(*col), same)
            case "if":
                return Value(F.when(self.boolean(vs[0]), col[1]).otherwise(col[2]), vs[1].kind if vs[1].kind != "null" else vs[2].kind)
            case "case":
                out = col[-1]
                for i in reversed(range(0, len(col) - 1, 2)):
                    out = F.when(self.boolean(vs[i]), col[i + 1]).otherwise(out)
                return Value(out, vs[1].kind)
            case "abs":
                return Value(F.abs(num()), n)
            case "floor" | "ceil":
                return Value(S.SCALARS[name](num()), n)
            case "round":
                return Value(F.round(num(), raw[1] if len(args) > 1 else 0), n)
            case "min" | "max":
                if len(col) == 1 and vs[0].kind == "array":
                    return self.typed(df, F.array_min(col[0]) if name == "min" else F.array_max(col[0]))
                return Value(S.SCALARS[name](*col), same)
            case "log" | "exp":
                return Value(S.SCALARS[name](num()), n)
            case "pow":
                return Value(S.power(num(0), num(1)), n)
            case "len":
                return Value(F.size(col[0]) if vs[0].kind in ("array", "object") else F.char_length(txt()), n)
            case "concat":
                return Value(F.concat(*[c.cast("string") for c in col]), s)
            case "lower" | "upper":
                return Value(S.SCALARS[name](txt()), s)
            case "trim":
                return Value(S.strip(txt()), s)
            case "starts_with" | "ends_with":
                return Value(F.startswith(txt(0), txt(1)) if name == "starts_with" else F.endswith(txt(0), txt(1)), b)
            case "contains":
                return Value(F.array_contains(col[0], col[1]) if vs[0].kind == "array" else F.contains(txt(0), txt(1)), b)
            case "substr":
                return Value(S.substr(txt(), raw[1], raw[2] if len(args) > 2 else None), s)
            case "replace":
                return Value(F.replace(txt(0), txt(1), txt(2)), s)
            case "regex_replace":
                return Value(S.regex_replace(txt(), raw[1], raw[2]), s)
            case "extract":
                return Value(S.extract(txt(), raw[1], raw[2] if len(args) > 2 else 0), s)
            case "first" | "last":
                return self.typed(df, S.list_get(col[0], 0 if name == "first" else -1))
            case "sum":
                return Value(S.list_sum(col[0]), n)
            case "json":
                return Value(F.to_json(col[0]) if vs[0].kind in ("object", "array") else F.to_json(F.array(col[0])).substr(F.lit(2), F.char_length(F.to_json(F.array(col[0]))) - 2), s)
            case "type":
                known = {"number": "number", "string": "string", "bool": "bool", "array": "array", "object": "object", "time": "number", "json": "string"}.get(vs[0].kind, "null")
                return Value(F.when(col[0].isNull(), "null").otherwise(F.lit(known)), s)
            case "int":
                return Value(col[0].try_cast("double").cast("bigint") if vs[0].kind in ("string", "json") else S.trunc(num()).cast("bigint"), n)
            case "float":
                return Value(col[0].try_cast("double"), n)
            case "string":
                return Value(col[0].cast("string"), s)
            case "slice":
                return Value(S.list_slice(col[0], raw[1], raw[2] if len(args) > 2 else None), arr)
            case "flatten":
                return Value(F.flatten(col[0]), arr)
            case "keys":
                return Value(F.array_sort(F.json_object_keys(col[0]) if vs[0].kind in ("string", "json") else F.map_keys(col[0])), arr)
            case "values":
                return Value(F.transform(F.array_sort(F.map_keys(col[0])), lambda k: col[0][k]), arr)
            case "parse_json":
                return Value(F.when(F.try_parse_json(txt()).isNotNull(), txt()), "json")
            case "split":
                return Value(S.split(txt(), raw[1]), arr)
            case "date_part":
                part = {"day_of_week": "dayofweek", "day_of_year": "dayofyear", "iso_week": "week", "iso_year": "isoyear"}.get(raw[1], raw[1])
                return Value(S.date_part(part, self.moment(vs[0])), n)
            case "format_time":
                return Value(S.format_time(self.moment(vs[0]), raw[1].replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")), s)
            case "index_of":
                return Value(S.index_of(col[0], col[1]), n)
            case "sort" | "unique":
                return Value(F.array_sort(col[0]) if name == "sort" else F.array_distinct(col[0]), arr)
            case "join":
                return Value(F.array_join(col[0], raw[1]), s)
            case "bin":
                return Value(S.sub(num(0), S.mod(num(0), num(1))), n)
            case "as_time":
                return Value(S.mul(num(0), F.lit(UNITS[raw[1]] / UNITS[self.c.roles.unit])).cast("bigint"), n)
            case "to_seconds":
                return Value(S.div(num(0), F.lit(1e6 / UNITS[self.c.roles.unit])), n)
            case "now":
                import time

                return Value(F.lit(self.c.now() if self.c.now else int(time.time() * 1e6 / UNITS[self.c.roles.unit])), n)
        raise QueryError(f"unknown function {name!r}")

    def moment(self, v: Value) -> Column:
        return v.col if v.kind == "time" else S.from_micros(self.number(v) * int(UNITS[self.c.roles.unit]))

    def _element(self, df: DataFrame, p: Node, e: Node, x: Column) -> Value:
        # The element's type: fields of structs and scalars alike compare by their own kind.
        xs = self.value(df, p).col
        kind = kind_of(df.select(F.get(xs, F.lit(0)).alias("x")).dtypes[0][1])
        return self.value(df, e, x) if kind == "object" else self.value_with(df, e, x, kind)

    def value_with(self, df: DataFrame, e: Node, x: Column, kind: str) -> Value:
        if e == ("current", []):
            return Value(x, kind)
        if e[0] == "cmp":
            return Value(self.compare(e[1], self.value_with(df, e[2], x, kind), self.value_with(df, e[3], x, kind)), "bool")
        if e[0] in ("and", "or"):
            a, b = (self.boolean(self.value_with(df, y, x, kind)) for y in e[1:3])
            return Value(a & b if e[0] == "and" else a | b, "bool")
        if e[0] == "not":
            return Value(~self.boolean(self.value_with(df, e[1], x, kind)), "bool")
        return self.value(df, e, x)

    def const(self, df: DataFrame, e: Node | None) -> int | float | None:
        """A number known at compile time."""
        if e is None:
            return None
        match e[0]:
            case "lit":
                return e[1]
            case "param":
                return self.c.params[e[1]]
            case "duration":
                t = float(e[1]) * UNITS[e[2]] / UNITS[self.c.roles.unit]
                return int(t) if t == int(t) else t
            case "neg":
                return -self.const(df, e[1])
            case "arith":
                a, b = self.const(df, e[2]), self.const(df, e[3])
                return {"+": a + b, "-": a - b, "*": a * b}[e[1]] if e[1] in "+-*" else a / b
        raise QueryError("a number, duration or parameter is needed here")

    # -- helpers ------------------------------------------------------------

    def named(self, df: DataFrame, items: list[tuple[str | None, Node]]) -> list[Column]:
        out = []
        for name, e in items:
            if e[0] == "path" and "*" in e[1]:
                out += [F.col(f"{p}").alias(p) for p in self.wild(df, e[1])]
                continue
            v = self.value(df, e)
            label = name or v.name or (entry_name(e) if e[0] == "call" else None)
            if label is None:
                raise QueryError(f"{text_of(e)} needs a name")
            out.append(v.col.alias(label))
        return out

    def wild(self, df: DataFrame, keys: list[str]) -> list[str]:
        """Struct leaves that a pattern with ``*`` names."""
        found = [([], df.schema)]
        for k in keys:
            nxt = []
            for at, kind in found:
                for f in getattr(kind, "fields", []):
                    if k in ("*", f.name):
                        nxt.append(([*at, f.name], f.dataType))
            found = nxt
        return [".".join(at) for at, _ in found]

    def subqueries(self, state: _State, e: Node) -> tuple[_State, Node]:
        """Scalar sub-queries and arrows become columns of the rows; their joins are added here."""
        if not isinstance(e, tuple):
            return state, e
        if e[0] == "scalar" and _has_outer(e[1]):
            return self.correlated(state, e[1])
        if e[0] == "scalar":
            side = self.run(e[1], None)
            name = f"_q{len(state.temp)}"
            one = side.select(F.col(side.columns[0]).alias(name))
            one = one.agg(F.when(F.count(F.lit(1)) <= 1, F.first(name)).otherwise(F.raise_error(F.lit("a scalar sub-query gave several rows"))).alias(name))
            return state.but(df=state.df.crossJoin(F.broadcast(one)), temp=[*state.temp, name]), ("path", [name])  # one row
        if e[0] == "arrow":
            side = self.source(("table", e[2]))
            state, key = self.subqueries(state, e[1])
            name, target = f"_q{len(state.temp)}", ".".join(e[3])
            rows = side.select(F.col(side.columns[0]).alias("_key"), F.col(target).alias(name)).distinct()
            one = rows.groupBy("_key").agg(F.when(F.count(F.lit(1)) <= 1, F.first(name)).otherwise(F.raise_error(F.lit(f"rows disagree on {target}"))).alias(name))
            df = state.df.join(one, self.value(state.df, key).col == F.col("_key"), "left").drop("_key")
            return state.but(df=df, temp=[*state.temp, name]), ("path", [name])
        out = []
        for x in e:
            if isinstance(x, tuple) and x and isinstance(x[0], str):
                state, x = self.subqueries(state, x)
            elif isinstance(x, list):
                xs = []
                for y in x:
                    if isinstance(y, tuple) and y and isinstance(y[0], str):
                        state, y = self.subqueries(state, y)
                    xs.append(y)
                x = xs
            out.append(x)
        return state, tuple(out)

    def correlated(self, state: _State, stages: list[Node]) -> tuple[_State, Node]:
        """An aggregate of the rows that agree with the enclosing row on keys: grouped by the keys once, then joined."""
        keys: list[tuple[Node, Node]] = []
        inner: list[Node] = []
        for stage in stages:
            if stage[0] == "where":
                for term in _conjuncts(stage[1]):
                    sides = term[2:] if term[0] == "cmp" and term[1] == "==" else ()
                    own = [x for x in sides if x[0] == "outer"]
                    if len(own) == 1:
                        keys.append((next(x for x in sides if x[0] != "outer"), ("path", own[0][1])))
                    elif _has_outer(term):
                        raise QueryError("a sub-query may be correlated by == alone")
                    else:
                        inner.append(("where", term))
            else:
                inner.append(stage)
        if not keys or inner[-1][0] != "group" or inner[-1][1] or len(inner[-1][2]) != 1:
            raise QueryError("a correlated sub-query ends in an agg of one entry")
        entry, aggregate_of = inner[-1][2][0]
        name = f"_q{len(state.temp)}"
        grouped = ("group", [(f"_c{i}", k) for i, (k, _) in enumerate(keys)], [(name, aggregate_of)])
        side = self.run([*inner[:-1], grouped], None)
        on = F.lit(True)
        for i, (_, outer) in enumerate(keys):
            on = on & (self.value(state.df, outer).col == F.col(f"_c{i}"))
        df = state.df.join(side, on, "left").drop(*[f"_c{i}" for i in range(len(keys))])
        if aggregate_of[0] == "call" and aggregate_of[1] in ("count", "count_if", "count_distinct"):
            df = df.withColumn(name, F.coalesce(name, F.lit(0)))
        return state.but(df=df, temp=[*state.temp, name]), ("path", [name])

    def items_with(self, state: _State, items: list[tuple[str | None, Node]]) -> tuple[_State, list]:
        out = []
        for name, e in items:
            state, e = self.subqueries(state, e)
            out.append((name, e))
        return state, out

    def sort_columns(self, df: DataFrame, keys: list[tuple[Node, bool, bool]]) -> list[Column]:
        out = []
        for e, down, first in keys:
            c = self.value(df, e).col
            out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        return out

    # -- stages -------------------------------------------------------------

    def _where(self, state: _State, e: Node) -> _State:
        terms = _conjuncts(e)
        for t in terms:
            flip = t[0] == "not" and t[1][0] == "in_query"
            if t[0] == "in_query" or flip:
                inner = t[1] if flip else t
                side = self.run(inner[2], None)
                key = self.value(state.df, inner[1]).col
                rows = side.select(F.col(side.columns[0]).alias("_side")).where("_side is not null")
                df = state.df.join(rows, key == F.col("_side"), "left_anti" if flip else "left_semi")
                state = state.but(df=df.where(self.value(df, inner[1]).col.isNotNull()) if flip else df)
                continue
            state, t = self.subqueries(state, t)
            keep = self.boolean(self.value(state.df, t))
            wide = state.wide.where(keep) if state.wide is not None and not state.temp else None
            state = state.but(df=state.df.where(keep).drop(*state.temp), temp=[], wide=wide)
        return state

    def _select(self, state: _State, items) -> _State:
        state, items = self.items_with(state, items)
        columns = self.named(state.df, items)
        names = state.df.select(*columns).columns
        hidden = [c for c in state.order if c not in names and c in state.df.columns]
        return state.but(df=state.df.select(*columns), order=[c for c in state.order if c in names] if not hidden else [c for c in state.order if c in names], temp=[])

    def _derive(self, state: _State, items) -> _State:
        for name, e in items:
            state, e = self.subqueries(state, e)
            v = self.value(state.df, e)
            state = state.but(df=state.df.withColumn(name or entry_name(e), v.col).drop(*state.temp), temp=[])
        return state

    def _drop(self, state: _State, paths) -> _State:
        return state.but(df=state.df.drop(*[".".join(p[1]) for p in paths]))

    def _rename(self, state: _State, pairs) -> _State:
        names = {".".join(p[1]): new for new, p in pairs}
        out = [names.get(c, c) for c in state.df.columns]
        if len(set(out)) < len(out):
            raise QueryError("two columns would have one name")
        return state.but(df=state.df.toDF(*out), order=[names.get(c, c) for c in state.order])

    def _distinct(self, state: _State, items) -> _State:
        return state.but(df=state.df.select(*self.named(state.df, items)).distinct(), order=[])

    def _sort(self, state: _State, keys) -> _State:
        own = self.sort_columns(state.df, keys)
        return state.but(df=state.df.orderBy(*own, *state.order), sorted=[*own, *[F.col(c) for c in state.order]])

    def _ordered(self, state: _State) -> DataFrame:
        if state.sorted:
            return state.df
        return state.df.orderBy(*state.order) if state.order else state.df

    def _take(self, state: _State, n) -> _State:
        return state.but(df=self._ordered(state).limit(int(self.const(state.df, n))))

    def _skip(self, state: _State, n) -> _State:
        return state.but(df=self._ordered(state).offset(int(self.const(state.df, n))))

    def _range(self, state: _State, a, b) -> _State:
        low, high = int(self.const(state.df, a)), int(self.const(state.df, b))
        if not 1 <= low <= high:
            raise QueryError("take a..b needs 1 <= a <= b")
        return state.but(df=self._ordered(state).offset(low - 1).limit(high - low + 1))

    def _take_by(self, state: _State, n, keys, sort) -> _State:
        order = self.sort_columns(state.df, sort) + [F.col(c) for c in state.order]
        w = Window.partitionBy(*[self.value(state.df, k).col for k in keys]).orderBy(*(order or [F.lit(0)]))
        return state.but(df=state.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= int(self.const(state.df, n))).drop("_n"))

    def _sample(self, state: _State, n, percent, seed) -> _State:
        h = F.xxhash64(*(state.order or state.df.columns), F.lit(int(self.const(state.df, seed))))
        amount = self.const(state.df, n)
        if percent:
            return state.but(df=state.df.where(F.pmod(h, F.lit(1_000_000)) < int(amount * 10_000)))
        return state.but(df=state.df.orderBy(h, *state.order).limit(int(amount)))

    def aggregates(self, state: _State, df: DataFrame, block, extra: dict[str, Column]) -> list[tuple[str, Column]]:
        """Entries of a block as (name, aggregate expression)."""
        pos = F.struct(*state.order) if len(state.order) > 1 else F.col(state.order[0]) if state.order else F.monotonically_increasing_id()

        def build(e: Node) -> Column:
            if e[0] == "call" and e[1] in OCCUPANCY:
                return extra[e[1]]
            if e[0] == "call" and e[1] in _AGG_NAMES and not (e[1] in ("min", "max") and (len(e[2]) > 1 or any(_has_aggregate(a) for a in e[2]))):
                name, args = e[1], e[2]
                if name == "count":
                    return aggregate("count_valid", self.value(df, args[0]).col) if args else aggregate("count")
                if name == "count_if":
                    return aggregate("count_if", self.boolean(self.value(df, args[0])))
                v = self.value(df, args[0])
                col = self.number(v) if v.kind == "json" or name in ("sum", "mean", "var", "std", "quantile") else v.col
                if name == "quantile":
                    return aggregate("quantile", col, param=float(self.const(df, args[1])))
                if name in ("arg_max", "arg_min"):
                    one = pos if len(state.order) == 1 and kind_of(dict(df.dtypes)[state.order[0]]) == "number" else None
                    return aggregate(name, col, by=self.value(df, args[1]).col, pos=one)
                if name == "histogram":
                    return F.histogram_numeric(col, F.lit(64))
                if name == "mean" and df.select(col.alias("x")).dtypes[0][1] in ("double", "float"):
                    return aggregate("exact_mean", col)
                return aggregate(name, col, pos=pos) if name in ("first", "last", "collect") else aggregate(name, col)
            match e[0]:
                case "arith":
                    return {"+": S.add, "-": S.sub, "*": S.mul, "/": S.div, "//": S.floordiv, "%": S.mod}[e[1]](build(e[2]), build(e[3]))
                case "call" if e[1] == "coalesce":
                    return F.coalesce(*[build(a) for a in e[2]])
                case "call" if e[1] in S.SCALARS:
                    return S.SCALARS[e[1]](*[build(a) if a[0] != "lit" or e[1] in ("min", "max") else a[1] for a in e[2]])
                case "neg":
                    return -build(e[1])
                case "lit" | "param" | "duration":
                    return self.value(df, e).col
            raise QueryError(f"{text_of(e)} is not an aggregate")

        out = [(name or entry_name(e), build(e)) for name, e in block]
        if len({n for n, _ in out}) < len(out):
            raise QueryError("two entries with one name")
        return out

    def _group(self, state: _State, keys, block) -> _State:
        state, keys = self.items_with(state, keys)
        block = [(n, self._expanded_expr(e)) for n, e in block]
        df, b = state.df, state.bucket
        wanted = {x for _, e in block for x in _calls(e) if x in OCCUPANCY}
        key_columns = self.named(df, keys)
        names = df.select(*key_columns).columns if key_columns else []
        if b:
            width, every, at = int(self.const(df, b["width"])), self.const(df, b.get("every")), int(self.const(df, b.get("at")) or 0)
            if width <= 0 or (every is not None and every <= 0):
                raise QueryError("bucket needs a positive width")
            df = timeseries.hopping(df, self.c.roles.time, width, int(every) if every else None, at, "_bucket") if kind_of(dict(df.dtypes)[self.c.roles.time]) == "number" else timeseries.hopping(df.withColumn("_t", S.micros(self.c.roles.time)), "_t", width, int(every) if every else None, at, "_bucket")
            key_columns = [F.col("_bucket").alias(b["name"]), *key_columns]
            names = [b["name"], *names]
        extra = {}
        if wanted:
            if b and b.get("every"):
                raise QueryError("occupancy aggregates do not run after a hopping bucket")
            rows, (lo, hi) = (state.wide, state.clip) if state.wide is not None else (state.df, (None, None))
            base = rows.select(*self.named(rows, keys), F.col(self.c.roles.time).alias("_ts"), F.col(self.c.roles.duration).alias("_dur"))
            plain = [n for n in names if not (b and n == b["name"])]
            occupied = occupancy.occupancy(base, plain, "_ts", "_dur", bucket=int(self.const(df, b["width"])) if b else None, low=lo, high=hi)
            occupied = occupied.withColumnsRenamed({"bucket": b["name"]} if b else {})
            rename = {n: f"_k{i}" for i, n in enumerate(names)}
            occupied = occupied.select(*[F.col(n).alias(k) for n, k in rename.items()], *[F.col(w).alias(f"_o_{w}") for w in OCCUPANCY])
            flat = df.select(*[c for c in df.columns], *[c.alias(f"_g{i}") for i, c in enumerate(key_columns)]) if names else df
            if names:
                on = F.lit(True)
                for i, k in enumerate(rename.values()):
                    on = on & F.col(f"_g{i}").eqNullSafe(F.col(k))
                df = flat.join(occupied, on, "full" if b or lo is not None else "left").select(*flat.columns, *[F.coalesce(F.col(f"_g{i}"), F.col(k)).alias(f"_h{i}") for i, k in enumerate(rename.values())], *[f"_o_{w}" for w in OCCUPANCY])
                key_columns = [F.col(f"_h{i}").alias(n) for i, n in enumerate(names)]
            else:
                df = df.crossJoin(F.broadcast(occupied))  # one row
            extra = {w: F.first(f"_o_{w}", True) for w in OCCUPANCY}
        made = [c.alias(n) for n, c in self.aggregates(state, df, block, extra)]
        out = df.groupBy(*key_columns).agg(*made) if key_columns else df.agg(*made)
        if b and "fill" in b:
            out = self._filled(out, b, names, block)
        out = out.orderBy(*[F.col(f"`{n}`").asc_nulls_last() for n in names]) if names else out
        return _State(out, [])

    def _filled(self, out: DataFrame, b: dict, names: list[str], block) -> DataFrame:
        name, step = b["name"], int(self.const(out, b.get("every")) or self.const(out, b["width"]))
        groups = [n for n in names if n != name]
        low, high = self.const(out, b.get("low")), self.const(out, b.get("high"))
        at = int(self.const(out, b.get("at")) or 0)
        if low is not None and low > high:
            raise QueryError("fill from lo to hi needs lo <= hi")
        span = out.agg(F.min(name).alias("_lo"), F.max(name).alias("_hi"))  # one row
        if low is not None:
            floor = lambda v: int((v - at) // step * step + at)
            span = span.select(F.lit(floor(low)).cast("bigint").alias("_lo"), F.lit(floor(high)).cast("bigint").alias("_hi"))
        grid = (out.select(*groups).distinct().crossJoin(F.broadcast(span)) if groups else span).select(*groups, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("bigint"))).alias(name))
        have = out.withColumn("_have", F.lit(True))
        right = have.select(*[F.col(n).alias(f"_f{i}") for i, n in enumerate(names)], *[c for c in have.columns if c not in names])
        on = F.lit(True)
        for i, n in enumerate(names):
            on = on & grid[n].eqNullSafe(F.col(f"_f{i}"))
        full = grid.join(right, on, "full").select(*[F.coalesce(grid[n], F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)], *[c for c in have.columns if c not in names])
        w = Window.partitionBy(*groups).orderBy(name)
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        columns = []
        for entry, e in block:
            label = entry or entry_name(e)
            c = F.col(label)
            added = F.col("_have").isNull()
            if e[0] == "call" and e[1] in ("count", "count_if", "count_distinct"):
                c = F.coalesce(c, F.lit(0))
            elif b["fill"] == "forward":
                c = F.when(added, F.last(c, True).over(back)).otherwise(c)
            elif b["fill"] == "linear":
                known = F.when(c.isNotNull(), F.col(name))
                a, z = F.last(known, True).over(back), F.first(known, True).over(ahead)
                x, y = F.last(c, True).over(back), F.first(c, True).over(ahead)
                c = F.when(added, x + (y - x) * (F.col(name) - a) / (z - a)).otherwise(c)
            columns.append(c.alias(label))
        return full.select(*names, *columns)

    def _expanded_expr(self, e: Node) -> Node:
        """Expression macros inside a block."""
        if not isinstance(e, tuple):
            return e
        if e[0] == "call" and e[1] in self.macros and self.macros[e[1]][3][0] == "expr":
            _, _, params, body = self.macros[e[1]]
            return self._expanded_expr(_substitute(body[1], dict(zip(params, e[2], strict=True))))
        return tuple([self._expanded_expr(y) if isinstance(y, tuple) else y for y in x] if isinstance(x, list) else self._expanded_expr(x) if isinstance(x, tuple) else x for x in e)

    def _window(self, state: _State, keys, sort, block) -> _State:
        df = state.df
        order = self.sort_columns(df, sort)
        ties = [F.col(c) for c in state.order]
        parts = [self.value(df, k).col for k in keys]
        w = Window.partitionBy(*parts).orderBy(*order, *ties) if order or ties else Window.partitionBy(*parts).orderBy(F.lit(0))
        peers = Window.partitionBy(*parts).orderBy(*order) if order else Window.partitionBy(*parts).orderBy(F.lit(0))
        pos = F.struct(*state.order) if state.order else F.lit(0)

        def build(e: Node) -> Column:
            if e[0] == "over":
                n = self.const(df, e[2])
                frame = w.rowsBetween(-(int(n) - 1), 0) if e[3] else Window.partitionBy(*parts).orderBy(*[self.number(self.value(df, sort[0][0]))]).rangeBetween(-int(n), 0)
                return framed(e[1], frame)
            if e[0] == "call":
                name, args = e[1], e[2]
                arg = lambda i=0: self.value(df, args[i]).col
                match name:
                    case "row_number" | "ntile" | "running_count":
                        return W.WINDOWS[name](w, n=int(self.const(df, args[0])) if args else 1)
                    case "rank" | "dense_rank" | "percent_rank" | "cume_dist":
                        return W.WINDOWS[name](peers)
                    case "lag" | "lead":
                        return W.WINDOWS[name](w, arg(), n=int(self.const(df, args[1])) if len(args) > 1 else 1, default=self.const(df, args[2]) if len(args) > 2 else None)
                    case "running_sum" | "running_min" | "running_max" | "running_mean" | "fill_forward":
                        return W.WINDOWS[name](w, arg())
                    case "nth":
                        return W.WINDOWS["nth_value"](w, arg(), n=int(self.const(df, args[1])))
                    case "first" | "last":
                        return (F.first if name == "first" else F.last)(arg(), True).over(W.whole(w))
                    case _ if name in _AGG_NAMES:
                        return framed(e, W.whole(w))
                    case _ if name in S.SCALARS:
                        return S.SCALARS[name](*[build(a) if a[0] != "lit" else a[1] for a in args])
                raise QueryError(f"unknown window function {name!r}")
            if e[0] == "arith":
                return {"+": S.add, "-": S.sub, "*": S.mul, "/": S.div, "//": S.floordiv, "%": S.mod}[e[1]](build(e[2]), build(e[3]))
            if e[0] == "cmp":
                a, b = build(e[2]), build(e[3])
                return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
            return self.value(df, e).col

        def framed(e: Node, frame) -> Column:
            name, args = e[1], e[2]
            v = self.value(df, args[0]).col if args else None
            if name == "count":
                return (F.count(v) if args else F.count(F.lit(1))).over(frame)
            if name == "count_distinct":
                return F.size(F.collect_set(v).over(frame)).cast("bigint")
            if name == "collect":
                return F.collect_list(v).over(frame)
            if name == "quantile":
                return F.percentile(v, float(self.const(df, args[1]))).over(frame)
            if name in ("arg_max", "arg_min"):
                return aggregate(name, v, by=self.value(df, args[1]).col).over(frame)
            return aggregate(name, v, pos=pos).over(frame) if name in ("first", "last") else AGGREGATES[name](v).over(frame)

        return state.but(df=df.withColumns({name or entry_name(e): build(e) for name, e in block}))

    def _session(self, state: _State, keys, gap, longest, name) -> _State:
        names = [".".join(p[1]) for p in keys]
        df, t = state.df, self.c.roles.time
        duration = self.c.roles.duration if self.c.roles.duration in df.columns else None
        if kind_of(dict(df.dtypes)[t]) == "time":
            df, t = df.withColumn("_t", S.micros(t)), "_t"
        out = timeseries.sessions(df, names, t, int(self.const(df, gap)), duration, int(self.const(df, longest)) if longest else None, state.order, name)
        return state.but(df=out.drop("_t"))

    def _expand(self, state: _State, path, name, index, keep) -> _State:
        df = state.df
        xs = self.value(df, path).col
        wanted = F.when(F.size(xs) == 0, F.lit(None)).otherwise(xs)
        rows = df.withColumn("_x", wanted)
        if not keep:
            rows = rows.where(xs.isNull() | (F.size(xs) > 0))
        others = [c for c in df.columns if c != name]
        out = rows.select(*others, F.posexplode_outer("_x").alias("_i", name))
        return state.but(df=out.withColumnRenamed("_i", index) if index else out.drop("_i"))

    def _parse(self, state: _State, path, pattern) -> _State:
        names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
        plain = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
        text = self.string(self.value(state.df, path))
        # A group's number counts all capturing groups before it.
        at, numbers = 0, {}
        for m in re.finditer(r"\\.|\((?!\?)|\(\?P?<(?![=!])(\w+)>", pattern):
            if m.group().startswith("\\"):
                continue
            at += 1
            if m.group(1):
                numbers[m.group(1)] = at
        return state.but(df=state.df.withColumns({n: S.extract(text, plain, numbers[n]) for n in names}))

    def _pivot(self, state: _State, key, values, block) -> _State:
        k = ".".join(key[1])
        used = {k} | {p for _, e in block for p in _paths(e)}
        index = [c for c in state.df.columns if c not in used]
        if values is None:
            found = [r[0] for r in state.df.select(F.col(k)).where(F.col(k).isNotNull()).distinct().orderBy(k).limit(1025).collect()]
            if len(found) > 1024:
                raise QueryError("pivot has more than 1024 values; name them with in")
            values = [(v, str(v)) for v in found]
        made = self.aggregates(state, state.df, block, {})
        many = len(made) > 1
        out = state.df.groupBy(*index).pivot(k, [v for v, _ in values]).agg(*[c.alias(n) for n, c in made])
        columns = [F.col(f"`{v}_{n}`" if many else f"`{v}`").alias(f"{n}.{label}") for n, _ in made for v, label in values]
        return _State(out.select(*index, *columns), [c for c in state.order if c in index])

    def _unpivot(self, state: _State, fields, key, value) -> _State:
        names = []
        for p in fields:
            names += self.wild(state.df, p[1]) if "*" in p[1] else [".".join(p[1])]
        kinds = {dict(state.df.dtypes).get(n, "string") for n in names}
        kind = kinds.pop() if len(kinds) == 1 else "double" if all(kind_of(k) == "number" for k in kinds) else "string"
        ids = [c for c in state.df.columns if c not in names]
        rows = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).cast(kind).alias(value)) for n in names])
        return state.but(df=state.df.select(*ids, F.explode(rows).alias("_u")).select(*ids, f"_u.{key}", f"_u.{value}"))

    def _lookup(self, state: _State, side, keys, kind, options) -> _State:
        right = self.source(side)
        left_on, right_on = [".".join(a[1]) for a, _ in keys], [".".join(b[1]) for _, b in keys]
        df = state.df
        if kind in ("left", "inner", "anti"):
            out = joins.lookup(df, right, left_on, right_on, kind)
        elif kind == "asof":
            a, b = (".".join(p[1]) for p in options["time"])
            sided = right.withColumnsRenamed(dict(zip(right_on, left_on, strict=True)))
            out = joins.asof(df, sided, a, left_on, options.get("direction", "backward"), self.const(df, options.get("within")), b, suffix="_side").drop(f"{b}_side")
        else:
            r = self.c.roles
            sided = right.withColumnsRenamed(dict(zip(right_on, left_on, strict=True))).withColumnsRenamed({r.time: "_rs"}).withColumn("_re", F.col("_rs") + F.col(r.duration)).drop(r.duration)
            whole = df.distinct() if "into" in options else df
            out = joins.overlap(whole.withColumn("_le", F.col(r.time) + F.col(r.duration)), sided, r.time, "_le", "_rs", "_re", left_on, "left").drop("_le", "_rs", "_re")
        if "into" in options:
            added = [c for c in out.columns if c not in df.columns]
            if kind == "overlap":
                out = out.groupBy(*df.columns).agg(F.collect_list(F.when(F.col(added[0]).isNotNull(), F.struct(*added))).alias(options["into"]))
                # Repeated rows each have the list.
                lists = out.select(F.struct(*df.columns).alias("_of"), options["into"])
                out = df.withColumn("_row", F.struct(*df.columns)).join(lists, F.col("_row").eqNullSafe(F.col("_of")), "left").select(*df.columns, options["into"])
            else:
                out = out.select(*df.columns, F.struct(*added).alias(options["into"]))
        return state.but(df=out)

    def _union(self, state: _State, side) -> _State:
        return state.but(df=state.df.unionByName(self.source(side), allowMissingColumns=True))

    def _call(self, state: _State, name, args) -> _State:
        if name not in self.c.table_functions:
            raise QueryError(f"unknown table function {name!r}")
        return state.but(df=self.c.table_functions[name](state.df, *[self.const(state.df, a) if a[0] != "lit" else a[1] for a in args]))

    def _time_range(self, state: _State, low, high, overlapping) -> _State:
        df, r = state.df, self.c.roles
        start = self.number(self.value(df, ("path", [r.time])))
        a, b = self.const(df, low), self.const(df, high)
        keep = F.lit(True)
        if overlapping:
            end = start + F.coalesce(self.number(self.value(df, ("path", [r.duration]))), F.lit(0))
            keep = (keep if b is None else start < b) & (F.lit(True) if a is None else end > a)
        else:
            keep = (F.lit(True) if a is None else start >= a) & (F.lit(True) if b is None else start < b)
        out = state.but(df=df.where(keep))
        if not overlapping and a is not None and b is not None and r.duration in df.columns:
            # Occupancy takes every row that overlaps the window, clipped to it.
            end = start + F.coalesce(self.number(self.value(df, ("path", [r.duration]))), F.lit(0))
            out = out.but(wide=df.where((start < b) & (end > a)), clip=(int(a), int(b)))
        return out

    def _call_tree(self, state: _State) -> _State:
        r = self.c.roles
        rows = ordering.with_row_index(state.df, state.order, "_id") if state.order else state.df.withColumn("_id", F.monotonically_increasing_id())
        tree = calltree.call_tree(rows, list(r.lane), r.time, r.duration, r.name, "_id", paths=False)
        numbered = ordering.with_row_index(tree, [*r.lane, "start", "level", "id"], "_row")
        parents = numbered.select(F.col("id").alias("_pid"), F.col("_row").alias("parent"))
        out = numbered.join(parents, F.col("parent_id") == F.col("_pid"), "left")
        return _State(out.select(*r.lane, F.col("start").alias(r.time), F.col("duration").alias(r.duration), F.col("name").alias(r.name), F.col("level").alias("depth"), F.coalesce("parent", F.lit(-1)).alias("parent")), [])

    def _bucket(self, state: _State, options) -> _State:
        return state.but(bucket=options)


@dataclass
class _State:
    df: DataFrame | None
    order: list[str]
    bucket: dict | None = None
    temp: list[str] = field(default_factory=list)
    sorted: list[Column] = field(default_factory=list)
    wide: DataFrame | None = None
    clip: tuple[int | None, int | None] = (None, None)

    def but(self, **changes) -> _State:
        return _State(**{**self.__dict__, **changes})


def _conjuncts(e: Node) -> list[Node]:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _has_outer(e) -> bool:
    if isinstance(e, tuple):
        return bool(e) and (e[0] == "outer" or any(_has_outer(x) for x in e))
    return isinstance(e, list) and any(_has_outer(x) for x in e)


def _calls(e) -> set[str]:
    out: set[str] = set()
    if isinstance(e, tuple):
        if e and e[0] == "call":
            out.add(e[1])
        for x in e:
            out |= _calls(x)
    elif isinstance(e, list):
        for x in e:
            out |= _calls(x)
    return out


def _has_aggregate(e) -> bool:
    return bool(_calls(e) & _AGG_NAMES)


def _paths(e) -> set[str]:
    out: set[str] = set()
    if isinstance(e, tuple):
        if e and e[0] == "path":
            return {".".join(e[1])}
        for x in e:
            out |= _paths(x)
    elif isinstance(e, list):
        for x in e:
            out |= _paths(x)
    return out


def _substitute(e, args: dict[str, Node]):
    """A macro's body with its parameters replaced."""
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] == "path" and len(e[1]) == 1 and e[1][0] in args:
            return args[e[1][0]]
        return tuple(_substitute(x, args) for x in e)
    if isinstance(e, list):
        return [_substitute(x, args) for x in e]
    if isinstance(e, dict):
        return {k: _substitute(v, args) for k, v in e.items()}
    return e


def compile_query(text: str, df: DataFrame | None, context: Context) -> DataFrame:
    """The DataFrame of a query over ``df`` (or over the tables that it names)."""
    return Compiler(context).query(text, df)


def explain(text: str, df: DataFrame | None, context: Context) -> str:
    """The optimised plan of a query."""
    return compile_query(text, df, context)._jdf.queryExecution().optimizedPlan().toString()
