from __future__ import annotations

import pytest

from tessera.plans.compiler import Context, Roles, compile_query, explain
from tessera.plans.syntax import QueryError, lex, parse
from tessera.udf import Registry


@pytest.fixture(scope="module")
def events(spark):
    rows = [(0, "a", 1, 1, 0, 500, 1), (1, "b", 1, 1, 1000, 500, 2), (2, "a", 1, 2, 2000, None, 3), (3, None, 2, 2, 3000, 100, 4)]
    return spark.createDataFrame(rows, "event_id long, name string, pid long, tid long, ts long, dur long, size long")


@pytest.fixture
def run(spark, events):
    def go(text, df=events, **params):
        return [tuple(r) for r in compile_query(text, df, Context(spark, {"events": events}, Roles(), ["event_id"], params)).collect()]

    return go


def test_tokens():
    assert lex("a == 250ms # note")[:3] == [("name", "a"), ("op", "=="), ("duration", ("250", "ms"))]
    assert lex(r'"\d+\.h5"')[0] == ("string", r"\d+\.h5")
    assert lex("`x.y`")[0] == ("name", "x.y")


def test_hopping_windows_start_before_the_first_row(run):
    assert run("bucket 2ms every 1ms | agg { b = sum(size), n = count() }") == [(-1000, 1, 1), (0, 3, 2), (1000, 5, 2), (2000, 7, 2), (3000, 4, 1)]


def test_bucket_alignment(run):
    assert run("bucket 2ms at 1ms | agg { n = count() }") == [(-1000, 1), (1000, 2), (3000, 1)]


def test_bucket_fill(run):
    assert run("where size != 2 | bucket 1ms fill linear | agg { n = count(), s = sum(size) }") == [(0, 1, 1), (1000, 0, 2), (2000, 1, 3), (3000, 1, 4)]


def test_group_keeps_null_key_last(run):
    assert run("group name { count(), sum(dur) }") == [("a", 2, 500), ("b", 1, 500), (None, 1, 100)]


def test_unknown_is_not_true(run):
    assert run('where name != "a" | select event_id') == [(1,)]
    assert run('where not name == "a" | select event_id') == [(1,)]
    assert run("where name == 1 | select event_id") == []


def test_arithmetic_never_fails(run):
    assert run("take 1 | select a = 1 / 0, b = 9223372036854775807 + 1, c = -7 // 2, d = -7 % 3, e = 7 % -3") == [(None, None, -4, 2, -2)]


def test_nulls_sort_last(run):
    assert [r[0] for r in run("sort dur | select event_id")][-1] == 2
    assert [r[0] for r in run("sort -dur | select event_id")][-1] == 2
    assert [r[0] for r in run("sort dur nulls first | select event_id")][0] == 2


def test_parameters_are_values(run):
    assert run("where name in $n | select event_id", n=["a"]) == [(0,), (2,)]
    with pytest.raises(QueryError):
        run("where size > $missing")


def test_expand_keeps_null_and_drops_empty(spark, run):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "event_id long, xs array<long>")
    assert sorted(run("expand xs as x | select event_id, x", df), key=str) == [(1, 1), (1, 2), (3, None)]
    assert (2, None) in run("expand xs as x keep_empty | select event_id, x", df)


def test_call_tree(spark, run):
    df = spark.createDataFrame([(0, "f", 1, 1, 0, 100), (1, "g", 1, 1, 10, 20), (2, "h", 1, 1, 12, 5), (3, "g", 1, 1, 50, 10), (4, "k", 1, 1, 100, 5)], "event_id long, name string, pid long, tid long, ts long, dur long")
    assert [(r[4], r[5], r[6]) for r in sorted(run("call_tree", df), key=lambda r: r[2])] == [("f", 0, -1), ("g", 1, 0), ("h", 2, 1), ("g", 1, 0), ("k", 0, -1)]


def test_lookup_conflict_is_an_error(spark, events):
    side = spark.createDataFrame([("a", 1), ("a", 2)], "name string, v long")
    with pytest.raises(Exception, match="disagree"):
        compile_query("lookup side on name", events, Context(spark, {"side": side}, Roles(), ["event_id"])).collect()


def test_user_functions(spark, events):
    reg = Registry()

    @reg.expression("my.twice")
    def twice(x):
        return x * 2

    @reg.batch("my.loud", "string")
    def loud(x):
        return x.str.upper()

    @reg.table("my.head")
    def head(df, n):
        return df.orderBy("event_id").limit(n)

    c = Context(spark, {}, Roles(), ["event_id"], {}, reg.scalars, reg.tables)
    got = compile_query("call my.head(2) | derive t = my.twice(size), l = my.loud(name) | select t, l", events, c).collect()
    assert [tuple(r) for r in got] == [(2, "A"), (4, "B")]


@pytest.mark.parametrize("text", ["where", "select (", "take x", "group { ", "lookup", "where a ==", "bucket 1s", "sort a | nothing(1)", "rename x = name | rename x = pid | rename ts = x, ts2 = ts, ts = tid"])
def test_errors(run, text):
    with pytest.raises(QueryError):
        run(text)


def test_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = compile_query("where o_totalprice > 1000 | select o_orderkey", df, Context(spark))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan
    assert "Filter" in explain("where o_totalprice > 1000", df, Context(spark))


def test_declarations():
    decls, stages = parse("let a = from t | where x; def f(y) = y + 1; source s { r = from t | take 1; def g = z } from a | derive q = f(1)")
    assert [d[:2] for d in decls] == [("let", "a"), ("def", "f"), ("let", "s.r"), ("def", "g")]
    assert stages[0][0] == "from"


def test_occupancy_is_clipped_to_a_leading_window(spark, run):
    df = spark.createDataFrame([(0, "a", 1, 1, 0, 100, 1), (1, "a", 1, 1, 50, 100, 1), (2, "b", 1, 1, 500, 10, 1)], "event_id long, name string, pid long, tid long, ts long, dur long, size long")
    assert run("time_range 40 .. 120 | agg { b = busy(), u = utilization(), n = count() }", df) == [(80, 1.0, 1)]
    assert run('where name == "a" | time_range 40 .. 120 | group name { b = busy(), a = active() }', df) == [("a", 80, 2)]
    assert run("agg { b = busy(), c = concurrency() }", df) == [(160, 210 / 160)]


def test_mean_of_equal_values_is_that_value(spark):
    """A row at its group's mean is not above it, in whatever order the values were added."""
    rows = [(100 * n + i, n, sign * n / 10) for n in range(1, 40) for i, sign in enumerate([1 if n % 2 else -1] * n)]
    c = Context(spark, {"t": spark.createDataFrame(rows, "event_id long, tid long, v double").repartition(5)}, Roles(), ["event_id"])
    mean = "(from t | where tid == ^.tid | agg { m = mean(v) })"
    assert compile_query(f"from t | where v > {mean} or v < {mean} | select event_id", None, c).collect() == []
