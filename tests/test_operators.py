from __future__ import annotations

import collections
import math
import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.facade import Columns
from tessera.frame import Frame
from tessera.functions.aggregates import aggregate
from tessera.functions.scalar import SCALARS as S
from tessera.functions.windows import decay
from tessera.operators import calltree, joins, occupancy, ordering, sketches, timeseries
from tessera.udf import fold


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_scalar_edges(spark):
    one = spark.range(1)
    got = one.select(
        S["floordiv"](F.lit(-7), F.lit(2)), S["mod"](F.lit(7), F.lit(-3)), S["div"](F.lit(1), F.lit(0)), S["min"](F.lit(1), F.lit(None).cast("int")),
        S["zfill"](F.lit("-5"), 4), S["rfind"](F.lit("abcabc"), "bc"), S["extract"](F.lit("x"), "(y)", 1), S["like"](F.lit("a_b"), "a!_b", "!"), S["like"](F.lit("axb"), "a!_b", "!"),
        S["lower"](F.lit("ÀB")), S["title"](F.lit("hello wORLD x")), S["list_get"](F.array(F.lit(1), F.lit(2)), -1), S["count_text"](F.lit("aaa"), ""),
    ).first()
    assert tuple(got) == (-4, -2, None, None, "-005", 4, None, True, False, "Àb", "Hello World X", 2, 4)


def test_fnv1a(spark):
    def want(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    words = ["", "a", "foobar", "größe", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(S["fnv1a"](F.col("w"))).collect()] == [want(w) for w in words]


def test_text_functions_in_batches(spark):
    df = spark.createDataFrame([("é one two three",), (None,)], "t string")
    got = df.select(S["normalize"](F.col("t")), S["wrap"](F.col("t"), 8), S["translate"](F.col("t"), {"o": "00"})).collect()
    assert got[0][0].startswith("é") and got[0][1] == ["é one", "two", "three"] or got[0][1][0].endswith("one")
    assert "00ne" in got[0][2] and tuple(got[1]) == (None, None, None)


@pytest.mark.parametrize("small", [ordering.SMALL, 20])
def test_row_index_and_running_total(spark, small):
    rows = [(i, random.Random(i).randrange(50), None if i % 7 == 0 else i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v long").repartition(5)
    got = {r["id"]: r["index"] for r in ordering.with_row_index(df, ["k", "id"], small=small).collect()}
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want
    total, sums = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v or 0
        sums[i] = None if v is None else total
    assert {r["id"]: r["running"] for r in ordering.running_total(df, ["k", "id"], "v", small=small).collect()} == sums


def test_ranges_of_all_keys(spark):
    """A constant first key, nulls and texts with a common beginning do not end up in one range."""
    df = spark.range(4000).selectExpr("1 as a", "if(id % 10 = 0, null, concat('common/prefix/', lpad(id, 6, '0'))) as b", "id", "timestamp_micros(id) as t").repartition(4)
    order = ["a", "b", "t"]
    cut = ordering.ranged(df, order, 4000, 200)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 800
    want = sorted(range(4000), key=lambda i: (i % 10 == 0, i))
    found = ordering.with_row_index(df, order, small=200).select("index", "id").collect()
    assert {r["index"]: r["id"] for r in found} == dict(enumerate(want))
    assert ordering.with_row_index(df.limit(0), order, small=-1).count() == 0


def test_sort_by(spark):
    rows = [(i, random.Random(i).choice([None, "x", "y", "z"]), random.Random(-i).randrange(5)) for i in range(300)]
    f = Frame(spark.createDataFrame(rows, "id long, k string, v long").repartition(7), ["id"])
    got = [r["id"] for r in f.sort_by(["k", "v"], [True, False]).df.collect()]
    rank = {"z": 0, "y": 1, "x": 2, None: 3}
    assert got == [r[0] for r in sorted(rows, key=lambda r: (rank[r[1]], r[2], r[0]))]


def test_asof_rules(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", None), (3, None, 10), (4, "b", 1)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 9, 1, "x"), ("a", 9, 2, "y"), ("a", 12, 3, "z"), (None, 4, 4, "n"), ("b", 5, 5, "w")], "k string, t long, n long, v string")
    def pick(direction, **o):
        return dict(values(joins.asof(left, right, "t", ["k"], direction, key=["n"], **o), "id", "v"))

    assert pick("backward") == {1: "y", 2: None, 3: "n", 4: None}
    assert pick("forward") == {1: "z", 2: None, 3: None, 4: "w"}
    assert pick("nearest") == {1: "y", 2: None, 3: "n", 4: "w"}
    assert pick("nearest", tolerance=3) == {1: "y", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("width", [None, 1.0, 7.0, 1000.0])
def test_interval_and_overlap_against_all_pairs(spark, width):
    r = random.Random(3)
    a = [(i, r.randrange(100), r.randrange(1, 30)) for i in range(60)]
    b = [(i, r.randrange(100), r.randrange(0, 40)) for i in range(50)]
    left = spark.createDataFrame([(i, s, s + d) for i, s, d in a], "id long, s long, e long")
    right = spark.createDataFrame([(i, s, s + d) for i, s, d in b], "rid long, lo long, hi long")
    got = set(values(joins.interval(left, right, "s", "lo", "hi", width=width), "id", "rid"))
    assert got == {(i, j) for i, s, _ in a for j, lo, d in b if lo <= s <= lo + d}
    pairs = values(joins.overlap(left, right, "s", "e", "lo", "hi", width=width), "id", "rid")
    want = {(i, j) for i, s, d in a for j, lo, q in b if s < lo + q and lo < s + d}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    outer = values(joins.overlap(left, right, "s", "e", "lo", "hi", how="left", width=width), "id", "rid")
    assert {i for i, _ in outer} == {i for i, _, _ in a}


def test_occupancy_example(spark):
    df = spark.createDataFrame([("k", 0, 10), ("k", 5, 10), ("k", 30, 5), ("k", 31, 1)], "k string, s long, d long")
    row = occupancy.occupancy(df, ["k"], "s", "d").first()
    assert (row["busy"], row["total"], row["active"]) == (20, 26, 2)
    one = spark.createDataFrame([("k", 0, 3500)], "k string, s long, d long")
    assert sorted(values(occupancy.occupancy(one, ["k"], "s", "d", bucket=1000), "bucket", "busy")) == [(0, 1000), (1000, 1000), (2000, 1000), (3000, 500)]


def test_sessions_with_longest_against_a_loop(spark):
    r = random.Random(5)
    rows, t = [], 0
    for i in range(200):
        t += r.choice([1, 2, 3, 30])
        rows.append((i, "k", t))
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = dict(values(timeseries.sessions(df, ["k"], "t", 10, longest=6, tie=["id"]), "id", "session"))
    n, first, last, want = 0, None, None, {}
    for i, _, t in rows:
        if last is None or t > last + 10 or t > first + 6:
            n, first = n + 1, t
        last = t
        want[i] = n
    assert got == want


def test_sketch_error(spark):
    r = random.Random(1)
    data = [r.lognormvariate(0, 3) * r.choice([-1, 1]) for _ in range(2000)] + [0.0] * 20
    df = spark.createDataFrame([("a", v) for v in data], "k string, v double")
    for q in (0.01, 0.25, 0.5, 0.9, 0.99):
        got = sketches.quantile(sketches.sketch(df, ["k"], "v"), ["k"], q).first()["quantile"]
        want = sorted(data)[int(q * (len(data) - 1))]
        assert math.isclose(got, want, rel_tol=0.0101, abs_tol=1e-12)


def test_ewm_against_pandas(spark):
    import pandas as pd

    v = [1.0, 4.0, 2.0, 8.0, 3.0]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(v)], "i long, g string, v double")
    out = Frame(df, ["i"]).group_transform(["g"], "ewm_mean", "v", "m", alpha=0.5).group_transform(["g"], "ewm_std", "v", "s", alpha=0.5).df.orderBy("i").collect()
    assert [r["m"] for r in out] == pytest.approx(pd.Series(v).ewm(alpha=0.5).mean().tolist())
    assert [r["s"] for r in out][1:] == pytest.approx(pd.Series(v).ewm(alpha=0.5).std().tolist()[1:])


def test_frame_rules(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 5.0), (3, "x", float("nan"))], "i long, k string, v double")
    f = Frame(df, ["i"])
    assert f.drop_nulls().df.count() == 2
    assert values(f.unique_by(["k"]).df.orderBy("i"), "i") == [(1,), (2,)]
    assert [r["i"] for r in f.tail(2).collect()] == [2, 3]
    assert f.fill_null("z").df.where("v is null").count() == 1
    with pytest.raises(ValueError, match="order"):
        Frame(df).head(1)


def test_fold_equals_an_aggregate(spark):
    df = spark.range(1000).selectExpr("id % 5 as k", "id as v").repartition(4)

    def partial(t):
        return pa.table({"s": [sum(t["v"].to_pylist())], "n": [t.num_rows]})

    def combine(t):
        return pa.table({"s": [sum(t["s"].to_pylist())], "n": [sum(t["n"].to_pylist())]})

    def finish(t):
        return pa.table({"mean": [t["s"][0].as_py() / t["n"][0].as_py()]})

    got = dict(values(fold(df, ["k"], partial, combine, finish, "s long, n long", "mean double"), "k", "mean"))
    assert got == {k: sum(range(k, 1000, 5)) / 200 for k in range(5)}


def test_columns_and_groups(spark):
    from tessera.facade import Columns, Grouped

    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", None), (4, "b", -8.0), (5, None, 5.0)], "i long, k string, v double")
    f = Frame(df, ["i"])
    both = lambda fr: [r["v"] for r in fr.df.orderBy("i").collect()]
    assert both(Columns(f).binary("rsub", 10)) == [9.0, 7.0, None, 18.0, 5.0]
    assert both(Columns(f).clip(0, 2)) == [1.0, 2.0, None, 0.0, 2.0]
    assert both(Columns(f, ["k"]).transform("cum_sum")) == [1.0, 4.0, None, -8.0, 5.0]
    assert both(Columns(f).rolling(2, "sum", 1)) == [1.0, 4.0, 3.0, -8.0, -3.0]
    g = Grouped(f, ["k"])
    assert g.ngroups() == 2 and g.get_group("a").df.count() == 2
    assert sorted(r["i"] for r in g.filter(lambda: F.sum("v") > 0).df.collect()) == [1, 2]
    assert dict(values(Columns(f, ["k"]).agg("mean").df, "k", "v")) == {"a": 2.0, "b": -8.0}
    assert both(g.transform("max"))[:2] == [3.0, 3.0]


def test_best_fit(spark):
    from tessera.operators.distributions import best_fit

    r = random.Random(2)
    rows = [("n", r.gauss(5, 5)) for _ in range(800)] + [("e", r.expovariate(0.1)) for _ in range(800)] + [("l", r.lognormvariate(1, 1)) for _ in range(800)]
    got = dict(values(best_fit(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), "k", "distribution"))
    assert got == {"n": "normal", "e": "exponential", "l": "lognormal"}


def test_series_methods(spark):
    from tessera.series import Series

    df = spark.createDataFrame([("Hello World", [3, 1, 3])], "s string, xs array<long>").selectExpr("*", "timestamp'2024-02-29 13:45:10' as t")
    s, t, xs = Series("s"), Series("t"), Series("xs")
    got = df.select(s.str.swapcase(), s.str.slice(1, 3), s.str.index("World"), s.str.get(20), s.str.cat(F.lit("x"), sep="-"), s.str.isalpha(), t.dt.is_leap_year(), t.dt.dayofweek(), t.dt.strftime("%d/%m"), xs.list.last(), F.size(xs.list.unique())).first()
    assert tuple(got) == ("hELLO wORLD", "el", 6, None, "Hello World-x", False, True, 3, "29/02", 3, 2)
    with pytest.raises(AttributeError):
        s.str.nothing


def test_whole_frames(spark):
    from tessera import facade as P

    df = spark.createDataFrame([(1, "a|b", 10, "2024-01-01 08:30:00"), (2, None, 20, "2024-01-01 23:10:00"), (3, "b", None, "2024-01-02 00:00:00")], "i long, k string, v long, t string").withColumn("t", F.col("t").cast("timestamp"))
    f = Frame(df, ["i"])
    ids = lambda fr: sorted(r["i"] for r in fr.df.collect())
    assert values(P.mask(f, 'k == "b" or v > 15').df.orderBy("i"), "mask") == [(False,), (True,), (True,)]
    assert ids(P.between_time(f, "t", "23:00", "01:00")) == [2, 3] and ids(P.at_time(f, "t", "08:30")) == [1]
    assert ids(P.first_span(f, "i", 2)) == [1, 2] and ids(P.last_span(f, "i", 2)) == [2, 3] and ids(P.truncate(f, "i", 2, 2)) == [2]
    assert P.equals(f, Frame(df.repartition(3))) and not P.equals(f, f.head(2))
    other = Frame(spark.createDataFrame([(1, 11), (2, None), (9, 5)], "i long, v long"), ["i"])
    assert values(P.update(f, other, ["i"]).df.orderBy("i"), "v") == [(11,), (20,), (None,)]
    assert values(P.compare(f.select("i", "v"), other, ["i"]).df.orderBy("i"), "i", "self", "other") == [(1, "10", "11"), (2, "20", None)]
    assert values(P.hstack(f, other).df.orderBy("i"), "i", "v_right") == [(1, 11), (2, None), (3, 5)]
    assert values(P.str_get_dummies(f, "k").df.orderBy("i"), "a", "b") == [(1, 1), (0, 0), (0, 1)]
    assert values(P.transpose(f.select("i", "v"), "i").df, "1", "2", "3") == [(10, 20, None)]


def test_overlap_of_repeated_rows_and_mixed_lengths(spark):
    r = random.Random(5)
    span = lambda: (s := r.randint(0, 3000), s + r.choice([0, 1, 5, 40, 300, 2900]))
    a = [(1, *span()) for _ in range(40)] * 3 + [(2, None, None)] * 2 + [(3, 1, 9)] * 2
    b = [(1, *span()) for _ in range(50)] + [(2, 0, 10)]
    left, right = spark.createDataFrame(a, "k int, s long, e long"), spark.createDataFrame(b, "k int, bs long, be long")
    for how in ("inner", "left"):
        got = [(x["k"], x["s"], x["e"], x["bs"], x["be"]) for x in joins.overlap(left, right, "s", "e", "bs", "be", ["k"], how).collect()]
        want = []
        for k, s, e in a:
            met = [(k, s, e, y, z) for j, y, z in b if j == k and s is not None and s < z and y < e]
            want += met or ([(k, s, e, None, None)] if how == "left" else [])
        assert collections.Counter(got) == collections.Counter(want)
    points = spark.createDataFrame([(x,) for x in [0, 5, 5, 1500, 9999, None]], "p long")
    got = [(x["p"], x["bs"], x["be"]) for x in joins.interval(points, right.drop("k"), "p", "bs", "be", outer=True).collect()]
    want = [t for p in [0, 5, 5, 1500, 9999, None] for t in ([(p, y, z) for _, y, z in b if p is not None and y <= p <= z] or [(p, None, None)])]
    assert collections.Counter(got) == collections.Counter(want)


def test_ewm_weights(spark):
    assert [decay(alpha=0.5), decay(span=3), decay(com=1), decay(halflife=1)] == [0.5] * 4
    for wrong in ({}, {"alpha": 0.5, "span": 3}, {"alpha": 1.5}, {"com": -0.5}):
        with pytest.raises(ValueError):
            decay(**wrong)
    f = Frame(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", None), (4, "a", 4.0)], "i long, k string, v double"), ["i"])
    by = [[round(r["x"], 9) for r in f.group_transform(["k"], "ewm_mean", "v", "x", **o).df.orderBy("i").collect()] for o in ({"alpha": 0.5}, {"span": 3}, {"halflife": 1})]
    assert by[0] == by[1] == by[2] == [1.0, round(2.5 / 1.5, 9), round(2.5 / 1.5, 9), round(5.25 / 1.75, 9)]


def test_exact_mean(spark):
    r = random.Random(3)
    groups = [[r.expovariate(0.02) for _ in range(300)], [round(r.gauss(0, 50), 2) for _ in range(301)], [-0.1] * 61, [-0.01, 0.01], [r.random() - 1e15 for _ in range(99)], [2.0**61] * 500, [2.0**-93, 0.0], [1e17, 1.0, -1e17]]
    rows = [(k, x) for k, xs in enumerate(groups) for x in [*xs, None]]
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, (100, None), (101, math.inf), (102, math.nan), (103, 1e-300)], "k long, v double").repartition(7)
    got = {x["k"]: x["m"] for x in df.groupBy("k").agg(aggregate("exact_mean", F.col("v")).alias("m")).collect()}
    assert [got[k] for k in range(len(groups))] == [float(sum(map(Fraction, xs)) / len(xs)) for xs in groups]
    assert (got[100], got[101], got[103]) == (None, math.inf, 1e-300) and math.isnan(got[102])


@pytest.mark.parametrize("small", [ordering.SMALL, 20])
def test_group_index(spark, small):
    r = random.Random(5)
    rows = [(i, None if (k := r.randrange(60)) == 7 else k, r.choice(["x", "y", None]), 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, k long, t string, v double").repartition(5)
    order = sorted({x[1:3] for x in rows}, key=lambda g: [(x is None, x or 0) for x in g])
    want = sorted((x[0], order.index(x[1:3])) for x in rows)
    assert sorted(values(ordering.with_group_index(df, ["k", "t"], "n", small), "id", "n")) == want
    found = Frame(df, ["id"]).group_transform(["k", "t"], "n_group", "v", "n").df
    assert found.columns == [*df.columns, "n"] and dict(found.dtypes)["n"] == "int" and sorted(values(found, "id", "n")) == want
    assert sorted(values(Columns(Frame(df, ["id"]), ["k", "t"]).transform("n_group").df, "id", "v")) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window") :]  # the distinct keys alone are numbered


def walked(rows):
    """(id, level, parent, path) by one stack for each lane; rows are (id, lane, name, start, duration)."""
    stacks, out = {}, []
    for i, lane, name, s, d in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, -(r[4] or 0), r[0])):
        if s is None:
            out.append((i, 0, -1, name or ""))
            continue
        stack = stacks.setdefault(str(lane), [])
        while stack and stack[-1][1] <= s:
            stack.pop()
        path = (stack[-1][2] + ";" if stack else "") + (name or "")
        out.append((i, len(stack), stack[-1][0] if stack else -1, path))
        stack.append((i, s + (d or 0), path))
    return sorted(out)


@pytest.mark.parametrize("kind", ["one root", "nested", "any"])
def test_call_tree_over_range_borders(spark, kind):
    r = random.Random(kind)
    rows = []

    def nest(lane, low, high, depth):
        rows.append((len(rows), lane, r.choice(["f", "g;h", "k", None]), low, high - low))
        while depth and low < high and r.random() < 0.9:
            a = r.randint(low, high)
            low = r.randint(a, high)
            nest(lane, a, low, depth - 1)

    for lane in (1.5, -0.0, math.nan, None):
        if kind == "one root":
            rows.append((len(rows), lane, "main", 0, 100_000))
        for at in range(0, 100_000, 2_000):
            if kind == "any":  # overlapping, empty, without length or start
                rows.extend((len(rows) + j, lane, r.choice("abc"), r.choice([None, at + r.randrange(3000), at]), r.choice([None, 0, r.randrange(9000)])) for j in range(3))
            else:
                nest(lane, at, at + r.choice([1000, 2000]), 6)
    df = spark.createDataFrame(rows, "i long, lane double, n string, s long, d long").repartition(5)
    tree = calltree.call_tree(df, ["lane"], "s", "d", "n", "i", rows_in_range=40).cache()
    want = walked(rows)
    assert sorted(values(tree, "id", "level", "parent_id", "path")) == want
    assert sorted(values(tree, "id", "name", "start"), key=str) == sorted(((i, n, s) for i, _, n, s, _ in rows), key=str)
    length = {i: d or 0 for i, _, _, s, d in rows if s is not None}
    total, own = collections.Counter(), collections.Counter()
    path = {i: p for i, _, _, p in want}
    for i, _, parent, p in want:
        total[p] += length.get(i, 0)
        own[p] += length.get(i, 0)
        if parent >= 0:
            own[path[parent]] -= length[i]
    flame = calltree.flamegraph(tree)
    assert "Join" not in flame._jdf.queryExecution().optimizedPlan().toString()  # the tree is made once
    assert {x["path"]: (x["count"], x["total"] or 0, x["self"] or 0) for x in flame.collect()} == {p: (n, total[p], own[p]) for p, n in collections.Counter(path.values()).items()}
    lanes = collections.Counter()
    for x in calltree.flamegraph(tree, ["lane"]).collect():
        lanes[x["path"]] += x["self"] or 0
    assert lanes == own
    tree.unpersist()


def test_call_tree_of_one_lane_takes_no_single_task(spark):
    """A root over the whole lane, which has no idle point: no task reads most of the rows."""
    n = 4000
    df = spark.range(n).select("id", F.when(F.col("id") == 0, 10 * n).otherwise(5).alias("d"), (F.col("id") * 10).alias("s"), F.lit("x").alias("n"))
    tree = calltree.call_tree(df, [], "s", "d", "n", "id", rows_in_range=200).withColumn("task", F.spark_partition_id())
    sizes = [x["count"] for x in tree.groupBy("task").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 2
    assert tree.groupBy("level", "parent_id").count().where("level = 1 and parent_id = 0").first()["count"] == n - 1
