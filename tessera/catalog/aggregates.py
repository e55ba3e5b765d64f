"""Engine aggregates, each grouped over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.aggregates import aggregate
from tessera.operators import sketches
from tessera.session import load

c = F.col


def _r(x):
    return F.round(x, 4)


_L = ("lineitem", "l_returnflag")
_O = ("orders", "o_custkey")
#: name: (table, key, expression, SQL).
_CASES = {
    "count": (*_L, lambda: aggregate("count"), "count(*)"),
    "count_valid": (*_O, lambda: aggregate("count_valid", F.nullif("o_orderstatus", F.lit("F"))), "count(nullif(o_orderstatus, 'F'))"),
    "count_if": (*_L, lambda: aggregate("count_if", c("l_quantity") > 25), "count_if(l_quantity > 25)::bigint"),
    "sum": (*_L, lambda: _r(aggregate("sum", c("l_quantity"))), "round(sum(l_quantity), 4)"),
    "sum_int": (*_O, lambda: aggregate("sum", c("o_orderkey")), "cast(sum(o_orderkey) as bigint)"),
    "min": (*_L, lambda: aggregate("min", c("l_extendedprice")), "min(l_extendedprice)"),
    "max": (*_L, lambda: aggregate("max", c("l_extendedprice")), "max(l_extendedprice)"),
    "mean": (*_L, lambda: _r(aggregate("mean", c("l_extendedprice"))), "round(avg(l_extendedprice), 4)"),
    "var": (*_O, lambda: F.round(aggregate("var", c("o_totalprice")), 1), "round(var_samp(o_totalprice), 1)"),
    "std": (*_O, lambda: _r(aggregate("std", c("o_totalprice"))), "round(stddev_samp(o_totalprice), 4)"),
    "skew": (*_L, lambda: _r(aggregate("skew", c("l_extendedprice"))), "round((sum(pow(x, 3)) / count(*)) / pow(sum(x * x) / count(*), 1.5), 4)"),
    "kurt": (*_L, lambda: _r(aggregate("kurt", c("l_extendedprice"))), "round((sum(pow(x, 4)) / count(*)) / pow(sum(x * x) / count(*), 2) - 3, 4)"),
    "first": (*_O, lambda: aggregate("first", c("o_orderstatus"), pos=c("o_orderkey")), "arg_min(o_orderstatus, o_orderkey)"),
    "last": (*_O, lambda: aggregate("last", c("o_orderstatus"), pos=c("o_orderkey")), "arg_max(o_orderstatus, o_orderkey)"),
    "arg_max": (*_O, lambda: aggregate("arg_max", c("o_orderkey"), by=c("o_totalprice"), pos=c("o_orderkey")), "arg_max(o_orderkey, (o_totalprice, -o_orderkey))"),
    "arg_min": (*_O, lambda: aggregate("arg_min", c("o_orderkey"), by=c("o_totalprice"), pos=c("o_orderkey")), "arg_min(o_orderkey, (o_totalprice, o_orderkey))"),
    "sum_sq": (*_L, lambda: F.round(aggregate("sum_sq", c("l_quantity")), 2), "round(sum(l_quantity * l_quantity), 2)"),
    "set_union": (*_O, lambda: F.array_join(aggregate("set_union", c("o_orderstatus")), ","), "array_to_string(list_sort(list(distinct o_orderstatus)), ',')"),
    "set_union_text": (*_O, lambda: aggregate("set_union_text", c("o_orderpriority")), "array_to_string(list_sort(list(distinct o_orderpriority)), chr(30))"),
    "bit_or": (*_O, lambda: aggregate("bit_or", c("o_orderkey")), "bit_or(o_orderkey)"),
    "count_distinct": (*_L, lambda: aggregate("count_distinct", c("l_partkey")), "count(distinct l_partkey)"),
    "list_sorted": (*_O, lambda: F.array_join(aggregate("list_sorted", c("o_orderkey"), by=c("o_totalprice"), pos=c("o_orderkey")), ","), "string_agg(o_orderkey::varchar, ',' order by o_totalprice, o_orderkey)"),
    "collect": (*_O, lambda: F.array_join(aggregate("collect", c("o_orderstatus"), pos=c("o_orderkey")), ","), "string_agg(o_orderstatus, ',' order by o_orderkey)"),
    "top_k": (*_O, lambda: F.array_join(aggregate("top_k", c("o_orderkey"), by=c("o_totalprice"), param=3), ","), "array_to_string(list_slice(list(o_orderkey order by o_totalprice desc, o_orderkey desc), 1, 3), ',')"),
    "bottom_k": (*_O, lambda: F.array_join(aggregate("bottom_k", c("o_orderkey"), by=c("o_totalprice"), param=3), ","), "array_to_string(list_slice(list(o_orderkey order by o_totalprice, o_orderkey), 1, 3), ',')"),
    "approx_top_k": ("lineitem", "l_returnflag", lambda: aggregate("approx_top_k", c("l_linestatus"), param=1)[0]["count"], "cast(max(n) as bigint)"),
    "corr": (*_L, lambda: _r(aggregate("corr", c("l_extendedprice"), by=c("l_quantity"))), "round(corr(l_extendedprice, l_quantity), 4)"),
    "covar_pop": (*_L, lambda: F.round(aggregate("covar_pop", c("l_extendedprice"), by=c("l_quantity")), 2), "round(covar_pop(l_extendedprice, l_quantity), 2)"),
    "covar_samp": (*_L, lambda: F.round(aggregate("covar_samp", c("l_extendedprice"), by=c("l_quantity")), 2), "round(covar_samp(l_extendedprice, l_quantity), 2)"),
    "regr_slope": (*_L, lambda: _r(aggregate("regr_slope", c("l_extendedprice"), by=c("l_quantity"))), "round(regr_slope(l_extendedprice, l_quantity), 4)"),
    "regr_intercept": (*_L, lambda: _r(aggregate("regr_intercept", c("l_extendedprice"), by=c("l_quantity"))), "round(regr_intercept(l_extendedprice, l_quantity), 4)"),
    "regr_r2": (*_L, lambda: F.round(aggregate("regr_r2", c("l_extendedprice"), by=c("l_quantity")), 8), "round(regr_r2(l_extendedprice, l_quantity), 8)"),
    "prod": (*_O, lambda: F.round(aggregate("prod", c("o_totalprice") / 100000), 4), "round(product(o_totalprice / 100000), 4)"),
    "median": (*_L, lambda: aggregate("median", c("l_quantity")), "median(l_quantity)"),
    "quantile_exact": (*_L, lambda: _r(aggregate("quantile_exact", c("l_extendedprice"), param=0.9)), "round(quantile_cont(l_extendedprice, 0.9), 4)"),
    "any": (*_O, lambda: aggregate("any", c("o_totalprice") > 400000), "bool_or(o_totalprice > 400000)"),
    "all": (*_O, lambda: aggregate("all", c("o_totalprice") > 50000), "bool_and(o_totalprice > 50000)"),
    "sem": (*_O, lambda: _r(aggregate("sem", c("o_totalprice"))), "round(stddev_samp(o_totalprice) / sqrt(count(*)), 4)"),
    "dot": (*_L, lambda: F.round(aggregate("dot", c("l_quantity"), by=c("l_discount")), 2), "round(sum(l_quantity * l_discount), 2)"),
}


def _query(table, key, make):
    return lambda spark, sf_dir: load(spark, sf_dir, table).groupBy(key).agg(make().alias("v"))


def _within(name, exact, make, table="lineitem", key="l_returnflag", off=0.02):
    """Approximate aggregates: whether each group is within its stated error of the exact value.

    The two are grouped apart: beside a distinct count, a sketch would be kept for each distinct value.
    """

    def run(spark, sf_dir):
        rows = load(spark, sf_dir, table)
        found, known = rows.groupBy(key).agg(make().alias("a")), rows.groupBy(c(key).alias("k")).agg(exact().alias("e"))
        return found.join(known, c(key).eqNullSafe(c("k"))).select(key, (F.abs(c("a") - c("e")) <= F.abs(c("e")) * off).alias("within"))

    return run, f"select {key}, true as within from {table} group by {key}"


def _sketch_quantile(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    # Built for each line status, then merged: a sketch is a table of counts.
    parts = sketches.sketch(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    found = sketches.quantile(sketches.merge(parts, ["l_returnflag"]), ["l_returnflag"], 0.5)
    exact = lines.groupBy(c("l_returnflag").alias("k")).agg(F.percentile("l_extendedprice", 0.5).alias("e"))
    return found.join(exact, c("l_returnflag") == c("k")).select("l_returnflag", (F.abs(c("quantile") - c("e")) <= c("e") * 0.011).alias("within"))


def _sketch_histogram(spark, sf_dir):
    rows = sketches.histogram(sketches.sketch(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"), ["l_returnflag"])
    return rows.select("l_returnflag", F.aggregate("buckets", F.lit(0).cast("bigint"), lambda a, b: a + b["count"]).alias("n"))


def _sample(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.size(aggregate("sample", c("l_partkey"), param=50)).alias("n"))


def _reduce_all(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice")).alias("total"), F.min_by("o_orderstatus", "o_orderkey").alias("first"), F.max_by("o_orderstatus", "o_orderkey").alias("last"))


def entries():
    out = {}
    for name, (table, key, make, sql) in _CASES.items():
        source = table
        if name in ("skew", "kurt"):
            source = "(select *, l_extendedprice - avg(l_extendedprice) over (partition by l_returnflag) as x from lineitem)"
        if name == "approx_top_k":
            source = "(select l_returnflag, count(*) as n from lineitem group by l_returnflag, l_linestatus)"
        out[f"agg_{name}"] = (_query(table, key, make), f"select {key}, {sql} as v from {source} group by {key}")
    out["agg_quantile"] = _within("quantile", lambda: F.percentile("l_extendedprice", 0.9), lambda: aggregate("quantile", c("l_extendedprice"), param=0.9))
    out["agg_distinct"] = _within("distinct", lambda: F.count_distinct("l_partkey"), lambda: aggregate("distinct", c("l_partkey")), off=0.05)
    out["agg_hll"] = _within("hll", lambda: F.count_distinct("l_partkey"), lambda: aggregate("hll", c("l_partkey")), off=0.05)
    out["agg_sketch_quantile"] = (_sketch_quantile, "select l_returnflag, true as within from lineitem group by l_returnflag")
    out["agg_histogram"] = (_sketch_histogram, "select l_returnflag, count(*) as n from lineitem group by l_returnflag")
    out["agg_sample"] = (_sample, "select l_returnflag, least(50, count(distinct l_partkey))::int as n from lineitem group by l_returnflag")
    out["agg_reduce"] = (_reduce_all, "select count(*) as n, round(sum(o_totalprice), 4) as total, arg_min(o_orderstatus, o_orderkey) as first, arg_max(o_orderstatus, o_orderkey) as last from orders")
    return out
