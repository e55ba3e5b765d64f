"""Joins over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import micros
from tessera.operators import joins as J
from tessera.session import load

c = F.col


def _cn(spark, sf_dir):
    """Customers with a null nation wherever it is 3, and nations without the first."""
    cust = load(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return cust, load(spark, sf_dir, "nation").where("n_nationkey > 0").select(c("n_nationkey").alias("k"), "n_name")


_C = "(select c_custkey, nullif(c_nationkey, 3) as k from customer) c"
_N = "(select n_nationkey as k, n_name from nation where n_nationkey > 0) n"


def _kind(how, **options):
    return lambda s, d: J.join(*_cn(s, d), ["k"], how=how, **options)


def _events(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))
    return e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("user_id", "t", c("event_id").alias("p"))


_E = "(select event_id, user_id, event_type, value, epoch_us(ts) as t from events where event_type <> 'purchase') e"
_P = "(select user_id, epoch_us(ts) as t, event_id as p from events where event_type = 'purchase') p"


def _asof(direction, tolerance=None):
    def run(spark, sf_dir):
        left, right = _events(spark, sf_dir)
        return J.asof(left, right, "t", ["user_id"], direction, tolerance, key=["p"]).select("event_id", F.coalesce("p", F.lit(-1)).alias("p"), F.coalesce("t_right", F.lit(-1)).alias("t_right"))

    return run


def _near():
    b = f"(select event_id, e.t, p.p, p.t as pt from {_E} asof left join {_P} on e.user_id = p.user_id and e.t >= p.t)"
    a = f"(select event_id, p.p, p.t as pt from {_E} asof left join {_P} on e.user_id = p.user_id and e.t <= p.t)"
    pick = "b.pt is not null and (a.pt is null or b.t - b.pt <= a.pt - b.t)"
    return f"select event_id, coalesce(case when {pick} then b.p else a.p end, -1) as p, coalesce(case when {pick} then b.pt else a.pt end, -1) as t_right from {b} b join {a} a using (event_id)"


def _interval(outer):
    def run(spark, sf_dir):
        parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
        bands = load(spark, sf_dir, "supplier").select("s_suppkey", (c("s_suppkey") * 10.0 + 900).alias("lo"), (c("s_suppkey") * 10.0 + 915).alias("hi"))
        return J.interval(parts, bands, "p_retailprice", "lo", "hi", outer=outer)

    return run


_BANDS = "(select s_suppkey, s_suppkey * 10.0::double + 900 as lo, s_suppkey * 10.0::double + 915 as hi from supplier) b"


def _overlap(how):
    def run(spark, sf_dir):
        e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("s"), (micros("ts") + (c("value") * 100_000_000).cast("bigint")).alias("e"))
        left = e.where("event_type = 'click'").select("event_id", "user_id", "s", "e")
        right = e.where("event_type = 'view'").select("user_id", c("event_id").alias("other"), c("s").alias("vs"), c("e").alias("ve"))
        return J.overlap(left, right, "s", "e", "vs", "ve", ["user_id"], how).select("event_id", "other")

    return run


def _overlap_repeated(spark, sf_dir):
    """Left rows that repeat, and ranges of very different lengths."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", micros("ts").alias("s"), (micros("ts") + F.when(c("event_id") % 50 == 0, 86_400_000_000).otherwise((c("value") * 1_000_000).cast("bigint"))).alias("e"))
    left = e.where("event_type = 'click'").select("user_id", F.expr("s div 60000000000 * 60000000000").alias("s")).withColumn("e", c("s") + 60_000_000_000)
    right = e.where("event_type = 'view'").select("user_id", c("s").alias("vs"), c("e").alias("ve"))
    return J.overlap(left, right, "s", "e", "vs", "ve", ["user_id"], "left").groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("n"), F.count("vs").alias("met"))


def _interval_levels(spark, sf_dir):
    """Points in ranges of lengths from zero to the whole table."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    bands = load(spark, sf_dir, "supplier").select("s_suppkey", (c("s_suppkey") * 7).alias("lo"), (c("s_suppkey") * 7 + F.pow(F.lit(3), c("s_suppkey") % 9).cast("bigint") - 1).alias("hi"))
    return J.interval(o, bands, "o_orderkey", "lo", "hi", outer=True).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


_SPAN = "select event_id, user_id, event_type, epoch_us(ts) as s, epoch_us(ts) + cast(trunc(value * 100000000) as bigint) as e from events"


def _lookup(kind):
    def run(spark, sf_dir):
        cust, nation = _cn(spark, sf_dir)
        return J.lookup(cust, nation, ["k"], ["k"], kind)

    return run


def _nest(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    out = J.nest(load(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], ["o_custkey"])
    return out.select("c_custkey", F.array_join(F.transform("matches", lambda x: x["o_orderkey"]), ",").alias("keys"))


def _three_way(spark, sf_dir):
    """Revenue by nation: the small dimensions are broadcast by size, the facts are joined on their key."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_extendedprice") * (1 - c("l_discount"))).alias("r"))
    cust = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return line.groupBy("l_orderkey").agg(F.sum("r").alias("r")).join(o, c("l_orderkey") == c("o_orderkey")).join(cust, c("o_custkey") == c("c_custkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


_CASES = {
    "inner": (_kind("inner"), f"select c_custkey, c.k, n_name from {_C} join {_N} on c.k = n.k"),
    "left": (_kind("left"), f"select c_custkey, c.k, n_name from {_C} left join {_N} on c.k = n.k"),
    "right": (_kind("right"), f"select c_custkey, coalesce(c.k, n.k) as k, n_name from {_C} right join {_N} on c.k = n.k"),
    "outer": (_kind("outer"), f"select c_custkey, coalesce(c.k, n.k) as k, n_name from {_C} full join {_N} on c.k = n.k"),
    "semi": (_kind("semi"), f"select c.* from {_C} where exists (select 1 from {_N} where n.k = c.k)"),
    "anti": (_kind("anti"), f"select c.* from {_C} where not exists (select 1 from {_N} where n.k = c.k)"),
    "nulls_equal": (lambda s, d: J.join(_cn(s, d)[0], _cn(s, d)[1].unionByName(s.createDataFrame([(None, "none")], "k int, n_name string")), ["k"], nulls_equal=True), f"select c_custkey, c.k, n_name from {_C} join (select * from {_N} union all select null, 'none') n on c.k is not distinct from n.k"),
    "cross": (lambda s, d: J.join(load(s, d, "region").select("r_name"), load(s, d, "nation").select("n_name"), [], how="cross"), "select r_name, n_name from region cross join nation"),
    "lookup": (_lookup("left"), f"select c_custkey, c.k, n_name from {_C} left join {_N} on c.k = n.k"),
    "lookup_inner": (_lookup("inner"), f"select c_custkey, c.k, n_name from {_C} join {_N} on c.k = n.k"),
    "lookup_anti": (_lookup("anti"), f"select c.* from {_C} where not exists (select 1 from {_N} where n.k = c.k)"),
    "nest": (_nest, "select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as keys from customer left join orders on o_custkey = c_custkey group by 1"),
    "asof_backward": (_asof("backward"), f"select event_id, coalesce(p.p, -1) as p, coalesce(p.t, -1) as t_right from {_E} asof left join {_P} on e.user_id = p.user_id and e.t >= p.t"),
    "asof_forward": (_asof("forward"), f"select event_id, coalesce(p.p, -1) as p, coalesce(p.t, -1) as t_right from {_E} asof left join {_P} on e.user_id = p.user_id and e.t <= p.t"),
    "asof_nearest": (_asof("nearest"), _near()),
    "asof_tolerance": (_asof("backward", 3.6e9), f"select event_id, case when e.t - p.t <= 3600000000 then p.p else -1 end as p, case when e.t - p.t <= 3600000000 then p.t else -1 end as t_right from {_E} asof left join {_P} on e.user_id = p.user_id and e.t >= p.t"),
    "interval": (_interval(False), f"select p_partkey, p_retailprice, s_suppkey, lo, hi from part join {_BANDS} on p_retailprice between lo and hi"),
    "interval_outer": (_interval(True), f"select p_partkey, p_retailprice, s_suppkey, lo, hi from part left join {_BANDS} on p_retailprice between lo and hi"),
    "overlap": (_overlap("inner"), f"with x as ({_SPAN}) select a.event_id, b.event_id as other from x a join x b on a.user_id = b.user_id and a.s < b.e and b.s < a.e where a.event_type = 'click' and b.event_type = 'view'"),
    "overlap_left": (_overlap("left"), f"with x as ({_SPAN}), a as (select * from x where event_type = 'click'), b as (select * from x where event_type = 'view') select a.event_id, b.event_id as other from a left join b on a.user_id = b.user_id and a.s < b.e and b.s < a.e"),
    "overlap_repeated": (_overlap_repeated, "with x as (select user_id, event_type, epoch_us(ts) as s, epoch_us(ts) + case when event_id % 50 = 0 then 86400000000 else cast(trunc(value * 1000000) as bigint) end as e from events), a as (select user_id, s // 60000000000 * 60000000000 as s from x where event_type = 'click'), b as (select * from x where event_type = 'view') select a.user_id, a.s, count(*) as n, count(b.s) as met from a left join b on a.user_id = b.user_id and a.s < b.e and b.s < a.s + 60000000000 group by 1, 2"),
    "interval_levels": (_interval_levels, "select s_suppkey, count(*) as n from orders left join (select s_suppkey, s_suppkey * 7 as lo, s_suppkey * 7 + cast(pow(3, s_suppkey % 9) as bigint) - 1 as hi from supplier) on o_orderkey between lo and hi group by 1"),
    "three_way": (_three_way, "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"),
}


def entries():
    return {f"join_{name}": case for name, case in _CASES.items()}
