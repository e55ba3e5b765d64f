"""Interval analytics over events: a start, a duration, a lane and a name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.frame import Frame
from tessera.functions.scalar import micros
from tessera.operators import calltree, occupancy, timeseries
from tessera.session import load

c = F.col
_DUR = "cast(trunc(value * 1000000000) as bigint)"
_X = f"(select event_id, user_id, event_type, epoch_us(ts) as t, {_DUR} as d from events where value is not null and value > 0) x"


def spans(spark, sf_dir):
    return load(spark, sf_dir, "events").where("value > 0").select("event_id", "user_id", "event_type", micros("ts").alias("t"), (c("value") * 1_000_000_000).cast("bigint").alias("d"))


def _occupancy(spark, sf_dir):
    out = occupancy.occupancy(spans(spark, sf_dir), ["user_id"], "t", "d")
    return out.select("user_id", "busy", "total", F.round("concurrency", 6).alias("concurrency"), F.round("utilization", 6).alias("utilization"), "active")


_BUSY = f"""with x as (select *, t as s, t + d as e from {_X}),
 a as (select user_id, sum(greatest(0, e - greatest(s, coalesce(m, s)))) as busy, sum(d) as total, max(e) - min(s) as span from (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as m from x) group by 1),
 p as (select user_id, t, sum(d) as d from (select user_id, s as t, 1 as d from x union all select user_id, e, -1 from x) group by 1, 2),
 q as (select user_id, max(n) as active from (select user_id, sum(d) over (partition by user_id order by t rows unbounded preceding) as n from p) group by 1)
 select a.user_id, busy::bigint as busy, total::bigint as total, round(total::double / busy, 6) as concurrency, round(busy::double / span, 6) as utilization, active::bigint as active from a join q using (user_id)"""

_HOUR = 3_600_000_000 * 24


def _bucketed(spark, sf_dir):
    return occupancy.occupancy(spans(spark, sf_dir), ["event_type"], "t", "d", bucket=_HOUR).select("event_type", "bucket", "busy", "total")


_BUCKETED = f"""with x as (select event_type, b as bucket, greatest(t, b) as s, least(t + d, b + {_HOUR}) as e from (select *, unnest(generate_series(t - t % {_HOUR}, (t + d - 1) - (t + d - 1) % {_HOUR}, {_HOUR})) as b from {_X}))
 select event_type, bucket, sum(greatest(0, e - greatest(s, coalesce(m, s))))::bigint as busy, sum(e - s)::bigint as total from (select *, max(e) over (partition by event_type, bucket order by s, e rows between unbounded preceding and 1 preceding) as m from x) group by 1, 2"""


def nested(spark, sf_dir):
    """Orders as calls in ten lanes, their line numbers as calls inside."""
    o = load(spark, sf_dir, "orders").select((c("o_orderkey") * 100).alias("id"), (c("o_orderkey") % 10).alias("lane"), c("o_orderstatus").alias("name"), (c("o_orderkey") * 1000).alias("s"), F.lit(1000).alias("d"))
    i = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    i = i.select((c("l_orderkey") * 100 + c("l_linenumber")).alias("id"), (c("l_orderkey") % 10).alias("lane"), F.concat(F.lit("L"), c("l_linenumber").cast("string")).alias("name"), (c("l_orderkey") * 1000 + c("l_linenumber") * 100).alias("s"), F.lit(60).alias("d"))
    return o.unionByName(i)


_NESTED = "i as (select distinct l_orderkey as k, l_linenumber as n from lineitem)"


def _tree(spark, sf_dir):
    return calltree.call_tree(nested(spark, sf_dir), ["lane"], "s", "d", "name", "id", paths=False).select("id", "lane", "name", "level", "parent_id")


def _flame(spark, sf_dir):
    tree = calltree.call_tree(nested(spark, sf_dir), ["lane"], "s", "d", "name", "id")
    return calltree.flamegraph(tree).select("path", "name", "level", "count", "total", "self")


def _sessions(**options):
    return lambda s, d: timeseries.sessions(spans(s, d), ["user_id"], "t", 7_200_000_000, tie=["event_id"], **options).select("event_id", "session")


_GAP = 7_200_000_000
_SESSION = "select event_id, sum(n) over (partition by user_id order by t, event_id rows unbounded preceding)::bigint as session from (select *, case when m is null or t > m + {gap} then 1 else 0 end as n from (select *, max(t + {d}) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding) as m from {x}))"

_LONGEST = 14_400_000_000
#: One row after the other, with the start and number of the session it falls in.
_SESSION_MAX = "with recursive r as (select *, row_number() over (partition by user_id order by t, event_id) as i from {x}), s as (select event_id, user_id, i, t, t as first, 1::bigint as session from r where i = 1 union all select r.event_id, r.user_id, r.i, r.t, case when r.t > s.t + {gap} or r.t > s.first + {longest} then r.t else s.first end, s.session + (r.t > s.t + {gap} or r.t > s.first + {longest})::bigint from s join r on r.user_id = s.user_id and r.i = s.i + 1) select event_id, session from s"


def _gap_fill(mode):
    def run(spark, sf_dir):
        e = load(spark, sf_dir, "events").withColumn("t", micros("ts"))
        return Frame(e, ["event_id"]).gap_fill(["event_type"], "t", _STEP, ["value"], mode).df.select("event_type", "t", "value")

    return run


_STEP = 900_000_000
_GRID = f"""with f as (select event_type, b, arg_min(value, t) as value from (select event_type, epoch_us(ts) as t, epoch_us(ts) - epoch_us(ts) % {_STEP} as b, value from events) group by 1, 2),
 g as (select event_type, unnest(generate_series(lo, hi, {_STEP})) as b from (select event_type, min(b) as lo, max(b) as hi from f group by 1)),
 j as (select g.event_type, g.b, value from g left join f on f.event_type = g.event_type and f.b = g.b)"""
_W = "partition by event_type order by b rows"


def _statistics(spark, sf_dir):
    return spans(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 2).alias("mean"), F.round(F.stddev_samp("d"), 0).alias("std"), F.min("t").alias("first"), F.max(c("t") + c("d")).alias("last"))


def _gaps_p99(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = spans(spark, sf_dir).withColumn("g", c("t") - F.lag("t").over(w))
    return e.groupBy("event_type").agg(F.round(F.percentile("g", 0.99), 2).alias("p99"))


def _log_histogram(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("event_type", F.floor(F.log2("d")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _numeric_args(spark, sf_dir):
    """Every numeric key of the properties, discovered from the data, in one pass."""
    args = load(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v")).withColumn("v", c("v").try_cast("double")).where("v is not null")
    return args.groupBy("event_type", "key").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("top"))


_CASES = {
    "occupancy": (_occupancy, _BUSY),
    "occupancy_bucketed": (_bucketed, _BUCKETED),
    "call_tree": (_tree, f"with {_NESTED} select o_orderkey * 100 as id, o_orderkey % 10 as lane, o_orderstatus as name, 0 as level, -1::bigint as parent_id from orders union all select k * 100 + n, k % 10, 'L' || n, case when o_orderkey is null then 0 else 1 end, case when o_orderkey is null then -1 else k * 100 end from i left join orders on o_orderkey = k"),
    "flamegraph": (_flame, f"with {_NESTED}, j as (select o_orderstatus as s, k, n from i join orders on o_orderkey = k) select o_orderstatus as path, o_orderstatus as name, 0 as level, count(*) as count, (count(*) * 1000)::bigint as total, (count(*) * 1000 - coalesce((select count(*) * 60 from j where s = o_orderstatus), 0))::bigint as self from orders group by o_orderstatus union all select s || ';L' || n, 'L' || n, 1, count(*), (count(*) * 60)::bigint, (count(*) * 60)::bigint from j group by s, n"),
    "sessions": (_sessions(), _SESSION.format(gap=_GAP, d=0, x=_X)),
    "sessions_with_duration": (_sessions(duration="d"), _SESSION.format(gap=_GAP, d="d", x=_X)),
    "sessions_max": (_sessions(longest=_LONGEST), _SESSION_MAX.format(gap=_GAP, longest=_LONGEST, x=_X)),
    "gap_fill": (_gap_fill("none"), f"{_GRID} select event_type, b as t, value from j"),
    "gap_fill_locf": (_gap_fill("locf"), f"{_GRID} select event_type, b as t, last_value(value ignore nulls) over ({_W} unbounded preceding) as value from j"),
    "gap_fill_linear": (_gap_fill("linear"), f"{_GRID}, k as (select *, last_value(case when value is not null then b end ignore nulls) over ({_W} unbounded preceding) as a, first_value(case when value is not null then b end ignore nulls) over ({_W} between current row and unbounded following) as z, last_value(value ignore nulls) over ({_W} unbounded preceding) as x, first_value(value ignore nulls) over ({_W} between current row and unbounded following) as y from j) select event_type, b as t, coalesce(value, x + (y - x) * (b - a)::double / (z - a)) as value from k"),
    "time_range": (lambda s, d: spans(s, d).where((c("t") >= 1704100000000000) & (c("t") < 1704300000000000)), f"select * from {_X} where t >= 1704100000000000 and t < 1704300000000000"),
    "statistics": (_statistics, f"select count(*) as n, round(avg(d), 2) as mean, round(stddev_samp(d), 0) as std, min(t) as first, max(t + d) as last from {_X}"),
    "gaps_p99": (_gaps_p99, f"select event_type, round(quantile_cont(g, 0.99), 2) as p99 from (select event_type, t - lag(t) over (partition by user_id order by t, event_id) as g from {_X}) group by 1"),
    "log_histogram": (_log_histogram, f"select event_type, floor(log2(d))::int as b, count(*) as n from {_X} group by 1, 2"),
    "numeric_args": (_numeric_args, "select event_type, 'k' as key, count(k) as n, round(avg(k), 6) as mean, max(k) as top from (select event_type, json_extract_string(props, '$.k')::double as k from events) where k is not null group by 1"),
    "time_buckets": (lambda s, d: spans(s, d).groupBy((c("t") - c("t") % 3_600_000_000).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("total")), f"select t - t % 3600000000 as b, count(*) as n, sum(d)::bigint as total from {_X} group by 1"),
    "slowest_100": (lambda s, d: spans(s, d).orderBy(c("d").desc(), "event_id").limit(100), f"select * from {_X} order by d desc, event_id limit 100"),
    "per_lane_name": (lambda s, d: spans(s, d).groupBy("user_id", "event_type").agg(F.round(F.avg("d"), 2).alias("mean"), F.max("d").alias("top")), f"select user_id, event_type, round(avg(d), 2) as mean, max(d) as top from {_X} group by 1, 2"),
}


def entries():
    return {f"trace_{name}": case for name, case in _CASES.items()}
