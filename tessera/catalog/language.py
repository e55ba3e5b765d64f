"""Queries in the pipe language, over events as a trace: start ``ts`` and duration ``dur`` in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import micros
from tessera.plans.compiler import Context, Roles, compile_query
from tessera.session import load

c = F.col


def context(spark: SparkSession, sf_dir: str, **params) -> Context:
    events = load(spark, sf_dir, "events").select(
        "event_id", c("event_type").alias("name"), (c("user_id") % 4).alias("pid"), c("user_id").alias("tid"), micros("ts").alias("ts"), (c("value") * 1_000_000).cast("bigint").alias("dur"), "value", c("props").alias("args")
    )
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    lists = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.split("p_name", " ").alias("words"), F.array("p_size", F.lit(10)).alias("sizes"))
    tables = {"events": events, "lines": lines, "parts": lists, "nation": load(spark, sf_dir, "nation"), "customer": load(spark, sf_dir, "customer"), "orders": load(spark, sf_dir, "orders")}
    return Context(spark, tables, Roles("ts", "dur", ("tid",), "name", "us"), ["event_id"], params)


#: The same events for DuckDB.
_EV = "ev as (select event_id, event_type as name, user_id % 4 as pid, user_id as tid, epoch_us(ts) as ts, cast(trunc(value * 1000000) as bigint) as dur, value, props as args from events)"
_PARAMS = {"names": ["click", "view"], "n": 7, "low": 20}

#: name: (query, SQL after ``with ev as ...``).
_CASES = {
    "quickstart": ('from events | where name == "click" | group tid { n = count(), total = sum(dur), peak = max(dur) } | sort -total | take 10', "select tid, count(*) as n, sum(dur)::bigint as total, max(dur) as peak from ev where name = 'click' group by 1 order by total desc, tid limit 10"),
    "where_arith": ("from events | where dur > 5s and pid != 2 | select event_id, ms = dur / 1000, s = dur // 1000000, r = -dur % 7", "select event_id, dur / 1000.0::double as ms, dur // 1000000 as s, ((-dur % 7) + 7) % 7 as r from ev where dur > 5000000 and pid <> 2"),
    "bare_expression": ("from events | value between 10 and 20 or name in [\"error\"] | select event_id", "select event_id from ev where value between 10 and 20 or name = 'error'"),
    "cross_type": ("from events | where name == 4 or value > 100 | select event_id", "select event_id from ev where value > 100"),
    "text_predicates": ('from parts | where p_name like "red%" or p_name ilike "%BOLT" or p_name ~ "^small" and not p_name ~* "GEAR" | select p_partkey', "select p_partkey from part where p_name like 'red%' or p_name ilike '%BOLT' or (regexp_matches(p_name, '^small') and not regexp_matches(p_name, '(?i)GEAR'))"),
    "param_list": ("from events | where name in $names and value >= $low | select event_id", "select event_id from ev where name in ('click', 'view') and value >= 20"),
    "not_in": ('from events | where name not in ["click", "view"] | select event_id', "select event_id from ev where name not in ('click', 'view')"),
    "text_in": ('from parts | where "RED" in p_name | select p_partkey', "select p_partkey from part where contains(lower(p_name), 'red')"),
    "derive_chain": ("from events | derive a = dur + 1, b = a * 2 | select event_id, b", "select event_id, (dur + 1) * 2 as b from ev"),
    "drop_rename": ("from events | drop args, value, ts, dur | rename kind = name", "select event_id, name as kind, pid, tid from ev"),
    "distinct": ("from events | distinct name, big = dur > 50s", "select distinct name, dur > 50000000 as big from ev"),
    "sort_take": ("from events | sort -value, event_id | take 15 | select event_id, value", "select event_id, value from ev order by value desc, event_id limit 15"),
    "take_range": ("from events | take 11..20 | select event_id", "select event_id from ev order by event_id limit 10 offset 10"),
    "skip": ("from events | skip 9900 | select event_id", "select event_id from ev order by event_id offset 9900"),
    "take_by": ("from events | take 2 by tid sort -value | select event_id, tid", "select event_id, tid from ev qualify row_number() over (partition by tid order by value desc nulls last, event_id) <= 2"),
    "sample": ("from events | sample 50 seed 3 | agg { n = count() }", "select least(50, count(*))::bigint as n from ev"),
    "group_expr": ("from events | group name, big = dur > 50s { n = count(), ms = sum(dur) / 1000, avg = mean(dur), q = count_if(value > 30) }", "select name, dur > 50000000 as big, count(*) as n, sum(dur) / 1000.0::double as ms, avg(dur) as avg, count_if(value > 30)::bigint as q from ev group by 1, 2"),
    "group_default_names": ("from events | group name { count(), sum(dur), max(value) }", "select name, count(*) as count, sum(dur)::bigint as sum_dur, max(value) as max_value from ev group by 1"),
    "group_ordered": ("from events | group tid { a = first(name), z = last(name), top = arg_max(name, value), low = arg_min(event_id, value), d = count_distinct(name) }", "select tid, arg_min(name, event_id) as a, arg_max(name, event_id) as z, arg_max(name, (value, -event_id)) as top, arg_min(event_id, (value, event_id)) as low, count(distinct name) as d from ev group by 1"),
    "agg": ("from events | agg { n = count(), v = var(value), s = std(value) } | derive v = round(v, 4), s = round(s, 4)", "select count(*) as n, round(var_samp(value), 4) as v, round(stddev_samp(value), 4) as s from ev"),
    "agg_collect": ("from events | where tid < 5 | group tid { ids = collect(event_id) } | select tid, n = len(ids), a = ids[0], z = ids[-1]", "select tid, count(*)::int as n, min(event_id) as a, max(event_id) as z from ev where tid < 5 group by 1"),
    "occupancy": ("from events | group pid { b = busy(), a = active(), n = count() }", """select pid, b, a, n from (select pid, sum(greatest(0, e - greatest(s, coalesce(m, s))))::bigint as b, count(*) as n from (select *, max(e) over (partition by pid order by s, e rows between unbounded preceding and 1 preceding) as m from (select pid, ts as s, ts + dur as e from ev)) group by 1)
        join (select pid, max(k)::bigint as a from (select pid, sum(d) over (partition by pid order by t rows unbounded preceding) as k from (select pid, t, sum(d) as d from (select pid, ts as t, 1 as d from ev union all select pid, ts + dur, -1 from ev) group by 1, 2)) group by 1) using (pid)"""),
    "bucket": ("from events | bucket 6h | group name { n = count(), top = max(dur) }", "select ts - ts % 21600000000 as bucket, name, count(*) as n, max(dur) as top from ev group by 1, 2"),
    "bucket_at": ("from events | bucket 1d at 6h | agg { n = count() }", "select ts - (ts - 21600000000) % 86400000000 as bucket, count(*) as n from ev group by 1"),
    "bucket_hopping": ("from events | bucket 12h every 6h | agg { n = count() }", "select b as bucket, count(*) as n from (select unnest([ts - ts % 21600000000, ts - ts % 21600000000 - 21600000000]) as b from ev) group by 1"),
    "bucket_fill": ("from events | where value > 200 | bucket 1h fill | agg { n = count(), m = max(value) }", "select g as bucket, coalesce(n, 0)::bigint as n, m from (select unnest(generate_series(lo, hi, 3600000000)) as g from (select min(ts - ts % 3600000000) as lo, max(ts - ts % 3600000000) as hi from ev where value > 200)) left join (select ts - ts % 3600000000 as b, count(*) as n, max(value) as m from ev where value > 200 group by 1) on b = g"),
    "bucket_fill_forward": ("from events | where value > 200 | bucket 1h fill forward | agg { m = max(value) }", "select g as bucket, last_value(m ignore nulls) over (order by g rows unbounded preceding) as m from (select unnest(generate_series(lo, hi, 3600000000)) as g from (select min(ts - ts % 3600000000) as lo, max(ts - ts % 3600000000) as hi from ev where value > 200)) left join (select ts - ts % 3600000000 as b, max(value) as m from ev where value > 200 group by 1) on b = g"),
    "window_ranks": ("from events | window name sort -value, event_id { r = row_number(), k = rank(), t = ntile(4) } | select event_id, r, k, t", "select event_id, (row_number() over w)::int as r, (rank() over w)::int as k, (ntile(4) over w)::int as t from ev window w as (partition by name order by value desc, event_id)"),
    "window_lag": ("from events | window tid sort ts { gap = coalesce(ts - lag(ts), -1), nx = lead(value, 2, -1), run = running_sum(dur), c = running_count() } | select event_id, gap, nx, run, c", "select event_id, coalesce(ts - lag(ts) over w, -1) as gap, lead(value, 2, -1) over w as nx, (sum(dur) over (w rows unbounded preceding))::bigint as run, count(*) over (w rows unbounded preceding) as c from ev window w as (partition by tid order by ts, event_id)"),
    "window_frames": ("from events | window tid sort ts { m = max(value) over 3 rows, n = count() over 1h, w = max(value) } | select event_id, m, n, w", "select event_id, max(value) over (partition by tid order by ts, event_id rows 2 preceding) as m, count(*) over (partition by tid order by ts range between 3600000000 preceding and current row) as n, max(value) over (partition by tid) as w from ev"),
    "session": ("from events | session tid gap 2h | group tid, session { n = count(), t = sum(dur) }", "select tid, s as session, count(*) as n, sum(dur)::bigint as t from (select *, sum(f) over (partition by tid order by ts, event_id rows unbounded preceding)::bigint as s from (select *, case when m is null or ts > m + 7200000000 then 1 else 0 end as f from (select *, max(ts + dur) over (partition by tid order by ts, event_id rows between unbounded preceding and 1 preceding) as m from ev))) group by 1, 2"),
    "expand": ("from parts | expand words as w with_index i | select p_partkey, w, i", "select p_partkey, unnest(string_split(p_name, ' ')) as w, unnest(range(0, len(string_split(p_name, ' '))))::int as i from part"),
    "parse": ('from parts | parse p_brand ~ "(?<maker>[A-Za-z]+)#(?<no>[0-9]+)" | select p_partkey, maker, no = int(no)', "select p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 1) as maker, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)::bigint as no from part"),
    "pivot": ('from events | group pid, name { n = count() } | pivot name in ["click", "view"] { n = sum(n) }', "select pid, count_if(name = 'click')::bigint as \"n.click\", count_if(name = 'view')::bigint as \"n.view\" from ev group by 1"),
    "unpivot": ("from events | select event_id, dur, pid | unpivot dur, pid as k, v", "select event_id, 'dur' as k, dur as v from ev union all select event_id, 'pid', pid from ev"),
    "lookup": ("from customer | select c_custkey, n_nationkey = c_nationkey | lookup nation on n_nationkey", "select c_custkey, c_nationkey as n_nationkey, n_name, n_regionkey from customer left join nation on c_nationkey = n_nationkey"),
    "lookup_anti": ('let some = from nation | where n_regionkey == 1; from customer | select c_custkey, n_nationkey = c_nationkey | lookup some on n_nationkey anti', "select c_custkey, c_nationkey as n_nationkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)"),
    "lookup_asof": ('let buys = from events | where name == "purchase" | select tid, bt = ts, buy = event_id; from events | where name == "click" | select event_id, tid, ts | lookup buys on tid asof ts == bt within 1d | select event_id, buy', "select event_id, case when e.ts - p.ts <= 86400000000 then p.buy end as buy from (select * from ev where name = 'click') e asof left join (select tid, ts, event_id as buy from ev where name = 'purchase') p on e.tid = p.tid and e.ts >= p.ts"),
    "semi_query": ("from orders | where o_custkey in (from customer | where c_acctbal > 9000 | select c_custkey) | select o_orderkey", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)"),
    "not_in_query": ("from orders | where o_custkey not in (from customer | where c_acctbal > 0 | select c_custkey) | select o_orderkey", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)"),
    "scalar_query": ("from events | where value > (from events | agg { m = mean(value) }) | select event_id", "select event_id from ev where value > (select avg(value) from ev)"),
    "correlated_query": ("from events | where value > (from events | where tid == ^.tid and pid < 3 | agg { m = mean(value) }) | select event_id", "select event_id from ev e where value > (select avg(value) from ev i where i.tid = e.tid and i.pid < 3)"),
    "correlated_count": ("from customer | derive n = (from orders | where o_custkey == ^.c_custkey | agg { n = count() }) | select c_custkey, n", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer"),
    "arrow": ('from customer | where c_nationkey -> nation.n_name == "NATION_3" or c_acctbal > 9900 | select c_custkey', "select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_3' or c_acctbal > 9900"),
    "union": ("let a = from events | where pid == 1 | select event_id; from events | where pid == 2 | select event_id | union a", "select event_id from ev where pid in (1, 2)"),
    "from_several": ("from nation, customer | agg { n = count() }", "select ((select count(*) from nation) + (select count(*) from customer))::bigint as n"),
    "macros": ("def ms(x) = x / 1000; def top(k, n) = sort -k | take 12; from events | derive m = ms(dur) | top(m, 3) | select event_id, m", "select event_id, dur / 1000.0::double as m from ev order by m desc, event_id limit 12"),
    "json_path": ("from events | where args.k > 50 | group k = int(args.k) { n = count() }", "select json_extract_string(args, '$.k')::bigint as k, count(*) as n from ev where json_extract_string(args, '$.k')::double > 50 group by 1"),
    "quantifiers": ("from parts | where any(sizes, . > 40) or all(sizes, . == 10) | select p_partkey", "select p_partkey from part where p_size > 40 or p_size = 10"),
    "time_range": ("from events | time_range 1704100000000000 .. 1704100000000000 + 2d | select event_id", "select event_id from ev where ts >= 1704100000000000 and ts < 1704100000000000 + 172800000000"),
    "time_range_overlap": ("from events | time_range 1704100000000000 .. 1704200000000000 overlap | select event_id", "select event_id from ev where ts < 1704200000000000 and ts + dur > 1704100000000000"),
    "functions": ('from parts | select p_partkey, a = upper(p_name), b = substr(p_name, 1, 3), d = len(words), e = coalesce(null, p_brand), f = if(len(p_name) > 8, "long", "short"), g = replace(p_name, "r", "R"), h = concat(p_partkey, "-", p_brand), i = case { p_partkey < 10 => "x", p_partkey < 20 => "y", else => "z" }, j = max(1, p_partkey), k = round(pow(p_partkey, 0.5), 4)', "select p_partkey, upper(p_name) as a, substr(p_name, 2, 3) as b, len(string_split(p_name, ' '))::int as d, p_brand as e, case when length(p_name) > 8 then 'long' else 'short' end as f, replace(p_name, 'r', 'R') as g, p_partkey || '-' || p_brand as h, case when p_partkey < 10 then 'x' when p_partkey < 20 then 'y' else 'z' end as i, greatest(1, p_partkey) as j, round(pow(p_partkey, 0.5), 4) as k from part"),
    "time_functions": ('from events | select event_id, h = date_part(ts, "hour"), d = format_time(ts, "%F %T"), b = bin(ts, 1h), s = to_seconds(dur)', "select event_id, hour(make_timestamp(ts))::int as h, strftime(make_timestamp(ts), '%Y-%m-%d %H:%M:%S') as d, ts - ts % 3600000000 as b, dur / 1000000.0::double as s from ev"),
    "array_functions": ('from parts | select p_partkey, a = first(words), b = last(words), d = join(sort(words), "+"), e = index_of(words, "bolt"), f = sum(sizes), g = len(unique(sizes)), h = contains(words, "red"), i = join(slice(words, 1), "+")', "select p_partkey, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b, array_to_string(list_sort(string_split(p_name, ' ')), '+') as d, case when list_position(string_split(p_name, ' '), 'bolt') > 0 then (list_position(string_split(p_name, ' '), 'bolt') - 1)::bigint end as e, (p_size + 10)::double as f, case when p_size = 10 then 1 else 2 end::int as g, list_contains(string_split(p_name, ' '), 'red') as h, split_part(p_name, ' ', 2) as i from part"),
    "call_tree": ("from events | where tid < 3 | call_tree | group tid { n = count() }", "select tid, count(*) as n from ev where tid < 3 group by 1"),
}


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_query(text, None, context(spark, sf_dir, **_PARAMS))

    return run


def entries():
    return {f"lang_{name}": (_query(text), f"with {_EV} {sql}") for name, (text, sql) in _CASES.items()}
