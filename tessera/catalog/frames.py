"""Frame operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import table as T
from tessera.frame import Frame
from tessera.functions.scalar import micros
from tessera.operators.joins import compare
from tessera.session import load

c = F.col


def orders(spark, sf_dir) -> Frame:
    return Frame(load(spark, sf_dir, "orders"), ["o_orderkey"])


def customers(spark, sf_dir) -> Frame:
    """With a null segment wherever the nation is 3."""
    d = load(spark, sf_dir, "customer")
    return Frame(d.withColumn("c_mktsegment", F.when(c("c_nationkey") != 3, c("c_mktsegment"))), ["c_custkey"])


_CUST = "(select c_custkey, c_name, c_nationkey, c_acctbal, case when c_nationkey <> 3 then c_mktsegment end as c_mktsegment from customer)"
_DAY = "epoch_us(o_orderdate) // 86400000000"


def _days(spark, sf_dir):
    return orders(spark, sf_dir).with_column("day", F.floor(micros("o_orderdate") / 86_400_000_000).cast("bigint"))


def _describe(spark, sf_dir):
    d = orders(spark, sf_dir).select("o_custkey", "o_totalprice").describe().df
    return d.select("statistic", F.round("o_custkey", 3).alias("o_custkey"), F.round("o_totalprice", 3).alias("o_totalprice"))


def _flags(name):
    return lambda s, d: getattr(customers(s, d).select("c_nationkey", "c_mktsegment"), name)("v").df.groupBy("c_nationkey", "c_mktsegment", "v").agg(F.count(F.lit(1)).alias("n"))


def _compare(spark, sf_dir):
    o = load(spark, sf_dir, "orders")

    def by(status):
        return o.where(c("o_orderstatus") == status).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))

    out = compare(by("F"), by("O"), ["o_orderpriority"])
    return out.withColumns({k: F.round(k, 3) for k in ("delta_n", "pct_n", "delta_mean", "pct_mean")})


def _corr(spark, sf_dir):
    m = Frame(load(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")).corr().df
    return m.select("column", *[F.round(x, 5).alias(x) for x in ("l_quantity", "l_extendedprice", "l_discount")])


_PAIR = "round(corr(l_quantity, {0}), 5) as l_quantity, round(corr(l_extendedprice, {0}), 5) as l_extendedprice, round(corr(l_discount, {0}), 5) as l_discount from lineitem"

#: name: (query, SQL).
_CASES = {
    "head": (lambda s, d: orders(s, d).head(20).df, "select * from orders order by o_orderkey limit 20"),
    "tail": (lambda s, d: orders(s, d).tail(20).df, "select * from orders order by o_orderkey desc limit 20"),
    "slice": (lambda s, d: orders(s, d).slice(100, 25).df, "select * from orders order by o_orderkey limit 25 offset 100"),
    "reverse": (lambda s, d: orders(s, d).reverse().df, "select * from orders"),
    "filter": (lambda s, d: orders(s, d).filter(c("o_totalprice") > 300000).df, "select * from orders where o_totalprice > 300000"),
    "select": (lambda s, d: orders(s, d).select("o_orderkey", "o_custkey").df, "select o_orderkey, o_custkey from orders"),
    "with_column": (lambda s, d: orders(s, d).with_column("k", c("o_custkey") * 2).select("o_orderkey", "k").df, "select o_orderkey, o_custkey * 2 as k from orders"),
    "drop": (lambda s, d: orders(s, d).drop("o_orderdate", "absent").df, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"),
    "rename": (lambda s, d: Frame(load(s, d, "nation")).rename(["a", "b", "c"]).df, "select n_nationkey as a, n_name as b, n_regionkey as c from nation"),
    "rename_columns": (lambda s, d: Frame(load(s, d, "nation")).rename({"n_name": "name"}).df, "select n_nationkey, n_name as name, n_regionkey from nation"),
    "drop_nulls": (lambda s, d: customers(s, d).drop_nulls().df, f"select * from {_CUST} where c_mktsegment is not null"),
    "fill_null": (lambda s, d: customers(s, d).fill_null("none").df, f"select * replace (coalesce(c_mktsegment, 'none') as c_mktsegment) from {_CUST}"),
    "unique": (lambda s, d: customers(s, d).select("c_nationkey", "c_mktsegment").unique().df, f"select distinct c_nationkey, c_mktsegment from {_CUST}"),
    "unique_by": (lambda s, d: orders(s, d).unique_by(["o_custkey"]).df, "select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1"),
    "head_by": (lambda s, d: orders(s, d).head_by(["o_custkey"], 2).df, "select * from orders qualify row_number() over (partition by o_custkey order by o_orderkey) <= 2"),
    "topk": (lambda s, d: orders(s, d).topk("o_totalprice", 10).df, "select * from orders order by o_totalprice desc, o_orderkey limit 10"),
    "topk_smallest": (lambda s, d: orders(s, d).topk("o_totalprice", 10, False).df, "select * from orders order by o_totalprice, o_orderkey limit 10"),
    "sort_by": (lambda s, d: customers(s, d).sort_by("c_mktsegment").df, f"select * from {_CUST} order by c_mktsegment nulls last, c_custkey"),
    "sort_by_multi": (lambda s, d: customers(s, d).sort_by(["c_mktsegment", "c_nationkey"], [True, False]).df, f"select * from {_CUST} order by c_mktsegment desc nulls last, c_nationkey, c_custkey"),
    "null_count": (lambda s, d: customers(s, d).null_count().df, f"select count_if(c_custkey is null)::bigint as c_custkey, count_if(c_name is null)::bigint as c_name, count_if(c_nationkey is null)::bigint as c_nationkey, count_if(c_acctbal is null)::bigint as c_acctbal, count_if(c_mktsegment is null)::bigint as c_mktsegment from {_CUST}"),
    "value_counts": (lambda s, d: customers(s, d).value_counts("c_mktsegment").df, f"select c_mktsegment as value, count(*) as count from {_CUST} where c_mktsegment is not null group by 1"),
    "describe": (_describe, " union all ".join(f"select '{n}' as statistic, round({f.format('o_custkey')}::double, 3) as o_custkey, round({f.format('o_totalprice')}::double, 3) as o_totalprice from orders" for n, f in (("count", "count({})"), ("null_count", "count_if({} is null)"), ("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})")))),
    "is_duplicated": (_flags("is_duplicated"), f"select c_nationkey, c_mktsegment, count(*) > 1 as v, count(*) as n from {_CUST} group by 1, 2"),
    "is_unique": (_flags("is_unique"), f"select c_nationkey, c_mktsegment, count(*) = 1 as v, count(*) as n from {_CUST} group by 1, 2"),
    "take": (lambda s, d: orders(s, d).take([5, 0, 5, -1, 7]).select("_at", "o_orderkey").df, "select i - 1 as _at, o_orderkey from (values (1, 5), (2, 0), (3, 5), (4, -1), (5, 7)) t(i, k) left join (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) on k = r"),
    "gather_every": (lambda s, d: orders(s, d).gather_every(10, 3).select("o_orderkey").df, "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) where r >= 3 and (r - 3) % 10 = 0"),
    "to_dummies": (lambda s, d: customers(s, d).select("c_custkey", "c_mktsegment").to_dummies("c_mktsegment").df, "select c_custkey, " + ", ".join(f"cast(coalesce(c_mktsegment = '{v}', false) as tinyint) as \"c_mktsegment_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + f" from {_CUST}"),
    "explode": (lambda s, d: Frame(load(s, d, "part").select("p_partkey", F.when(c("p_size") > 5, F.split("p_name", " ")).alias("w"))).explode("w").df, "select p_partkey, unnest(case when p_size > 5 then string_split(p_name, ' ') else [null] end) as w from part"),
    "unnest": (lambda s, d: Frame(load(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("x"))).unnest("x").df, "select o_custkey, o_orderkey, o_orderstatus from orders"),
    "unpivot": (lambda s, d: Frame(load(s, d, "lineitem")).unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount"]).df, "select l_orderkey, l_linenumber, l_partkey, 'l_quantity' as variable, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount from lineitem"),
    "pivot": (lambda s, d: Frame(load(s, d, "orders")).pivot(["o_custkey"], "o_orderstatus", "o_orderkey", "count_valid").df, "select o_custkey, " + ", ".join(f"nullif(count_if(o_orderstatus = '{v}'), 0)::bigint as \"{v}\"" for v in "FOP") + " from orders group by 1"),
    "concat": (lambda s, d: Frame(load(s, d, "nation").select("n_name")).concat(Frame(load(s, d, "nation").select("n_name"))).df, "select n_name from nation union all select n_name from nation"),
    "concat_diagonal": (lambda s, d: Frame(load(s, d, "nation").select("n_name")).concat(Frame(load(s, d, "region").select("r_name")), "diagonal").df, "select n_name, null as r_name from nation union all select null, r_name from region"),
    "union": (lambda s, d: Frame(load(s, d, "customer").select(c("c_nationkey").alias("k"))).union(Frame(load(s, d, "supplier").select(c("s_nationkey").alias("k")))).df, "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "intersect": (lambda s, d: Frame(load(s, d, "customer").select(c("c_nationkey").alias("k"))).intersect(Frame(load(s, d, "supplier").select(c("s_nationkey").alias("k")))).df, "select c_nationkey as k from customer intersect select s_nationkey from supplier"),
    "subtract": (lambda s, d: Frame(load(s, d, "nation").select(c("n_nationkey").alias("k"))).subtract(Frame(load(s, d, "supplier").select(c("s_nationkey").alias("k")))).df, "select n_nationkey as k from nation except select s_nationkey from supplier"),
    "group_by": (lambda s, d: customers(s, d).group_by(["c_mktsegment"], {"n": ("count", None), "low": ("min", "c_acctbal")}).df, f"select c_mktsegment, count(*) as n, min(c_acctbal) as low from {_CUST} group by 1"),
    "group_by_dropna": (lambda s, d: customers(s, d).group_by(["c_mktsegment"], {"n": ("count", None)}, dropna=True).df, f"select c_mktsegment, count(*) as n from {_CUST} where c_mktsegment is not null group by 1"),
    "reduce": (lambda s, d: Frame(load(s, d, "part")).reduce("max").df, "select max(p_partkey) as p_partkey, max(p_name) as p_name, max(p_brand) as p_brand, max(p_type) as p_type, max(p_size) as p_size, max(p_retailprice) as p_retailprice from part"),
    "horizontal": (lambda s, d: Frame(load(s, d, "lineitem")).horizontal("mean", ["l_quantity", "l_discount", "l_tax"], "v").df.select("l_orderkey", "l_linenumber", "l_partkey", F.round("v", 6).alias("v")), "select l_orderkey, l_linenumber, l_partkey, round((l_quantity + l_discount + l_tax) / 3, 6) as v from lineitem"),
    "compare_agg": (_compare, "with g as (select o_orderpriority, o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1, 2), a as (select * from g where o_orderstatus = 'F'), b as (select * from g where o_orderstatus = 'O') select coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, a.n as l_n, b.n as r_n, round((b.n - a.n)::double, 3) as delta_n, round((b.n - a.n)::double / a.n * 100, 3) as pct_n, a.mean as l_mean, b.mean as r_mean, round(b.mean - a.mean, 3) as delta_mean, round((b.mean - a.mean) / a.mean * 100, 3) as pct_mean from a full join b using (o_orderpriority)"),
    "corr_matrix": (_corr, " union all ".join(f"select '{x}' as column, {_PAIR.format(x)}" for x in ("l_quantity", "l_extendedprice", "l_discount"))),
    "group_by_dynamic": (lambda s, d: _days(s, d).group_by_dynamic("day", 30, 30, {"n": ("count", None), "top": ("max", "o_totalprice")}).df, f"select d - d % 30 as bucket, count(*) as n, max(o_totalprice) as top from (select *, {_DAY} as d from orders) group by 1"),
    "group_by_hopping": (lambda s, d: _days(s, d).group_by_dynamic("day", 10, 30, {"n": ("count", None)}).df, f"select b as bucket, count(*) as n from (select *, {_DAY} as d from orders), unnest([d - d % 10, d - d % 10 - 10, d - d % 10 - 20]) t(b) where d >= b and d < b + 30 group by 1"),
    "set_axis": (lambda s, d: T.set_axis(Frame(load(s, d, "nation"), ["n_nationkey"]), ["a", "b", "c"]).df, "select n_nationkey as a, n_name as b, n_regionkey as c from nation"),
    "rename_axis": (lambda s, d: T.rename_axis(orders(s, d), "k").select("k", "o_custkey").df, "select o_orderkey as k, o_custkey from orders"),
    "insert": (lambda s, d: T.insert(orders(s, d).select("o_orderkey"), 0, "twice", c("o_orderkey") * 2).df, "select o_orderkey * 2 as twice, o_orderkey from orders"),
    "pop": (lambda s, d: T.pop(orders(s, d), "o_custkey")[0].df, "select o_orderkey, o_custkey from orders"),
    "get_column": (lambda s, d: T.get_column(customers(s, d), "c_mktsegment").df, f"select c_mktsegment from {_CUST}"),
    "xs": (lambda s, d: T.xs(customers(s, d), 3, "c_nationkey").df, f"select * exclude (c_nationkey) from {_CUST} where c_nationkey = 3"),
    "sort_index": (lambda s, d: T.sort_index(orders(s, d), False).df, "select * from orders order by o_orderkey desc"),
    "applymap": (lambda s, d: T.applymap(customers(s, d).select("c_custkey", "c_nationkey", "c_acctbal"), lambda x: F.round(x * 2, 2)).df, "select c_custkey, c_nationkey * 2 as c_nationkey, round(c_acctbal * 2, 2) as c_acctbal from customer"),
    "combine": (lambda s, d: T.combine(orders(s, d).select("o_orderkey", "o_custkey"), orders(s, d).filter(c("o_custkey") > 50).select("o_orderkey", "o_custkey"), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).df, "with a as (select *, row_number() over (order by o_orderkey) as r from orders), b as (select *, row_number() over (order by o_orderkey) as r from orders where o_custkey > 50) select a.r - 1 as _row, a.o_orderkey - coalesce(b.o_orderkey, 0) as o_orderkey, a.o_custkey - coalesce(b.o_custkey, 0) as o_custkey from a left join b using (r)"),
    "argsort": (lambda s, d: T.argsort(customers(s, d), "c_mktsegment").df, f"select row_number() over (order by c_mktsegment nulls last, p) - 1 as _at, p as position from (select c_mktsegment, row_number() over (order by c_custkey) - 1 as p from {_CUST})"),
    "groups": (lambda s, d: T.groups(customers(s, d), ["c_mktsegment"]).df, f"select c_mktsegment, row_number() over (order by c_custkey) - 1 as positions from {_CUST}"),
    "partition_by": (lambda s, d: T.partition_by(customers(s, d), "c_mktsegment")[1].df, f"select * from {_CUST} where c_mktsegment = (select distinct c_mktsegment from {_CUST} order by 1 nulls last limit 1 offset 1)"),
    "info": (lambda s, d: T.info(customers(s, d).select("c_custkey", "c_mktsegment")).select("column", "non_null").df, f"select 'c_custkey' as column, count(*) as non_null from customer union all select 'c_mktsegment', count(c_mktsegment) from {_CUST}"),
    "sample": (lambda s, d: orders(s, d).sample(100, 7).df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("k")), "select 100::bigint as n, 100::bigint as k"),
    "partition_id": (lambda s, d: orders(s, d).partition_id(["o_custkey"], 16).df.groupBy("o_custkey").agg(F.count_distinct("partition_id").alias("n")), "select o_custkey, 1::bigint as n from orders group by 1"),
}


def entries():
    return {f"frame_{name}": case for name, case in _CASES.items()}
