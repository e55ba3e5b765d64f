"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import SCALARS as S
from tessera.functions.scalar import micros
from tessera.session import load

c = F.col
#: name: (table, key, expression, SQL). Doubles are rounded on both sides.
_CASES = {
    "add": ("orders", "o_orderkey", lambda: S["add"](c("o_custkey"), c("o_orderkey")), "o_custkey + o_orderkey"),
    "sub": ("orders", "o_orderkey", lambda: S["sub"](c("o_custkey"), c("o_orderkey")), "o_custkey - o_orderkey"),
    "mul": ("orders", "o_orderkey", lambda: S["mul"](c("o_custkey"), 7), "o_custkey * 7"),
    "div": ("orders", "o_orderkey", lambda: F.round(S["div"](c("o_totalprice"), c("o_custkey") % 5), 6), "round(o_totalprice / nullif(o_custkey % 5, 0), 6)"),
    "mod": ("orders", "o_orderkey", lambda: S["mod"](c("o_custkey") - 500, c("o_orderkey") % 7 - 3), "case when o_orderkey % 7 = 3 then null else (((o_custkey - 500) % (o_orderkey % 7 - 3)) + (o_orderkey % 7 - 3)) % (o_orderkey % 7 - 3) end"),
    "floordiv": ("orders", "o_orderkey", lambda: S["floordiv"](c("o_custkey") - 500, c("o_orderkey") % 7 - 3), "cast(floor((o_custkey - 500)::double / nullif(o_orderkey % 7 - 3, 0)) as bigint)"),
    "pow": ("part", "p_partkey", lambda: F.round(S["pow"](c("p_size"), 1.5), 6), "round(pow(p_size, 1.5), 6)"),
    "abs": ("customer", "c_custkey", lambda: S["abs"](c("c_acctbal")), "abs(c_acctbal)"),
    "round": ("customer", "c_custkey", lambda: S["round"](c("c_acctbal"), 1), "round(c_acctbal, 1)"),
    "ceil": ("customer", "c_custkey", lambda: S["ceil"](c("c_acctbal")), "cast(ceil(c_acctbal) as bigint)"),
    "floor": ("customer", "c_custkey", lambda: S["floor"](c("c_acctbal")), "cast(floor(c_acctbal) as bigint)"),
    "trunc": ("customer", "c_custkey", lambda: S["trunc"](c("c_acctbal")), "cast(trunc(c_acctbal) as bigint)"),
    "sign": ("customer", "c_custkey", lambda: S["sign"](c("c_acctbal")), "cast(sign(c_acctbal) as double)"),
    "negate": ("customer", "c_custkey", lambda: S["negate"](c("c_acctbal")), "-c_acctbal"),
    "sqrt": ("part", "p_partkey", lambda: F.round(S["sqrt"](c("p_retailprice")), 6), "round(sqrt(p_retailprice), 6)"),
    "exp": ("part", "p_partkey", lambda: F.round(S["exp"](c("p_size") / 50), 6), "round(exp(p_size / 50.0), 6)"),
    "log": ("customer", "c_custkey", lambda: F.round(S["log"](c("c_acctbal")), 6), "case when c_acctbal > 0 then round(ln(c_acctbal), 6) end"),
    "ilog2": ("part", "p_partkey", lambda: S["ilog2"](c("p_partkey")).cast("bigint"), "case when p_partkey > 0 then length(bin(p_partkey)) - 1 end"),
    "popcount": ("part", "p_partkey", lambda: S["popcount"](c("p_partkey")).cast("bigint"), "cast(bit_count(p_partkey) as bigint)"),
    "bit_width": ("part", "p_partkey", lambda: S["bit_width"](c("p_partkey")).cast("bigint"), "case when p_partkey = 0 then 0 else length(bin(p_partkey)) end"),
    "clz": ("part", "p_partkey", lambda: S["clz"](c("p_partkey")).cast("bigint"), "64 - case when p_partkey = 0 then 0 else length(bin(p_partkey)) end"),
    "ctz": ("part", "p_partkey", lambda: S["ctz"](c("p_partkey")).cast("bigint"), "case when p_partkey = 0 then 64 else length(bin(p_partkey)) - length(rtrim(bin(p_partkey), '0')) end"),
    "clip": ("customer", "c_custkey", lambda: S["clip"](c("c_acctbal"), 0.0, 5000.0), "least(greatest(c_acctbal, 0.0::double), 5000.0::double)"),
    "min_of": ("customer", "c_custkey", lambda: S["min"](F.nullif(c("c_nationkey"), F.lit(3)), F.lit(10)), "case when c_nationkey <> 3 then least(c_nationkey, 10) end"),
    "max_of": ("customer", "c_custkey", lambda: S["max"](F.nullif(c("c_nationkey"), F.lit(3)), F.lit(10)), "case when c_nationkey <> 3 then greatest(c_nationkey, 10) end"),
    "cut": ("part", "p_partkey", lambda: S["cut"](c("p_size"), [0, 10, 25, 40]), "case when p_size > 0 and p_size <= 10 then 0 when p_size > 10 and p_size <= 25 then 1 when p_size > 25 and p_size <= 40 then 2 end"),
    "search_sorted": ("part", "p_partkey", lambda: S["search_sorted"](c("p_size"), [10, 20, 30]), "(p_size > 10)::int + (p_size > 20)::int + (p_size > 30)::int"),
    "is_finite": ("customer", "c_custkey", lambda: S["is_finite"](F.try_divide(c("c_acctbal"), c("c_nationkey").cast("double"))), "isfinite(c_acctbal / nullif(c_nationkey, 0))"),
    "is_infinite": ("customer", "c_custkey", lambda: S["is_infinite"](c("c_acctbal")), "isinf(c_acctbal)"),
    "is_nan": ("customer", "c_custkey", lambda: S["is_nan"](c("c_acctbal")), "isnan(c_acctbal)"),
    "null_mask": ("customer", "c_custkey", lambda: S["null_mask"](F.nullif(c("c_nationkey"), F.lit(3))), "nullif(c_nationkey, 3) is null"),
    "valid_mask": ("customer", "c_custkey", lambda: S["valid_mask"](F.nullif(c("c_nationkey"), F.lit(3))), "nullif(c_nationkey, 3) is not null"),
    "fillna": ("customer", "c_custkey", lambda: S["fillna"](F.nullif(c("c_nationkey"), F.lit(3)), -1), "coalesce(nullif(c_nationkey, 3), -1)"),
    "is_between": ("customer", "c_custkey", lambda: S["is_between"](c("c_acctbal"), 0, 1000), "c_acctbal between 0 and 1000"),
    "where": ("customer", "c_custkey", lambda: S["where"](c("c_acctbal") > 0, c("c_nationkey"), -1), "case when c_acctbal > 0 then c_nationkey else -1 end"),
    "is_in": ("customer", "c_custkey", lambda: S["is_in"](c("c_mktsegment"), ["BUILDING", "MACHINERY"]), "c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "cast": ("orders", "o_orderkey", lambda: S["cast"](F.substr("o_orderpriority", F.lit(1), F.lit(2)), "int"), "try_cast(substr(o_orderpriority, 1, 2) as int)"),
    "compare_exact": ("orders", "o_orderkey", lambda: (c("o_custkey") + 9007199254740000).cast("decimal(38,6)") == F.lit(9007199254740992.0).cast("decimal(38,6)"), "o_custkey + 9007199254740000 = 9007199254740992"),
    "logical_and_or_not": ("customer", "c_custkey", lambda: ((c("c_acctbal") > 0) & ~(c("c_nationkey") == 3)) | F.nullif(c("c_nationkey"), F.lit(5)).isNull(), "(c_acctbal > 0 and not c_nationkey = 3) or nullif(c_nationkey, 5) is null"),
    "to_lowercase": ("part", "p_partkey", lambda: S["lower"](c("p_type")), "lower(p_type)"),
    "to_uppercase": ("part", "p_partkey", lambda: S["upper"](c("p_name")), "upper(p_name)"),
    "str_strip": ("part", "p_partkey", lambda: S["strip"](F.concat(F.lit(" \t"), "p_name", F.lit("\n "))), "p_name"),
    "str_lstrip": ("part", "p_partkey", lambda: S["lstrip"](F.concat(F.lit(" "), "p_name", F.lit(" "))), "concat(p_name, ' ')"),
    "str_rstrip": ("part", "p_partkey", lambda: S["rstrip"](F.concat(F.lit(" "), "p_name", F.lit(" "))), "concat(' ', p_name)"),
    "str_find": ("part", "p_partkey", lambda: S["find"](c("p_name"), "l"), "cast(instr(p_name, 'l') - 1 as int)"),
    "str_rfind": ("part", "p_partkey", lambda: S["rfind"](c("p_name"), "l"), "cast(case when instr(p_name, 'l') = 0 then -1 else length(p_name) - instr(reverse(p_name), 'l') end as int)"),
    "str_replace": ("part", "p_partkey", lambda: S["replace"](c("p_name"), "l", "LL"), "regexp_replace(p_name, 'l', 'LL')"),
    "str_replace_all": ("part", "p_partkey", lambda: S["replace_all"](c("p_name"), "l", "LL"), "replace(p_name, 'l', 'LL')"),
    "str_slice": ("part", "p_partkey", lambda: S["substr"](c("p_name"), 2, 4), "substr(p_name, 3, 4)"),
    "str_slice_bytes": ("part", "p_partkey", lambda: S["slice_bytes"](c("p_name"), 1, 3), "substr(p_name, 2, 3)"),
    "str_pad_start": ("part", "p_partkey", lambda: S["pad_start"](c("p_name"), 12, "*"), "case when length(p_name) >= 12 then p_name else lpad(p_name, 12, '*') end"),
    "str_pad_end": ("part", "p_partkey", lambda: S["pad_end"](c("p_name"), 12, "*"), "case when length(p_name) >= 12 then p_name else rpad(p_name, 12, '*') end"),
    "str_center": ("part", "p_partkey", lambda: S["center"](c("p_name"), 14, "."), "concat(repeat('.', cast(greatest(14 - length(p_name), 0) // 2 as int)), p_name, repeat('.', cast(greatest(14 - length(p_name), 0) - greatest(14 - length(p_name), 0) // 2 as int)))"),
    "str_zfill": ("part", "p_partkey", lambda: S["zfill"]((c("p_size") - 25).cast("string"), 5), "case when p_size < 25 then concat('-', lpad(cast(25 - p_size as varchar), 4, '0')) else lpad(cast(p_size - 25 as varchar), 5, '0') end"),
    "str_split": ("part", "p_partkey", lambda: S["list_get"](S["split"](c("p_name"), " "), -1), "list_extract(string_split(p_name, ' '), -1)"),
    "str_partition": ("part", "p_partkey", lambda: F.array_join(S["partition"](c("p_name"), " "), "|"), "concat(split_part(p_name, ' ', 1), '| |', substr(p_name, instr(p_name, ' ') + 1))"),
    "str_rpartition": ("part", "p_partkey", lambda: F.array_join(S["partition"](c("p_name"), "zz", True), "|"), "concat('||', p_name)"),
    "str_matches": ("part", "p_partkey", lambda: S["matches"](c("p_name"), "[a-z]+ [a-z]+"), "regexp_full_match(p_name, '[a-z]+ [a-z]+')"),
    "str_search": ("part", "p_partkey", lambda: S["search"](c("p_name"), "r.*g$"), "regexp_matches(p_name, 'r.*g$')"),
    "str_extract": ("part", "p_partkey", lambda: S["extract"](c("p_brand"), "#([1-9])$", 1), "case when regexp_matches(p_brand, '#([1-9])$') then regexp_extract(p_brand, '#([1-9])$', 1) end"),
    "str_findall": ("part", "p_partkey", lambda: F.array_join(S["findall"](c("p_name"), "[aeiou]"), ""), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '')"),
    "str_regex_replace": ("part", "p_partkey", lambda: S["regex_replace"](c("p_name"), "([aeiou])", "<$1>"), "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')"),
    "str_count": ("part", "p_partkey", lambda: S["count_text"](c("p_name"), "l"), "cast(length(p_name) - length(replace(p_name, 'l', '')) as int)"),
    "str_remove_prefix": ("part", "p_partkey", lambda: S["remove_prefix"](c("p_brand"), "Brand#1"), "case when starts_with(p_brand, 'Brand#1') then substr(p_brand, 8) else p_brand end"),
    "str_remove_suffix": ("part", "p_partkey", lambda: S["remove_suffix"](c("p_name"), "ring"), "case when ends_with(p_name, 'ring') then substr(p_name, 1, length(p_name) - 4) else p_name end"),
    "str_capitalize": ("part", "p_partkey", lambda: S["capitalize"](c("p_type")), "concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)))"),
    "str_title": ("part", "p_partkey", lambda: S["title"](c("p_name")), "concat(upper(substr(p_name, 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2))"),
    "str_swapcase": ("part", "p_partkey", lambda: S["swapcase"](F.concat(c("p_name"), c("p_type"))), "concat(upper(p_name), lower(p_type))"),
    "str_isalpha": ("part", "p_partkey", lambda: S["is_class"](c("p_type"), "alpha"), "regexp_full_match(p_type, '[A-Za-z]+')"),
    "str_isdigit": ("part", "p_partkey", lambda: S["is_class"](c("p_brand").substr(7, 9), "digit"), "regexp_full_match(substr(p_brand, 7), '[0-9]+')"),
    "str_isupper": ("part", "p_partkey", lambda: S["is_class"](c("p_brand"), "upper"), "false"),
    "str_like": ("part", "p_partkey", lambda: S["like"](c("p_name"), "%r_n%"), "p_name like '%r_n%'"),
    "str_ilike": ("part", "p_partkey", lambda: S["like"](S["lower"](c("p_type")), "%o%"), "p_type ilike '%O%'"),
    "str_len_bytes": ("documents", "doc_id", lambda: S["len_bytes"](c("text")), "cast(strlen(text) as int)"),
    "str_len_chars": ("documents", "doc_id", lambda: S["len_chars"](c("text")), "cast(length(text) as int)"),
    "str_contains": ("documents", "doc_id", lambda: S["contains"](c("text"), "Licensed"), "contains(text, 'Licensed')"),
    "str_starts_with": ("pages", "page_id", lambda: S["starts_with"](c("url"), "https://"), "starts_with(url, 'https://')"),
    "str_ends_with": ("pages", "page_id", lambda: S["ends_with"](c("url"), ".html"), "ends_with(url, '.html')"),
    "str_repeat": ("part", "p_partkey", lambda: S["repeat"](c("p_name"), 3), "repeat(p_name, 3)"),
    "str_cat": ("part", "p_partkey", lambda: S["cat"](c("p_name"), F.nullif(c("p_brand"), F.lit("Brand#2"))), "p_name || nullif(p_brand, 'Brand#2')"),
    "hex_format64": ("part", "p_partkey", lambda: S["hex_format"](c("p_partkey")), "lpad(lower(to_hex(p_partkey)), 16, '0')"),
    "hex_parse64": ("part", "p_partkey", lambda: S["hex_parse"](S["hex_format"](c("p_partkey")).substr(2, 15)), "p_partkey"),
    "str_translate": ("part", "p_partkey", lambda: S["translate"](c("p_name"), {"a": "4", "e": "3", "l": ""}), "replace(translate(p_name, 'ae', '43'), 'l', '')"),
    "list_len": ("part", "p_partkey", lambda: S["list_len"](F.split("p_name", "")), "length(p_name)::int"),
    "list_get": ("part", "p_partkey", lambda: S["list_get"](F.split("p_name", " "), 1), "list_extract(string_split(p_name, ' '), 2)"),
    "list_join": ("part", "p_partkey", lambda: S["list_join"](F.split("p_name", " "), "-"), "replace(p_name, ' ', '-')"),
    "list_sort": ("part", "p_partkey", lambda: F.array_join(S["list_sort"](F.split("p_name", "")), ""), "array_to_string(list_sort(string_split(p_name, '')), '')"),
    "list_unique": ("part", "p_partkey", lambda: F.size(S["list_unique"](F.split("p_name", ""))), "cast(len(list_distinct(string_split(p_name, ''))) as int)"),
    "list_index_of": ("part", "p_partkey", lambda: S["index_of"](F.split("p_name", ""), "l"), "case when instr(p_name, 'l') > 0 then cast(instr(p_name, 'l') - 1 as bigint) end"),
    "list_sum": ("embeddings", "vec_id", lambda: F.round(S["list_sum"](c("embedding")), 2) + 0.0, "round(list_sum(list_transform(embedding, lambda x: x::double)), 2) + 0.0::double"),
    "list_slice": ("part", "p_partkey", lambda: F.array_join(S["list_slice"](F.split("p_name", ""), 1, -1), ""), "substr(p_name, 2, length(p_name) - 2)"),
    "list_contains": ("part", "p_partkey", lambda: S["list_contains"](F.split("p_name", ""), "z"), "contains(p_name, 'z')"),
    "dt_year": ("orders", "o_orderkey", lambda: S["date_part"]("year", c("o_orderdate")), "cast(year(o_orderdate) as int)"),
    "dt_quarter": ("orders", "o_orderkey", lambda: S["date_part"]("quarter", c("o_orderdate")), "cast(quarter(o_orderdate) as int)"),
    "dt_dayofweek": ("orders", "o_orderkey", lambda: S["date_part"]("dayofweek", c("o_orderdate")), "cast(isodow(o_orderdate) - 1 as int)"),
    "dt_dayofyear": ("orders", "o_orderkey", lambda: S["date_part"]("dayofyear", c("o_orderdate")), "cast(dayofyear(o_orderdate) as int)"),
    "dt_isoweek": ("orders", "o_orderkey", lambda: S["date_part"]("week", c("o_orderdate")), "cast(weekofyear(o_orderdate) as int)"),
    "dt_isoyear": ("orders", "o_orderkey", lambda: S["date_part"]("isoyear", c("o_orderdate")), "cast(isoyear(o_orderdate) as int)"),
    "dt_hour": ("events", "event_id", lambda: S["date_part"]("hour", c("ts")), "cast(hour(ts) as int)"),
    "dt_second": ("events", "event_id", lambda: S["date_part"]("second", c("ts")), "cast(second(ts) as int)"),
    "dt_microsecond": ("events", "event_id", lambda: S["date_part"]("microsecond", c("ts")), "cast(epoch_us(ts) % 1000000 as bigint)"),
    "dt_days_in_month": ("orders", "o_orderkey", lambda: S["date_part"]("days_in_month", c("o_orderdate")), "cast(day(last_day(o_orderdate)) as int)"),
    "dt_is_month_end": ("orders", "o_orderkey", lambda: S["date_part"]("is_month_end", c("o_orderdate")), "last_day(o_orderdate) = o_orderdate::date"),
    "dt_is_leap_year": ("orders", "o_orderkey", lambda: S["date_part"]("is_leap_year", c("o_orderdate")), "year(o_orderdate) % 4 = 0 and (year(o_orderdate) % 100 <> 0 or year(o_orderdate) % 400 = 0)"),
    "dt_is_quarter_start": ("orders", "o_orderkey", lambda: S["date_part"]("is_quarter_start", c("o_orderdate")), "o_orderdate::date = date_trunc('quarter', o_orderdate)::date"),
    "dt_is_quarter_end": ("orders", "o_orderkey", lambda: S["date_part"]("is_quarter_end", c("o_orderdate")), "(o_orderdate::date + 1)::date = date_trunc('quarter', o_orderdate::date + 1)::date"),
    "dt_format": ("events", "event_id", lambda: S["format_time"](c("ts"), "%Y-%m-%d %H:%M:%S.%f"), "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"),
    "dt_floor": ("events", "event_id", lambda: S["round_time"](micros("ts"), 60_000_000), "epoch_us(ts) - epoch_us(ts) % 60000000"),
    "dt_ceil": ("events", "event_id", lambda: S["round_time"](micros("ts"), 60_000_000, "ceil"), "((epoch_us(ts) + 59999999) // 60000000) * 60000000"),
    "dt_round": ("events", "event_id", lambda: S["round_time"](c("event_id"), 10, "round"), "cast(case when event_id % 10 > 5 or (event_id % 10 = 5 and (event_id // 10) % 2 = 1) then event_id - event_id % 10 + 10 else event_id - event_id % 10 end as bigint)"),
    "bin": ("events", "event_id", lambda: S["bin"](micros("ts"), 3_600_000_000, 7), "epoch_us(ts) - (epoch_us(ts) - 7) % 3600000000"),
    "json_path": ("events", "event_id", lambda: F.get_json_object("props", "$.k").cast("bigint"), "cast(json_extract_string(props, '$.k') as bigint)"),
}


def _query(table, key, make):
    return lambda spark, sf_dir: load(spark, sf_dir, table).select(key, make().alias("v"))


def entries():
    return {f"fn_{name}": (_query(table, key, make), f"select {key}, {sql} as v from {table}") for name, (table, key, make, sql) in _CASES.items()}
