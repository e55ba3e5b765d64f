"""DuckDB SQL for the operators' queries that SQL can express, written from the definitions rather than from the operators."""

from __future__ import annotations

from . import chat, quality

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of a text as op6 takes them, A-Z lower-cased.
_OP6_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
    with d as (select doc_id, {_OP6_WORDS} as w from documents),
    b as (select cast(item_id as varchar) as item_id, {_OP6_WORDS} as w from benchmark),
    items as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
    win as (select distinct item_id, n, array_to_string(w[s : s + n - 1], ' ') as words from (select item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from items)),
    lengths as (select distinct n from win),
    places as (select doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') as words
               from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d cross join lengths where len(w) >= n)),
    hits as (select doc_id, s, n, item_id from places join win using (n, words)),
    covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) group by doc_id),
    found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
    select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join found using (doc_id)"""

#: All pairs that share a shingle, and reachability over the links.
NEAR_DUPLICATES = f"""
    with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
    g as (select distinct doc_id, array_to_string(w[s : s + n - 1], ' ') as x from (select doc_id, w, least(4, len(w)) as n, unnest(generate_series(1, greatest(len(w) - 3, 1))) as s from d where len(w) > 0)),
    sizes as (select doc_id, count(*) as n from g group by doc_id),
    met as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
    links as (select a, b from met join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * i >= 80 * (p.n + q.n - i)),
    edges as (select a, b from links union all select b, a from links),
    reach as (select doc_id as a, doc_id as b from sizes union select r.a, e.b from reach r join edges e on e.a = r.b),
    lowest as (select a, min(b) as component_id from reach group by a)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
    from d left join sizes using (doc_id) left join lowest on a = d.doc_id"""

_METRICS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)::double", "repeat_share": "n_repeat_words / greatest(n_words, 1)::double", "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)::double",
    "word_length": "word_chars / greatest(n_words, 1)::double", "short_words": "-word_chars / greatest(n_words, 1)::double",
}


def quality_sql(alpha: float = 0.05, delta: float = 0.05) -> str:
    """Measures by unnesting, cutoffs by the exact tail through log-gamma."""
    grid = ", ".join(f"('{m}', {c}::double)" for m, cuts in quality.GRID.items() for c in cuts)
    value = "case metric " + " ".join(f"when '{m}' then {e}" for m, e in _METRICS.items()) + " end"
    share, many = alpha / len(quality.GRID), len(quality.GRID)
    return rf"""
    with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
    l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})) as lines from d),
    grams as (select doc_id, s, array_to_string(w[s : s + 2], ' ') as x from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as s from d where len(w) > 2)),
    twice as (select doc_id, s from (select doc_id, s, count(*) over (partition by doc_id, x) as n from grams) where n > 1),
    again as (select doc_id, count(distinct p) as n from (select doc_id, unnest([s, s + 1, s + 2]) as p from twice) group by doc_id),
    m as (select l.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
          (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(again.n, 0)::bigint as n_repeat_words from l left join again using (doc_id)),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
    grid as (select * from (values {grid}) v(metric, cutoff)),
    known as (select distinct doc_id, quality from labels where quality in (0, 1) and doc_id is not null),
    tests as (select lang, metric, cutoff, count_if(quality = 1)::bigint as good, count_if(quality = 0)::bigint as bad, count_if(quality = 1 and {value} > cutoff)::bigint as k, count_if(quality = 0 and {value} > cutoff)::bigint as b
              from f join known using (doc_id) cross join grid where not base_failed group by 1, 2, 3),
    strata as (select count(distinct coalesce(lang, '')) as strata from tests),
    tails as (select *, case when k < good * {share} then (select sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({share}) + (good - i) * ln({1 - share}))) from unnest(generate_series(0::bigint, k)) u(i)) else 1 end as tail from tests),
    passed as (select *, min(case when tail <= {delta / many} / strata then 1 else 0 end) over (partition by lang, metric order by cutoff desc) as ok from tails cross join strata),
    used as (select lang, metric, cutoff from passed where ok = 1 and b > 0 and b * good > k * bad qualify row_number() over (partition by lang, metric order by b desc, cutoff desc) = 1),
    over_it as (select distinct doc_id from f join used on f.lang is not distinct from used.lang where {value} > cutoff)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from over_it) as kept from f"""


def chat_sql(budget: int = 512, history: int = 2) -> str:
    """Windows by recursion over the turns; what is read back is what went in."""
    marks = len(chat.OPEN + chat.ROLE + chat.TEXT + chat.CLOSE)
    escaped = r"regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"
    fits, kept, used = "0", "0", "0"
    for k in range(1, history + 1):
        ok = f"i - {k} >= first and fixed + before - lag(before, {k}, 0) over o + tokens <= {budget}"
        fits = f"case when {ok} then {k} else {fits} end"
        used = f"case when {ok} then before - lag(before, {k}, 0) over o else {used} end"
        kept = f"case when {ok} then shown - lag(shown, {k}, 0) over o else {kept} end"
    return rf"""
    with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    t as (select *, row_number() over o - 1 as i, len(regexp_extract_all(text, {_SPACED})) + {chat.MARKS} as tokens, {marks} + length({escaped.format("role")}) + length({escaped.format("text")}) as size
          from c window o as (partition by conv_id order by turn, role, text)),
    p as (select *, sum(tokens) over r - tokens as before, sum(size) over r - size as shown, case when first_value(role) over r = 'system' then 1 else 0 end as first,
          case when first_value(role) over r = 'system' then first_value(tokens) over r else 0 end as fixed, case when first_value(role) over r = 'system' then first_value(size) over r else 0 end as head
          from t window r as (partition by conv_id order by i rows unbounded preceding)),
    q as (select *, {used} as history_tokens, {kept} as history_size from p window o as (partition by conv_id order by i)),
    run as (select conv_id, i, tokens::bigint as used, 0::bigint as extra from q where i = 0
        union all select q.conv_id, q.i, case when run.used + q.tokens <= {budget} then run.used + q.tokens else q.fixed + q.history_tokens + q.tokens end::bigint,
            case when run.used + q.tokens <= {budget} then 0 else q.head + q.history_size end::bigint from run join q on q.conv_id = run.conv_id and q.i = run.i + 1),
    whole as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by i) as told, coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '') as loss, sum(size) as shown from t group by conv_id)
    select conv_id, n_turns, sha256(told) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, (shown + extra)::bigint as formatted_chars
    from whole join (select conv_id, sum(extra) as extra from run group by conv_id) using (conv_id)"""


ORACLES = {"op4_quality": quality_sql(), "op5_near_duplicates": NEAR_DUPLICATES, "op6_decontamination": DECONTAMINATION, "op10_chat": chat_sql()}
