"""Chat formatting in budgeted windows, in DataFrame functions alone.

A conversation is cut into windows of at most ``budget`` tokens.  Prefix sums of
the turns' token counts choose the spans, which are aligned to turns.  Every
window after the first repeats the system turn, where the conversation begins
with one, and up to ``history`` turns from before its span, as many as fit.  The
loss mask covers the text of assistant turns, each once: repeated turns are
masked out.

The template writes a turn as ``<s>[INST]role[/INST]text</s>``.  Control strings
inside roles and texts are escaped by one more backslash after their first
character, which ``unescape`` takes away again, so that a window can be read back
exactly whatever its texts say.

Tokens are words, plus ``MARKS`` for a turn's marks.

Defined results
---------------
* text or role null: as empty; a null conversation id is a conversation of its own;
* turns are ordered by turn (null first), role, text; repeated rows are repeated turns;
* very long texts, a turn of over ``budget`` tokens: whole, in a window without other new turns;
* other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MARKS = 4
# Template marks; fixed values.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string: its first character, backslashes, and the rest.
_CONTROL = r"(/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", r"$1$2$3")


def windows(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 512, history: int = 2) -> DataFrame:
    """Rows (``key``, window, formatted, n_repeated, n_new, loss); loss lists (start, end) in code points of ``formatted``."""
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    base = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("tokens", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")) + MARKS)
    base = base.withColumn("i", F.row_number().over(order) - 1).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    part = F.struct("i", "tokens", "before", "role", "text")
    conv = base.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("t"))
    conv = conv.withColumn("first", F.expr("case when t[0].role = 'system' then 1 else 0 end")).withColumn("fixed", F.expr("case when first = 1 then cast(t[0].tokens as bigint) else 0L end"))
    # How many turns of history fit before turn x: the most of 0 .. history.
    fit = "0"
    for k in range(1, history + 1):
        fit = f"case when x.i - {k} >= first and fixed + x.before - get(t, x.i - {k}).before + x.tokens <= {budget} then {k} else {fit} end"
    started = f"struct(concat(a.spans, array(struct(x.i as s, {fit} as k))) as spans, fixed + x.before - coalesce(get(t, x.i - ({fit})).before, x.before) + x.tokens as used)"
    conv = conv.withColumn("spans", F.expr(f"""aggregate(t, struct(cast(array() as array<struct<s: int, k: int>>) as spans, 0L as used),
        (a, x) -> case when x.i = 0 then struct(array(struct(0 as s, 0 as k)) as spans, cast(x.tokens as bigint) as used)
            when a.used + x.tokens <= {budget} then struct(a.spans as spans, a.used + x.tokens as used) else {started} end, a -> a.spans)"""))
    conv = conv.withColumn("cut", F.expr("""transform(spans, (w, j) -> struct(j as window, w.s as s, case when w.s > 0 then first else 0 end + w.k as n_repeated,
        concat(case when w.s > 0 and first = 1 then slice(t, 1, 1) else slice(t, 1, 0) end, slice(t, w.s - w.k + 1, w.k), slice(t, w.s + 1, coalesce(get(spans, j + 1).s, size(t)) - w.s)) as parts))"""))
    cut = conv.select("key", F.explode("cut").alias("c")).select("key", "c.window", "c.s", "c.n_repeated", F.transform("c.parts", lambda p: F.struct(p["i"].alias("i"), p["role"].alias("role"), escape(p["role"]).alias("r"), escape(p["text"]).alias("x"))).alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(F.lit(OPEN + ROLE), p["r"], F.lit(TEXT), p["x"], F.lit(CLOSE))), "")
    head, close = len(OPEN + ROLE), len(CLOSE)
    loss = F.expr(f"""aggregate(parts, struct(0 as at, cast(array() as array<struct<start: int, end: int>>) as spans),
        (a, p) -> struct(a.at + {head + len(TEXT) + close} + char_length(p.r) + char_length(p.x) as at,
            case when p.i >= s and p.role = 'assistant' then concat(a.spans, array(struct(a.at + {head + len(TEXT)} + char_length(p.r) as start, a.at + {head + len(TEXT)} + char_length(p.r) + char_length(p.x) as end))) else a.spans end as spans),
        a -> a.spans)""")
    return cut.select(F.col("key").alias(key), "window", formatted.alias("formatted"), "n_repeated", (F.size("parts") - F.col("n_repeated")).alias("n_new"), loss.alias("loss"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (``key``, turns, loss, formatted_chars) from windows alone: all turns (role, text) and all text under the loss mask, in order."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    head = F.transform(pieces, lambda x: F.struct(F.substring_index(x, TEXT, 1).alias("h"), x.alias("x")))
    turns = F.transform(head, lambda p: F.struct(unescape(F.substr(p["h"], F.lit(len(OPEN + ROLE) + 1))).alias("role"), unescape(F.substr(p["x"], F.char_length(p["h"]) + len(TEXT) + 1)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))), "")
    rows = formatted.select(F.col(key).alias("key"), "window", F.expr("char_length(formatted)").cast("long").alias("chars"), F.slice(turns, F.col("n_repeated") + 1, F.col("n_new")).alias("turns"), loss.alias("loss"))
    whole = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(F.col("key").alias(key), F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
