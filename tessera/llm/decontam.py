"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``width`` consecutive words of a benchmark item, or a whole item
that has fewer.  Both sides are winnowed: of every ``width - k + 1`` consecutive
``k``-word hashes the smallest is a fingerprint (the rightmost of equals).  Two
texts that share ``width`` words share all of these hashes there, so they choose
the same fingerprint at the same place within the shared span: no occurrence can
be missed.  Test fingerprints are joined with document fingerprints, each hit is
extended to the windows that it was chosen for, and an extended hit counts only
if all words are equal.

Items of fewer than ``width`` words have no full winnowing window; their whole
sequence is looked up among all document sequences of that length.

The document side is one pass: a document's fingerprints are screened against a
bitmap of the test fingerprints (a literal of at most ``2 ** BITMAP`` bits; chance
agreements only cost time), and those that pass travel with the words around them to
the test windows, where they are compared word by word.  Then only ids, counts and
windows are shuffled, never a text.  The bitmap and the broadcast of the test side
hold while it has at most ``broadcast_rows`` windows, which is checked; beyond that
all fingerprints are kept and both sides are shuffled by fingerprint.

Defined results
---------------
* text null, or without a word: no words, no hit; such an item has no window;
* null item id: its windows are hits, but it is never listed; null document id: a row of its own;
* repeated items: each id is listed once; repeated documents: each row is returned;
* rows of one id with different texts: each is judged by its own text;
* very long texts: looked at whole; ties of hashes: the rightmost is the fingerprint, on both sides;
* a word in several windows is hit once;
* an empty benchmark leaves every document clean;
* other columns of either input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

K, WIDTH = 5, 10
#: Bits of the screen, as a power of two.
BITMAP = 20
#: ASCII characters other than letters and digits separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.char_length(whole)
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _gram_hashes(hashes: str, k: int) -> str:
    """SQL: 64-bit hashes of all k consecutive words, by position from 0, from the words' hashes."""
    parts = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return f"case when size({hashes}) >= {k} then transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({parts})) else cast(array() as array<bigint>) end"


def _is_chosen(span: int) -> str:
    """SQL: whether the hash ``x`` at ``p`` of ``h`` is the smallest (the rightmost of equals) of some ``span`` consecutive ones.

    It is, if the runs beside it of hashes that it beats are long enough together.
    """
    left = right = str(span - 1)
    for j in range(span - 1, 0, -1):
        left = f"if(get(h, p - {j}) >= x, {left}, {j - 1})"
        right = f"if(get(h, p + {j}) > x, {right}, {j - 1})"
    return f"({left} + {right} >= {span - 1})"


def windows(items: DataFrame, key: str, text: str, k: int, width: int) -> DataFrame:
    """Rows (fingerprint, entries): each entry is (at, length, words, item_id) of a window with that fingerprint.

    ``at`` is the fingerprint's place within the window; whole short items have the hash of all their words.
    """
    base = items.select(F.col(key).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0").withColumn("wh", F.expr(_WORD_HASHES))
    span = width - k + 1
    long = (
        base.where(f"size(w) >= {width}")
        .withColumn("h", F.expr(_gram_hashes("wh", k)))
        .withColumn("p", F.expr(f"transform(sequence(0, size(h) - {span}), s -> array_max(filter(sequence(s, s + {span - 1}), q -> h[q] = array_min(slice(h, s + 1, {span})))))"))
        # The outer form: the filter inferred for the other would repeat all of the above for every element.
        .select("item_id", "w", "h", F.posexplode_outer("p").alias("s", "p"))
        .select(F.expr("h[p]").alias("fingerprint"), F.expr("p - s").alias("at"), F.lit(width).alias("length"), F.expr(f"array_join(slice(w, s + 1, {width}), ' ')").alias("words"), "item_id")
    )
    short = base.where(f"size(w) < {width}").select(F.expr(_whole("wh", width)).alias("fingerprint"), F.lit(0).alias("at"), F.expr("size(w)").alias("length"), F.expr("array_join(w, ' ')").alias("words"), "item_id")
    return long.unionByName(short).distinct()


_WORD_HASHES = "transform(w, x -> xxhash64(x))"


def _whole(hashes: str, width: int) -> str:
    """SQL: the hash of a whole short sequence, the same as that of its gram."""
    cases = " ".join(f"when {n} then xxhash64({', '.join(f'{hashes}[{j}]' for j in range(n))})" for n in range(1, width))
    return f"case size({hashes}) {cases} end"


def _screen(prints: DataFrame) -> str:
    """SQL: whether the bitmap has the fingerprint ``x``; at most ``2 ** BITMAP`` bits, 64 in a number."""
    place = f"shiftrightunsigned(fingerprint, {64 - BITMAP})"
    rows = prints.groupBy(F.expr(f"cast(shiftright({place}, 6) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("bits")).collect()
    bits = [0] * (1 << (BITMAP - 6))
    for r in rows:
        bits[r["at"]] = r["bits"]
    x = f"shiftrightunsigned(x, {64 - BITMAP})"
    return f"getbit(get(cast(split('{','.join(map(str, bits))}', ',') as array<bigint>), cast(shiftright({x}, 6) as int)), cast({x} & 63 as int)) = 1"


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = K, width: int = WIDTH, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per document: (``key``, n_words, n_hit, n_items, item_ids, spans, contaminated, text_hash).

    ``spans`` are the windows found (first word, end exclusive), in order; they may overlap.
    ``text_hash`` tells rows of one id with different texts apart.
    """
    tests = written(windows(items, item_key, item_text, k, width), "windows")
    lengths = {r["length"]: r["n"] for r in tests.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most width rows
    small = sum(lengths.values()) <= broadcast_rows
    passes = _screen(tests.select("fingerprint")) if small and lengths else "true"
    base = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"), words_of(F.col(text)).alias("w")).withColumn("wh", F.expr(_WORD_HASHES)).withColumn("h", F.expr(_gram_hashes("wh", k)))

    # Each mark is a fingerprint with the words in which its windows lie, of which the first is word ``c``.
    back = width - k
    pieces = ["array(cast(null as struct<length: int, p: int, fingerprint: bigint, c: int, words: array<string>>))"]  # one for the row itself
    if width in lengths:
        made = f"struct({width} as length, p as p, x as fingerprint, greatest(p - {back}, 0) as c, slice(w, greatest(p - {back}, 0) + 1, {width + back}) as words)"
        pieces.append(f"array_compact(transform(h, (x, p) -> if({passes}, if({_is_chosen(width - k + 1)}, {made}, null), null)))")
    for length in sorted(x for x in lengths if x < width):  # short items: every place
        grams = "h" if length == k else _gram_hashes("wh", length)
        pieces.append(f"array_compact(transform({grams}, (x, p) -> if({passes}, struct({length} as length, p as p, x as fingerprint, p as c, slice(w, p + 1, {length}) as words), null)))")
    marked = base.select("key", "hash", F.size("w").alias("n_words"), F.explode(F.expr(f"concat({', '.join(pieces)})")).alias("m")).select("key", "hash", "n_words", "m.*", F.col("m").isNull().alias("own"))
    # A row's own mark has length 0 and meets no window; its text's hash keeps such marks apart in a shuffled join.
    marked = marked.withColumns({"fingerprint": F.coalesce("fingerprint", "hash"), "length": F.coalesce("length", F.lit(0))})
    entries = tests.select(F.col("fingerprint").alias("print"), F.col("length").alias("len"), F.col("words").alias("test"), "at", "item_id")
    if small:
        entries = F.broadcast(entries)
    met = marked.join(entries, (F.col("fingerprint") == F.col("print")) & (F.col("length") == F.col("len")), "left")
    s = "p - at"
    found = met.select("key", "hash", "n_words", "own", F.expr(f"case when {s} >= c and array_join(slice(words, {s} - c + 1, length), ' ') = test then struct({s} as s, length as length, item_id as item) end").alias("hit")).where("own or hit is not null")

    out = found.groupBy("key", "hash").agg(F.sum(F.col("own").cast("long")).alias("rows"), F.first("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"))
    # Windows come in order of start; each adds what lies beyond the farthest end so far.
    n_hit = F.expr("aggregate(hits, struct(0 as far, 0L as n), (acc, x) -> struct(greatest(acc.far, x.s + x.length) as far, acc.n + greatest(0, x.s + x.length - greatest(acc.far, x.s)) as n), acc -> acc.n)")
    spans = F.expr("array_distinct(transform(hits, x -> struct(x.s as start, x.s + x.length as end)))")
    out = out.withColumn("item_ids", F.expr("array_sort(array_distinct(filter(transform(hits, x -> x.item), x -> x is not null)))"))
    out = out.select(F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.expr("cast(size(item_ids) as bigint)").alias("n_items"), "item_ids", spans.alias("spans"), (F.size("hits") > 0).alias("contaminated"), F.col("hash").alias("text_hash"), "rows")
    # Repeated rows (equal id and text) come back as often as they went in.
    return out.withColumn("rows", F.explode(F.expr("sequence(1L, rows)"))).drop("rows")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    found = contamination(docs, items, key, text, broadcast_rows=broadcast_rows, **options)
    gone = written(found.where("contaminated").select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    if gone.count() <= broadcast_rows:  # otherwise both sides are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__hash")), "left_anti")
