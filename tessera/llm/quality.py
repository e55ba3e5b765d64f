"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base rules measure every text (``measures``).  On top of them, each metric may
get a cutoff in each stratum, above which documents are rejected.  Cutoffs come
from a fixed grid and are certified on labelled holdout documents: with ``k`` of
``n`` good documents of the stratum above a cutoff, the cutoff passes if the
exact binomial tail P(X <= k | n, alpha / metrics) is at most delta / (strata x
metrics), so that with confidence 1 - delta no stratum loses more than ``alpha``
of its good documents (a union bound over metrics, Bonferroni over strata and
metrics).  Within a metric, cutoffs are tested from the most lenient on, and the
first failure ends the sequence, which needs no further correction.  Of the
certified cutoffs the one that rejects most bad documents is used (the most
lenient of equals), and none that rejects a larger share of good documents than
of bad ones.

Defined results
---------------
* text null or without a word: all measures 0, fails the base rules;
* a stratum with too few labelled documents, or none: no cutoff, the base rules alone;
* null stratum: a stratum of its own; null label or id: not used for certification;
* repeated rows: each is measured; equal labelled rows count once;
* very long texts: measured whole; an empty document table gives an empty result;
* an empty label table: the base rules alone; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runtime import written

SPACES = r"[\x20\x09-\x0D]+"
#: Fixed grid of cutoffs of each metric; above a cutoff is bad. Not learned from any data.
GRID: dict[str, list[float]] = {
    "symbols_per_word": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0],
    "repeat_share": [0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "dup_lines_per_100_words": [0.25, 0.5, 1.0, 2.0, 4.0, 8.0],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "short_words": [-4.5, -4.0, -3.5, -3.0, -2.5, -2.0],
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = [c for c in docs.columns if c not in names]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # The input's columns travel in one struct, so that none clashes with a step's.
    step = docs.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.array_remove(F.split(whole, SPACES, -1), "").alias("_w"), lines.alias("_l"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    step = step.withColumn("_h", F.expr("case when size(_w) > 3 then transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) end"))
    # Only texts with a repeated window are sorted; equal hashes are then neighbours.
    step = step.withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then array_sort(transform(_h, (x, i) -> struct(x as h, i as i))) end"))
    step = step.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, i) -> x.h = get(_s, i - 1).h or x.h = get(_s, i + 1).h), x -> x.i))"))
    repeat = F.expr("coalesce(aggregate(_p, struct(-3 as far, 0L as n), (a, x) -> struct(x as far, a.n + least(3, x - a.far) as n), a -> a.n), 0L)")
    out = step.select(
        "_row.*", F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _metric(name: str):
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / words,
        "word_length": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }[name]


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k), X binomial(n, p), where k < n p; it is the term at k, found in logarithms, times a falling series."""
    log_term = f"aggregate(sequence(1, greatest(1, cast({k} as int))), 0D, (a, i) -> a + case when i <= {k} then ln(({n} - {k} + i) / i) else 0D end) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p})"
    series = f"aggregate(sequence(0, cast({k} as int)), struct(1D as t, 0D as s), (a, i) -> struct(a.t * ({k} - i) / ({n} - {k} + i + 1) * ({1 - p} / {p}) as t, a.s + a.t as s), a -> a.s)"
    return f"exp({log_term}) * {series}"


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", label: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Rows (stratum, metric, cutoff, good, good_rejected, bad, bad_rejected) of the cutoffs in use."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where("_key is not null and _label in (0, 1)").distinct()
    rows = measured.where(~F.col("base_failed")).join(known, F.col(key) == F.col("_key"))
    tests = [(m, c) for m, grid in GRID.items() for c in grid]
    counts = [F.sum((F.col("_label") == y).cast("long")).alias(n) for n, y in (("good", 1), ("bad", 0))]
    for at, (m, c) in enumerate(tests):
        above = _metric(m) > c
        counts += [F.sum((above & (F.col("_label") == y)).cast("long")).alias(f"{n}_{at}") for n, y in (("g", 1), ("b", 0))]
    tall = rows.groupBy(F.col(stratum).alias("stratum")).agg(*counts)  # a row for each stratum
    tall = tall.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # before the explosion, which would multiply it
    tall = tall.select("stratum", "good", "bad", "strata", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("cutoff"), F.col(f"g_{at}").alias("k"), F.col(f"b_{at}").alias("b")) for at, (m, c) in enumerate(tests)])).alias("x"))
    tall = tall.select("stratum", "good", "bad", "strata", "x.metric", "x.cutoff", F.col("x.k").alias("good_rejected"), F.col("x.b").alias("bad_rejected"))
    share = alpha / len(GRID)
    tail = F.when(F.col("good_rejected") < F.col("good") * share, F.expr(binomial_tail("good_rejected", "good", share))).otherwise(F.lit(1.0))
    passed = tail <= F.lit(delta / len(GRID)) / F.col("strata")
    lenient_first = Window.partitionBy("stratum", "metric").orderBy(F.desc("cutoff"))
    tall = tall.withColumn("certified", F.min(passed.cast("int")).over(lenient_first)).where("certified = 1 and bad_rejected > 0 and bad_rejected * good > good_rejected * bad")
    best = Window.partitionBy("stratum", "metric").orderBy(F.desc("bad_rejected"), F.desc("cutoff"))
    return tall.withColumn("at", F.row_number().over(best)).where("at = 1").drop("at", "certified", "strata")


def judged(measured: DataFrame, cutoffs: DataFrame, stratum: str, broadcast_rows: int = 10_000) -> DataFrame:
    """``measured`` with ``kept``: false where the base rules fail or a certified cutoff is passed."""
    wide = cutoffs.groupBy(F.col("stratum").alias("_stratum")).pivot("metric", list(GRID)).agg(F.min("cutoff"))
    wide = written(wide.select(F.col("_stratum"), *[F.col(m).alias(f"_cut_{m}") for m in GRID]), "cutoffs")
    if wide.count() <= broadcast_rows:
        wide = F.broadcast(wide)
    joined = measured.drop("kept").join(wide, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    over = F.lit(False)
    for m in GRID:
        over = over | F.coalesce(_metric(m) > F.col(f"_cut_{m}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", *[f"_cut_{m}" for m in GRID])


def filtered(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per document: key, stratum, the measures, base_failed and kept."""
    measured = written(measures(docs.select(*dict.fromkeys([key, stratum, text])), text).drop(text), "measures")
    return judged(measured, thresholds(measured, labels, stratum, key, label, alpha, delta), stratum)
