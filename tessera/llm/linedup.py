"""Substring deduplication by hashing units of lines.

Texts are cut into units, each unit's normalised words (A-Z lower-cased, white
space ignored) are hashed, digests are grouped over all documents, and every
occurrence but the earliest ranked is removed, its original offsets retained.

With ``unit="line"`` a unit is a line, with ``unit="paragraph"`` a block of lines
between blank lines.  Repeated passages often begin and end inside a line, where
no whole line repeats; ``unit="passage"``, the default, therefore also cuts lines
at places that the words themselves choose: after a word whose hash with the next
word's is the lowest within ``SPREAD`` words on either side.  Copies of a passage
are cut alike wherever they stand, but for some words at either end.  A run of
repeated passage units is therefore only a seed, from ``seed_words`` words: its first
telling unit (of ``TELLING`` words or more, or else its longest; shorter ones also occur
by chance elsewhere) is compared with its kept occurrence word by word to the left, its
last telling unit to the right, until they differ.  Both sides of a seed ask their documents for
``reach`` words; seeds that agree on all of them ask again for more.

Runs of adjoining repeats, with these words, are removed if they have ``min_words``
words or more together, so that a short line that many documents share stays.  A
passage unit has at most ``LONGEST`` words, so most words of a removed run were
compared one by one, and no chance agreement of two digests removes a text.

Ranks are (``key``, offset): the smallest id keeps a unit.

Defined results
---------------
* text null or without a word: no unit, nothing removed;
* null id: takes no part, its text is kept whole;
* repeated rows (equal id and offsets): the same occurrence, kept or removed alike;
* ties: of equal ids and offsets, one occurrence; very long texts: cut and compared whole;
* an empty table gives an empty result;
* ``removed_spans`` reads two columns only; ``deduplicate`` keeps all others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .runtime import small_batches, written

SPREAD = 3
#: Where words repeat so that no place is the lowest, a passage unit still ends after so many.
LONGEST = 16
#: Words of a unit that hardly occurs twice by chance.
TELLING = 4
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def cut(texts: pa.Array, unit: str = "passage") -> dict[str, np.ndarray]:
    """All units of all texts: their text's index, place in it, digest, code point offsets (end exclusive) and words."""
    texts = pc.ascii_lower(words.as_strings(texts))
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    base = int(offsets[0])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base : int(offsets[-1])]
    offsets = offsets - base
    none = {k: np.zeros(0, np.int64) for k in ("text", "place", "digest", "start", "end", "words")}
    if not len(data):
        return none
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # Word starts and ends; a text's end also ends a word.
    inner = ~space
    before = np.concatenate(([False], inner[:-1]))
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets] = True
    before &= ~begins_text[:-1]
    start = np.flatnonzero(inner & ~before)
    after = np.concatenate((inner[1:], [False])) if len(data) else inner
    after &= ~begins_text[1:]
    end = np.flatnonzero(inner & ~after) + 1
    if not len(start):
        return none
    hashes = words.slice_hashes(data, start, end - start)
    doc = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    line = breaks[start]
    last = np.ones(len(start), bool)
    gap = line[1:] - line[:-1]
    last[:-1] = (doc[1:] != doc[:-1]) | ((gap > 1) if unit == "paragraph" else (gap > 0))
    if unit == "passage":
        pair = words.mix64(hashes)
        pair[:-1] = words.mix64(pair[:-1] * np.uint64(3) ^ hashes[1:])
        pair[last] = _LAST
        lowest = np.ones(len(pair), bool)
        for k in range(1, SPREAD + 1):
            lowest[k:] &= pair[k:] <= pair[:-k]
            lowest[:-k] &= pair[:-k] < pair[k:]
        last |= lowest & (pair != _LAST)
    first = np.concatenate(([True], last[:-1]))
    at = np.flatnonzero(first)
    if unit == "passage":
        own = np.diff(np.concatenate((at, [len(start)])))
        step = np.arange(len(start)) - np.repeat(at, own)
        at = np.flatnonzero(step % LONGEST == 0)
    size = np.diff(np.concatenate((at, [len(start)])))
    step = np.arange(len(start)) - np.repeat(at, size)
    digest = words.mix64(np.add.reduceat(words.mix64(hashes ^ words.mix64(step.astype(np.uint64))), at) + size.astype(np.uint64))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    owner = doc[at]
    origin = points[offsets[owner]]
    units_before = np.searchsorted(owner, owner, side="left")
    return {"text": owner, "place": np.arange(len(at)) - units_before, "digest": digest.view(np.int64), "start": points[start[at]] - origin, "end": points[end[at + size - 1]] - origin, "words": size}


def units(docs: DataFrame, key: str, text: str, unit: str) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for t in words.chunks(batches, "text", 4 << 20):
            found = cut(t["text"], unit)
            ids = t["id"].combine_chunks().take(pa.array(found["text"]))
            arrays = [ids, *[pa.array(found[c].astype(np.int32)) for c in ("place", "start", "end", "words")], pa.array(found["digest"])]
            yield from pa.Table.from_arrays(arrays, ["id", "place", "start", "end", "words", "digest"]).to_batches(max_chunksize=100_000)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null").mapInArrow(run, "id long, place int, start int, end int, words int, digest long")


_SPANS = "id long, start int, end int, n_words int, n_units int, first_id long, first_start int"
#: Runs also name the kept occurrences of their first and last telling units, and where in the text these begin and end.
_RUNS = f"{_SPANS}, l_id long, l_start int, own_l int, r_id long, r_start int, r_words int, own_r int"
_RUN = [c.split()[0] for c in _RUNS.split(", ")]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _contexts(texts: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """Up to ``reach`` words before and after each run's telling units, and beside the kept occurrences (``own`` false), each place once."""
    left = runs.select(F.col("l_id").alias("id"), F.col("l_start").alias("at"), F.lit(0).alias("skip"))
    right = runs.select(F.col("r_id").alias("id"), F.col("r_start").alias("at"), F.col("r_words").alias("skip"))
    asked = left.unionByName(right).distinct().select("id", F.struct("at", "skip").alias("ask"), F.expr("null").alias("run"))
    own = runs.select("id", F.expr("null").alias("ask"), F.struct(*_RUN[1:]).alias("run"))
    every = asked.unionByName(own).groupBy("id").agg(F.collect_list("ask").alias("asks"), F.collect_list("run").alias("runs"))
    joined = texts.join(every, "id").select("id", "text", "asks", "runs")

    def run(batches):
        for batch in batches:
            low = pc.ascii_lower(batch.column(1))
            out: list[dict] = []
            for i, text, asks, runs in zip(batch.column(0).to_pylist(), low.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                spans = [m.span() for m in _WORD.finditer(text)]
                starts = [x for x, _ in spans]

                def before(at, spans=spans, starts=starts, text=text):
                    k = bisect_left(starts, at)
                    return (text[starts[max(0, k - reach)] : at] if k else ""), k

                def after(at, k, spans=spans, text=text):
                    return text[at : spans[min(k + reach, len(spans)) - 1][1]] if k < len(spans) else ""

                for x in asks:
                    if x["skip"]:
                        k = bisect_left(starts, x["at"]) + x["skip"]
                        out.append({"id": i, "own": False, "at": x["at"], "skip": x["skip"], "after": after(starts[k], k) if k < len(starts) else ""})
                    else:
                        out.append({"id": i, "own": False, "at": x["at"], "skip": 0, "before": before(x["at"])[0]})
                for x in runs:
                    head, a = before(x["own_l"])
                    z = bisect_left(starts, x["own_r"])
                    out.append({"id": i, "own": True, "before": head, "after": after(x["own_r"], z), "a": a, "z": z, **x})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    ddl = f"{_RUNS}, own boolean, at int, skip int, before string, after string, a int, z int"
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    return joined.mapInArrow(run, ddl)


_EXTENDED = f"{_RUNS}, open boolean, a int, z int, from int, to int, origin int"


def _compared(context: DataFrame, reach: int) -> DataFrame:
    """Runs with their true ends (``from``, ``to``; words ``a`` to ``z``), ``open`` where they agree as far as was asked."""
    own = context.where("own").select(*_RUN, "a", "z", "before", "after")
    other = context.where("not own")
    left = other.where("skip = 0").groupBy(F.col("id").alias("kl_id"), F.col("at").alias("kl_at")).agg(F.min("before").alias("l"))
    right = other.where("skip > 0").groupBy(F.col("id").alias("kr_id"), F.col("at").alias("kr_at"), F.col("skip").alias("kr_skip")).agg(F.min("after").alias("r"))
    # Hot occurrences are on the streamed side, as above.
    met = own.join(left, F.expr("l_id = kl_id and l_start = kl_at"), "left").join(right, F.expr("r_id = kr_id and r_start = kr_at and r_words = kr_skip"), "left")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for x in rows:
                mine, theirs = list(_WORD.finditer(x["before"])), list(_WORD.finditer(x["l"] or ""))
                n = 0
                while n < min(len(mine), len(theirs)) and mine[-1 - n][0] == theirs[-1 - n][0]:
                    n += 1
                x["from"] = x["own_l"] - (len(x["before"]) - mine[-n].start() if n else 0)
                x["first_id"], x["origin"] = x["l_id"], x["l_start"] - (len(x["l"]) - theirs[-n].start() if n else 0)
                mine, theirs = list(_WORD.finditer(x["after"])), _WORD.findall(x["r"] or "")
                m = 0
                while m < min(len(mine), len(theirs)) and mine[m][0] == theirs[m]:
                    m += 1
                x["to"] = x["own_r"] + (mine[m - 1].end() if m else 0)
                x["a"], x["z"], x["open"] = x["a"] - n, x["z"] + m, max(n, m) >= reach
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _EXTENDED.split(", ")])
    return met.select(*_RUN, "a", "z", "before", "after", "l", "r").mapInArrow(run, _EXTENDED)


def _extended(texts: DataFrame, runs: DataFrame, min_words: int, reach: int = 24) -> DataFrame:
    """Runs to their true ends, of ``min_words`` or more; those of a document that overlap are one."""
    ready = []
    while True:
        found = written(_compared(written(_contexts(texts, runs, reach), "contexts"), reach), "extended")
        ready.append(found.where("not open"))
        runs = found.where("open").select(*_RUN)
        if not runs.limit(1).count():
            break
        reach *= 8
    every = reduce(DataFrame.unionByName, ready).where(F.col("z") - F.col("a") >= min_words)
    grouped = every.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("from", "to", "a", "z", "n_units", "first_id", "origin"))).alias("found"))

    def merge(batches):
        for batch in batches:
            out = []
            for i, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: list[dict] = []
                for x in found:
                    if own and x["from"] < own[-1]["to"]:
                        own[-1].update(to=max(own[-1]["to"], x["to"]), z=max(own[-1]["z"], x["z"]), n_units=own[-1]["n_units"] + x["n_units"])
                    else:
                        own.append(x)
                out += [(i, x["from"], x["to"], x["z"] - x["a"], x["n_units"], x["first_id"], x["origin"]) for x in own]
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], _RUN[:7])

    return grouped.mapInArrow(merge, _SPANS)


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "passage", min_words: int = 30, seed_words: int = 12) -> DataFrame:
    """Rows (``key``, start, end, n_words, n_units, first_id, first_start): what repeats an earlier place, and that place."""
    least = min(seed_words, min_words) if unit == "passage" else min_words
    every = units(docs, key, text, unit)
    first = every.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("first"), F.max(F.struct("id", "start")).alias("final")).where("first <> final").select("digest", "first")
    # Hot digests lie on the streamed side, whose large partitions are split at run time.
    again = every.join(first, "digest").where("struct(id, start) <> first")
    grouped = again.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("place", "start", "end", "words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")))).alias("found"))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place, start, end, count, first_id, first_start = (np.asarray(flat.field(k)) for k in range(6))
            if not len(place):
                continue
            at = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1))))
            total = np.add.reduceat(count, at)
            stop = np.concatenate((at[1:], [len(place)]))
            keep = np.flatnonzero(total >= least)
            a, z = at[keep], stop[keep] - 1
            weight = np.minimum(count, TELLING).astype(np.int64) * (len(count) + 1)  # the first, or last, of the longest up to that
            low = np.array([x + int((weight[x : y + 1] - np.arange(y + 1 - x)).argmax()) for x, y in zip(a.tolist(), z.tolist(), strict=True)], np.int64)
            high = np.array([x + int((weight[x : y + 1] + np.arange(y + 1 - x)).argmax()) for x, y in zip(a.tolist(), z.tolist(), strict=True)], np.int64)
            spans = [start[a], end[z], total[keep].astype(np.int32), (z - a + 1).astype(np.int32), first_id[a], first_start[a]]
            telling = [first_id[low], first_start[low], start[low], first_id[high], first_start[high], count[high], end[high]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[a])), *map(pa.array, spans + telling)], _RUN)

    runs = grouped.mapInArrow(run, _RUNS)
    if unit == "passage":
        texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
        runs = _extended(texts, written(runs, "runs"), min_words)
    return runs.select(*_RUN[:7]).withColumnRenamed("id", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "passage", min_words: int = 30) -> DataFrame:
    """``docs`` without the repeats; ``removed`` lists their (start, end) in the original text."""
    spans = written(removed_spans(docs, key, text, unit, min_words), "spans")
    lists = spans.groupBy(F.col(key).alias("__span_key")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = docs.drop("removed").join(lists, F.col(key) == F.col("__span_key"), "left").drop("__span_key")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = batch.column(batch.schema.get_field_index("removed")).to_pylist()
            out = []
            for own, gone in zip(texts, spans, strict=True):
                if own is not None and gone:
                    parts, at = [], 0
                    for x in gone:
                        parts.append(own[at : x["start"]])
                        at = max(at, x["end"])
                    own = "".join([*parts, own[at:]])
                out.append(own)
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, pa.string()))

    schema = T.StructType(joined.schema.fields)
    return joined.mapInArrow(run, schema)
