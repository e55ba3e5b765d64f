"""Language-model scoring with a log-frequency Bloom filter.

Training counts all tokens and all pairs of neighbouring tokens of the training
texts.  Pair counts are quantised to powers of two and held in a Bloom filter: a
pair of level ``q`` is inserted together with each of the levels below, so its
level is read back by probing for level 1, 2, ... until a probe fails.  The
filter's false positives can only raise a level, never lose one; with 24 probes
one in 2 ** 24 answers is too high, and no pair counts for more than its tokens.

Every pair that occurs is held, also one seen once, so the filter grows with the
corpus.  It is cut in slices by pair bucket, each as large as its own pairs need,
and no worker or driver ever holds it whole.  Only pairs never seen are scored by
their tokens alone.  Keys are whole 64-bit hashes, and the number of buckets
follows the bytes of the training texts alone, so scores are a function of the
corpus and do not depend on the cluster or on any setting of the session.

Neither the filter nor the exact token counts fit on a worker.  Texts are dealt
out in chunks of bounded size; each chunk asks for the counts of its distinct
tokens and the levels of its distinct pairs, the request meets the counts or the
slice bucket by bucket, and the answer returns to the chunk.  Counts, requests
and answers travel as packed arrays (sorted keys as differences), one row for each kind, chunk and bucket,
pre-aggregated before every shuffle.  Rows that are repeated so often that they
would overfill a chunk (equal id and text, or both null) are scored once and
returned as often as they occur.

A token's probability after ``h`` mixes ``(1 - x) * unigram + x * pair(h, w) /
count(h)``.  Each text takes its own Bayesian mixture over the weights
``WEIGHTS``: its score is log10 of the prior-weighted sum, over the weights, of
the product over its tokens.  The first weight is 0, so a text never scores far
below its unigram score.

Tokens are words with A-Z lower-cased, then one end token for each text.

Defined results
---------------
* text null or empty: one end token;
* null id: trained on, and scored as a row of its own;
* very long texts: whole, alone in a chunk where they fill it;
* no training row: every count is 0 and every probability 1 / (0 + 1 * (0 + 1)) = 1;
* repeated rows: each is counted and each is scored, with the same result;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .runtime import small_batches, written

WEIGHTS = np.array([0.0, 0.05, 0.3, 0.7, 0.95])
PRIOR = np.array([0.5, 0.125, 0.125, 0.125, 0.125])
#: Hashes of two strings that are no words, for a text's end and start.
END, START = (int(x) for x in words.string_hashes(pa.array([" ", "\n"])))
#: Training text bytes for each bucket of tokens or pairs.
BUCKET_BYTES = 8 << 20
PROBES = 24


def _steps(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of each key's probes at a level."""
    one = words.mix64(key ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return one, words.mix64(one) | np.uint64(1)


def levels(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


def filter_slice(key: np.ndarray, count: np.ndarray, probes: int = PROBES) -> tuple[bytes, int]:
    """The bit array of one bucket's pairs, and its size in bits."""
    level = levels(count)
    size = 8 * math.ceil(max(64, int(level.sum()) * probes / math.log(2)) / 8)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        one, two = _steps(key[level >= q], q)
        for j in range(probes):
            bits[(one + np.uint64(j) * two) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes(), size


def probe(raw: bytes, size: int, pair: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Level of each pair hash in one slice; 0 where it is unseen."""
    out = np.zeros(len(pair), np.int64)
    data, live, level = np.frombuffer(raw, np.uint8), np.arange(len(pair)), 1
    while size and len(live):
        one, two = _steps(pair[live], level)
        sure = np.arange(len(live))
        for j in range(probes):
            at = (one[sure] + np.uint64(j) * two[sure]) % np.uint64(size)
            sure = sure[(data[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        live = live[sure]
        out[live] = level
        level += 1
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, the end token last in each, and the tokens of each text."""
    hashes, counts = words.word_hashes(texts, lower=True)
    return np.insert(hashes, np.cumsum(counts), np.uint64(END)), counts + 1


def pairs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it, the start for a text's first."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.cumsum(counts) - counts] = np.uint64(START)
    return words.mix64(words.mix64(before) * np.uint64(3) + hashes)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte plane by byte plane: the upper planes are zeros, which a compressed shuffle drops."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each small count; 255 there, and eight bytes at the end, for a larger one."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


_COUNTS = "kind int, bucket int, keys binary, counts binary"
_MERGED = "kind int, bucket int, keys binary, counts binary, size long, total long, types long"


def _runs(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """Bucket, start and end of each run of sorted keys in one bucket."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    return list(zip(bucket[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if len(keys) else []


def count_table(training: DataFrame, text: str, bits: int, probes: int) -> DataFrame:
    """A row for each kind and bucket: the merged counts of tokens (kind 0), the filter slice of all pairs (kind 1, in ``keys``)."""

    def count(batches):
        for t in words.chunks(batches, "text", 16 << 20):
            hashes, counts = tokens(t["text"])
            rows: dict[str, list] = {"kind": [], "bucket": [], "keys": [], "counts": []}
            for kind, values in ((0, hashes), (1, pairs(hashes, counts))):
                keys, n = np.unique(values, return_counts=True)
                for bucket, s, e in _runs(keys, bits):
                    rows["kind"].append(kind)
                    rows["bucket"].append(bucket)
                    rows["keys"].append(_pack(keys[s:e]))
                    rows["counts"].append(_pack_counts(n[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["kind"], pa.int32()), pa.array(rows["bucket"], pa.int32()), pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], ["kind", "bucket", "keys", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        kind = group["kind"][0].as_py()
        keys = [_unpack(x) for x in group["keys"].to_pylist()]
        counts = [_unpack_counts(x, len(k)) for x, k in zip(group["counts"].to_pylist(), keys, strict=True)]
        key, count = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, count = key[at], np.add.reduceat(count, at)
        if kind:
            held, size = filter_slice(key, count, probes)
            packed = b""
        else:
            held, size, packed = _pack(key), 0, _pack_counts(count)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": group["bucket"].slice(0, 1), "keys": pa.array([held], pa.binary()), "counts": pa.array([packed], pa.binary()), "size": [size], "total": [int(count.sum())], "types": [len(key)]})

    return training.select(F.col(text).alias("text")).mapInArrow(count, _COUNTS).groupBy("kind", "bucket").applyInArrow(merge, _MERGED)


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", probes: int = PROBES, chunk_bytes: int = 12 << 20) -> DataFrame:
    """One row per document: (``key``, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    small_batches(spark)
    seen = training.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    training_texts = int(seen["n"])
    bits = max(6, min(20, math.ceil(math.log2(max(1, seen["bytes"] / BUCKET_BYTES)))))
    counts = written(count_table(training, text, bits, probes), "counts")
    sums = counts.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    n, v = int(sums["n"]), int(sums["v"])

    # Dealt by id and text, so that neither rows with one id nor copies meet in one chunk.
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("row", F.xxhash64("key", "text"))
    sizes = base.groupBy("row").agg(F.count(F.lit(1)).alias("many"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("bytes"))
    size = int(sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    chunks = max(1, math.ceil(size / chunk_bytes))
    hot = written(sizes.where((F.col("many") > 1) & (F.col("bytes") > chunk_bytes // 4)).select("row"), "hot")
    repeated = hot.count() > 0
    if repeated:
        once = base.join(hot.select("row"), "row").groupBy("key", "text", "row").agg(F.count(F.lit(1)).alias("many"))
        base = base.join(hot, "row", "left_anti").withColumn("many", F.lit(1).cast("long")).unionByName(once)
    else:
        base = base.withColumn("many", F.lit(1).cast("long"))
    dealt = base.select("key", "text", "many", F.pmod("row", F.lit(chunks)).alias("chunk"))

    def ask(group: pa.Table) -> pa.Table:
        hashes, counts = tokens(group["text"])
        rows: dict[str, list] = {"kind": [], "bucket": [], "keys": []}
        for kind, values in ((0, hashes), (1, pairs(hashes, counts))):
            own = np.unique(values)
            for bucket, s, e in _runs(own, bits):
                rows["kind"].append(kind)
                rows["bucket"].append(bucket)
                rows["keys"].append(_pack(own[s:e]))
        return pa.table({"chunk": pa.array([group["chunk"][0].as_py()] * len(rows["kind"]), pa.int64()), "kind": pa.array(rows["kind"], pa.int32()), "bucket": pa.array(rows["bucket"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        out, sizes = [], []
        if not asked.num_rows:
            return pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("counts", pa.binary())]).empty_table()
        pair = asked["kind"][0].as_py() == 1
        held = known["keys"][0].as_py() if known.num_rows else b""
        if not pair:
            key = _unpack(held)
            count = _unpack_counts(known["counts"][0].as_py(), len(key)) if len(key) else np.zeros(0, np.int64)
        for raw in asked["keys"].to_pylist():
            own = _unpack(raw)
            if not held:
                found = np.zeros(len(own), np.int64)
            elif pair:
                found = probe(held, known["size"][0].as_py(), own, probes)
            else:
                at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                found = np.where(key[at] == own, count[at], 0)
            out.append(_pack_counts(found))
            sizes.append(len(own))
        return pa.table({"chunk": asked["chunk"], "kind": asked["kind"], "bucket": asked["bucket"], "n": pa.array(sizes, pa.int32()), "counts": pa.array(out, pa.binary())})

    def judge(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.schema([("key", group.schema.field("key").type), ("many", pa.int64()), *_RESULT]).empty_table()
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = np.asarray(answers["kind"])
        each = [_unpack_counts(c, k) for c, k in zip(answers["counts"].to_pylist(), answers["n"].to_pylist(), strict=True)]
        hashes, sizes = tokens(group["text"])
        # Distinct tokens and pairs are in the order of the answers.
        _, place = np.unique(hashes, return_inverse=True)
        count = np.concatenate([x for x, kind in zip(each, kinds, strict=True) if not kind])[place]
        _, place = np.unique(pairs(hashes, sizes), return_inverse=True)
        del hashes
        level = np.concatenate([x for x, kind in zip(each, kinds, strict=True) if kind]).astype(np.int8)[place]
        del place, each
        ends = np.cumsum(sizes)
        rows, low = [], 0
        while low < len(sizes):  # a few texts at a time
            start = int(ends[low] - sizes[low])
            high = max(low + 1, int(np.searchsorted(ends, start + (1 << 19), side="right")))
            part = slice(start, int(ends[high - 1]))
            rows.append(_scored(group.select(["key", "many"]).slice(low, high - low), sizes[low:high], count[part], level[part], n, v, training_texts))
            low = high
        return pa.concat_tables(rows)

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, kind int, bucket int, keys binary")
    held = counts.select("kind", "bucket", "keys", "counts", "size")
    answers = asked.groupBy("kind", "bucket").cogroup(held.groupBy("kind", "bucket")).applyInArrow(answer, "chunk long, kind int, bucket int, n int, counts binary")
    kind = dict(base.dtypes)["key"]
    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, f"key {kind}, many long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    if repeated:
        out = out.withColumn("many", F.explode(F.sequence(F.lit(1).cast("long"), "many")))
    return out.drop("many").withColumnRenamed("key", key)


_RESULT = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _scored(rows: pa.Table, sizes: np.ndarray, c: np.ndarray, level: np.ndarray, n: int, v: int, training_texts: int) -> pa.Table:
    doc = np.repeat(np.arange(len(sizes)), sizes)
    unigram = (c + 1) / (n + 1 * (v + 1))
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[np.cumsum(sizes) - sizes] = training_texts
    ratio = np.zeros(len(c))
    may = np.flatnonzero((level > 0) & (c > 0) & (before > 0))  # no pair is more frequent than its tokens
    count = np.minimum(np.minimum(2.0 ** (level[may].astype(float) - 1), c[may]), before[may])
    ratio[may] = count / before[may]
    logs = np.empty((len(WEIGHTS), len(sizes)))
    for k, x in enumerate(WEIGHTS):
        logs[k] = np.bincount(doc, np.log10((1 - x) * unigram + x * ratio), len(sizes)) + math.log10(PRIOR[k])
    top = logs.max(axis=0)
    total = top + np.log10((10.0 ** (logs - top)).sum(axis=0))
    base = np.bincount(doc, np.log10(unigram), len(sizes))
    arrays = [rows["key"].combine_chunks(), rows["many"].combine_chunks(), pa.array(sizes.astype(np.int64)), pa.array(np.bincount(doc, c > 0, len(sizes)).astype(np.int64)), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(total)]
    return pa.Table.from_arrays(arrays, ["key", "many", *[name for name, _ in _RESULT]])
