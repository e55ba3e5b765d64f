"""Toxicity by FTRL-proximal logistic regression over hashed word features.

A text's features are the hashes, modulo ``dims``, of its lower-cased words, its
word n-grams up to ``order`` and its skip-grams (two words with one or more left
out between them, up to ``skip``).  Each distinct feature counts once.  Training
is the FTRL-proximal online update: every coordinate has its own learning rate,
and the L1 term keeps most weights at exactly zero, so that only the few others
are broadcast.

Training reads at most ``max_rows`` labelled rows (the documented sample bound),
those of documents given for training with the lowest hash of their key and label, so
the sample does not depend on order or partitioning; within it, rows are visited in
that order.  A row has at most ``max_features`` coordinates in training, those with the
lowest numbers of a longer text, so that the driver holds a bounded sample of features too;
scoring looks at all of them.

Defined results
---------------
* text null or empty: no feature, the score is the bias alone; very long texts: scored whole;
* null label, or a label other than 0 and 1: never learned from;
* no labelled row at all, or empty tables: every score is 0; no document, no result;
* null key: never learned from, scored like any other;
* ties of the sample's hash: by key, then label;
* repeated rows: each is scored, with the same result; equal rows of labels count
  once in training;
* other columns pass through ``score`` untouched, except ones named like its
  outputs, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .runtime import small_batches

#: Trimmed from both ends of a word before hashing.
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass
class Model:
    index: np.ndarray  # sorted coordinates of nonzero weight
    weight: np.ndarray
    bias: float
    dims: int
    order: int
    skip: int


def features(texts: pa.Array, dims: int, order: int = 2, skip: int = 1, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature coordinates of each text, text by text, and how many each has.

    With ``keep``, a flag for each coordinate, the others are left out.
    """
    flat, counts = words.split(texts, lower=True)
    n = len(counts)
    codes, distinct = words.encode(flat)
    hashes = words.string_hashes(pc.ascii_trim(distinct, characters=PUNCTUATION))[codes]
    doc = np.repeat(np.arange(n, dtype=np.int32), counts)
    keys: list[np.ndarray] = []

    def add(owner: np.ndarray, value: np.ndarray) -> None:
        at = value & np.uint64(dims - 1) if dims & (dims - 1) == 0 else value % np.uint64(dims)
        if keep is not None:
            own = np.flatnonzero(keep[at])
            owner, at = owner[own], at[own]
        keys.append(owner.astype(np.uint64) << np.uint64(32) | at)

    value = words.mix64(hashes)
    add(doc, value)
    for k in range(1, min(order, len(doc))):  # n-grams grow by a word at a time
        value = words.mix64(value[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        same = doc[:-k] == doc[k:]
        add(doc[:-k][same], value[same])
    for k in range(2, min(skip + 2, len(doc))):
        same = doc[:-k] == doc[k:]
        add(doc[:-k][same], words.mix64((hashes[:-k][same] + np.uint64(k)) * np.uint64(0xD1342543DE82EF95) ^ hashes[k:][same]))
    found = np.unique(np.concatenate(keys))
    return (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=n)


def fit_features(rows: list[np.ndarray], labels: np.ndarray, dims: int, order: int, skip: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> Model:
    """The FTRL-proximal recursion; weights are derived from z and n where they are needed."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)  # the last coordinate is the bias, without L1
    penalty = np.full(dims + 1, l1)
    penalty[dims] = 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - penalty[at], 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for row, label in zip(rows, labels, strict=True):
            at = np.append(row, dims).astype(np.int64)
            w = weight(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    every = weight(np.arange(dims + 1))
    index = np.flatnonzero(every[:dims])
    return Model(index.astype(np.uint32), every[index], float(every[dims]), dims, order, skip)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = 12_000, max_features: int = 20_000, dims: int = 1 << 20, order: int = 2, skip: int = 1) -> Model:
    """Learn from ``docs`` joined with ``labels`` on ``key``; only the sample's keys are joined, so no text is shuffled."""
    small_batches(docs.sparkSession)
    rank = F.xxhash64("key", "label")
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null").distinct()
    rows = rows.join(docs.select(F.col(key).alias("key")).distinct(), "key", "left_semi")  # labels of other documents take no place in the sample
    picked = F.broadcast(rows.withColumn("rank", rank).orderBy("rank", "key", "label").limit(max_rows))  # at most max_rows keys
    near = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(picked, "key")

    def run(batches):
        for t in words.chunks(batches):
            found, counts = features(t["text"], dims, order, skip)
            ends = np.cumsum(counts)
            blobs = [found[e - c : e][:max_features].tobytes() for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([t["rank"].combine_chunks(), t["label"].combine_chunks(), pa.array(blobs, pa.binary())], ["rank", "label", "found"])

    table = near.mapInArrow(run, "rank long, label int, found binary").orderBy("rank", "label", "found").limit(max_rows).toArrow()
    if not table.num_rows:
        return Model(np.zeros(0, np.uint32), np.zeros(0), float("-inf"), dims, order, skip)
    found = [np.frombuffer(x, np.uint32) for x in table["found"].to_pylist()]
    return fit_features(found, np.asarray(table["label"]).astype(float), dims, order, skip)


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    if not np.isfinite(model.bias):
        return np.zeros(len(texts))
    dense = np.zeros(model.dims, np.float32)
    dense[model.index] = model.weight
    found, counts = features(texts, model.dims, model.order, model.skip, dense != 0)
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), dense[found], len(counts)) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; one map over the input, no shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most dims weights, mostly far fewer
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for t in words.chunks(batches, text):
            own = score_texts(shared.value, t[text])
            t = t.append_column("score", pa.array(own)).append_column("predicted", pa.array((own >= threshold).astype(np.int32)))
            yield from t.to_batches()

    return docs.mapInArrow(run, schema)
