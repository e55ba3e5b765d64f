"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum, over all its segmentations into pieces, of
the product of their probabilities; a forward pass over the piece lattice sums
them without listing them.  A text's score is the product over its words, and
Bayes' rule with the languages' document counts turns the scores into a
posterior.

Training is expectation-maximisation over that same lattice: the forward and
backward sums give each piece's expected count.  It reads a sample of labelled
documents with distinct texts that is bounded per language (``per_language``),
chosen by a hash of the text so that it does not depend on order or partitioning.
At most ``max_languages`` are learned, those with the most documents, so that the
model that is broadcast (pieces x languages) is bounded whatever the column holds.

Defined results
---------------
* text null, empty, or without any letter: ``lang_pred`` is ``und``, score 0;
* null language: never learned from; no labelled row at all: every text is ``und``;
* ties between languages: the alphabetically first;
* repeated rows: each is scored, with the same result;
* words of any length, very long runs without white space too: summed whole, over all
  segmentations; those of over ``pieces.SPAN`` code points one at a time, in logarithms;
* empty tables: an empty result; a model without languages calls every text ``und``;
* other columns of the input pass through ``identify`` untouched, except ones
  named like its outputs, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces as P
from . import runtime, words

UNDETERMINED = "und"
#: Probability scaling per code point, against underflow; it cancels out.
_SCALE = 16.0


@dataclass
class Model:
    pieces: P.Pieces
    languages: list[str]
    log_prior: np.ndarray
    prob: np.ndarray  # one row per piece, one column per language
    unknown: np.ndarray  # of a code point that is no piece


def _marked(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked, lower-cased words, and their lengths."""
    strings = pc.binary_join_element_wise(pa.scalar(P.SPACE, pa.large_string()), pc.utf8_lower(strings.cast(pa.large_string())), pa.scalar("", pa.large_string()))
    return P.code_points(strings)


def _forward(model: Model, spans: dict, n: int, length: int) -> np.ndarray:
    prob, width = model.prob, len(model.languages)
    alpha = np.zeros((length + 1, n, width))
    alpha[0] = 1.0
    for (start, end), found in spans.items():  # ordered by end
        known = found >= 0
        if known.all():
            alpha[end] += alpha[start] * prob[found]
        else:
            at = np.flatnonzero(known)
            alpha[end, at] += alpha[start, at] * prob[found[at]]
            if end - start == 1:
                at = np.flatnonzero(~known)
                alpha[end, at] += alpha[start, at] * model.unknown
    return alpha


def _long_edges(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, log probabilities (a column for each language) and indices of all pieces in one string, by end.

    A code point that is no piece has an edge of its own, with index -1.
    """
    end, size, piece = P.edges(model.pieces, codes)
    single = np.zeros(len(codes), bool)
    single[end[size == 1] - 1] = True
    lone = np.flatnonzero(~single) + 1
    log = np.concatenate([np.log(model.prob[piece]), np.broadcast_to(np.log(model.unknown), (len(lone), len(model.languages)))])
    start, end = np.concatenate([end - size, lone - 1]), np.concatenate([end, lone])
    piece = np.concatenate([piece, np.full(len(lone), -1)])
    order = np.argsort(end, kind="stable")
    return start[order], end[order], log[order], piece[order]


def _log_sums(start: np.ndarray, end: np.ndarray, log: np.ndarray, length: int) -> np.ndarray:
    """log of the sum over all paths from place 0 to each place; edges come by end, and every place has one that ends there."""
    out = np.zeros((length + 1, log.shape[1]))
    first = np.searchsorted(end, np.arange(1, length + 2)).tolist()
    for at in range(1, length + 1):
        a, z = first[at - 1], first[at]
        terms = out[start[a:z]] + log[a:z]
        top = terms.max(axis=0)
        out[at] = top + np.log(np.exp(terms - top).sum(axis=0))
    return out


def word_log_probs(model: Model, strings: pa.Array) -> np.ndarray:
    """log P(word | language), a row per word."""
    codes, lengths = _marked(strings)
    out = np.zeros((len(lengths), len(model.languages)))
    for rows, matrix in P.by_length(codes, lengths, longest=P.SPAN):
        length = matrix.shape[1]
        alpha = _forward(model, P.lattice(model.pieces, matrix), len(rows), length)
        out[rows] = np.log(np.maximum(alpha[length], 1e-300)) - length * np.log(_SCALE)
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths > P.SPAN).tolist():
        start, end, log, _ = _long_edges(model, codes[starts[i] : starts[i] + lengths[i]])
        out[i] = _log_sums(start, end, log, int(lengths[i]))[-1] - lengths[i] * np.log(_SCALE)
    return out


def _expected(model: Model, strings: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Expected count of each piece in each language, given each word's counts per language."""
    codes, lengths = _marked(strings)
    total = np.zeros_like(model.prob)
    for rows, matrix in P.by_length(codes, lengths, longest=P.SPAN):
        n, length = matrix.shape
        spans = P.lattice(model.pieces, matrix)
        alpha = _forward(model, spans, n, length)
        beta = np.zeros_like(alpha)
        beta[length] = weights[rows] / np.maximum(alpha[length], 1e-300)
        for (start, end), found in sorted(spans.items(), key=lambda item: -item[0][0]):
            at = np.flatnonzero(found >= 0)
            through = model.prob[found[at]] * beta[end, at]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(found[at], alpha[start, at, k] * through[:, k], len(total))
            beta[start, at] += through
            if end - start == 1:
                at = np.flatnonzero(found < 0)
                beta[start, at] += model.unknown * beta[end, at]
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths > P.SPAN).tolist():
        length = int(lengths[i])
        start, end, log, piece = _long_edges(model, codes[starts[i] : starts[i] + length])
        forward = _log_sums(start, end, log, length)
        order = np.argsort(length - start, kind="stable")  # the same sums from the other end
        backward = _log_sums((length - end)[order], (length - start)[order], log[order], length)[::-1]
        share = np.exp(forward[start] + log + backward[end] - forward[-1]) * weights[i]
        known = piece >= 0
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(piece[known], share[known, k], len(total))
    return total


def fit_words(pieces: P.Pieces, languages: list[str], documents: np.ndarray, strings: pa.Array, counts: np.ndarray, rounds: int = 3, smoothing: float = 0.05) -> Model:
    """EM from the counts of distinct words (rows) per language (columns)."""
    size, width = len(pieces.texts), len(languages)
    scale = np.array([_SCALE ** len(t) for t in pieces.texts])[:, None]
    prob = np.full((size, width), 1.0 / size) * scale
    model = Model(pieces, languages, np.log(np.maximum(documents, 1) / max(1, documents.sum())), prob, np.full(width, 1e-7 * _SCALE))
    for _ in range(rounds):
        expected = np.zeros_like(prob)
        for k in range(0, len(strings), 1 << 16):
            expected += _expected(model, strings[k : k + (1 << 16)], counts[k : k + (1 << 16)])
        floor = expected + smoothing
        mass = floor.sum(axis=0)
        model.prob = floor / mass * scale
        model.unknown = smoothing / mass * _SCALE
    return model


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600, max_languages: int = 200, path: str = P.MODEL_PATH) -> Model:
    """Learn from ``per_language`` distinct texts of each non-null language (the documented sample bound), or all where there are fewer.

    At most ``max_languages`` languages, those with the most documents, are learned.
    The languages and their document counts are taken over all rows; the driver
    then holds one count for each distinct word and language of the sample.
    """
    runtime.small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    rank = F.xxhash64("text")
    # Distinct texts are merged first, so that a language with most of the rows is no single task's; the driver sees the most frequent alone.
    per_text = rows.groupBy("lang", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    found = per_text.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    sizes, texts = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["texts"] for r in found}
    languages = sorted(sizes)
    pieces = P.load(path, runs=False)
    documents = np.array([sizes[x] for x in languages], float)
    if not languages:
        return Model(pieces, [], documents, np.zeros((len(pieces.texts), 0)), np.zeros(0))
    # About twice the bound of distinct texts by a threshold on the hash, then exactly the lowest hashes.
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, 2.0 * per_language / texts[x]))])[F.col("lang")]
    from pyspark.sql import Window

    near = rows.withColumn("rank", rank).where((F.col("rank").cast("double") / 2.0**64 + 0.5) <= share)
    near = near.dropDuplicates(["lang", "rank"])  # copies count once, however many; they are merged before the shuffle
    picked = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("at") <= per_language).select("lang", "text")

    def count(batches):
        for t in words.chunks(batches):
            flat, per_text = words.split(t["text"])
            if not len(flat):
                continue
            codes, distinct = words.encode(flat)
            owner = t["lang"].combine_chunks().dictionary_encode()
            pair = np.repeat(np.asarray(owner.indices).astype(np.int64), per_text) * len(distinct) + codes
            keys, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([owner.dictionary.cast(pa.string()).take(pa.array(keys // len(distinct))), distinct.take(pa.array(keys % len(distinct))).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    table = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    if not table.num_rows:
        return Model(pieces, [], documents, np.zeros((len(pieces.texts), 0)), np.zeros(0))
    at, distinct = words.encode(words.as_strings(table["word"]))
    counts = np.zeros((len(distinct), len(languages)))
    own = np.asarray(pc.index_in(table["lang"].combine_chunks(), pa.array(languages)))
    np.add.at(counts, (at, own), np.asarray(table["n"]).astype(float))
    order = np.asarray(pc.sort_indices(distinct))
    return fit_words(pieces, languages, documents, distinct.take(pa.array(order)), counts[order])


def score_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    texts = words.as_strings(texts)
    letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
    n = len(texts)
    if not model.languages:
        return [UNDETERMINED] * n, np.zeros(n)
    flat, per_text = words.split(texts)
    total = np.tile(model.log_prior, (n, 1))
    if len(flat):
        codes, distinct = words.encode(flat)
        useful = np.asarray(pc.match_substring_regex(distinct, r"\p{L}"))
        logs = np.zeros((len(distinct), len(model.languages)))
        logs[useful] = word_log_probs(model, distinct.filter(pa.array(useful)))
        doc = np.repeat(np.arange(n), per_text)
        for k in range(len(model.languages)):
            total[:, k] += np.bincount(doc, logs[codes, k], n)
    best = total.argmax(axis=1)
    top = total[np.arange(n), best]
    score = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
    names = np.array(model.languages, object)[best]
    names[~letters] = UNDETERMINED
    return names.tolist(), np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; one map over the input, no shuffle.

    The distinct words of ``chunk_bytes`` of text are scored once.
    """
    from pyspark.sql import types as T

    runtime.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the corpus
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for t in words.chunks(batches, text, chunk_bytes):  
            names, score = score_texts(shared.value, t[text])
            t = t.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(score))
            yield from t.to_batches()

    return docs.mapInArrow(run, schema)
