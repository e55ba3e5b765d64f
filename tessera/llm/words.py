"""Vectorised word splitting and hashing over Arrow string columns.

All Python-side operators of this subpackage share these kernels.  They work on
whole columns at a time (Arrow compute and numpy), never word by word, and they
never look beyond the batch they are given, so they hold bounded memory.

A *word* is a maximal run of characters other than ``\\x20`` and
``\\x09``-``\\x0D``; a null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once.  One longer text is handled alone, still whole.
CHUNK_BYTES = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with good avalanche."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One ``large_string`` array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def _give_back() -> None:
    """Freed memory returns to the system, so that a worker that serves many stages stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup record batches so that each table holds about ``most`` text bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(np.asarray(sizes.cast(pa.int64())))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            if stop == start + 1 and held and int(ends[stop - 1]) - before > most - size:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                _give_back()
                continue
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                _give_back()
    if held:
        yield pa.Table.from_batches(held)
        _give_back()


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and the number of words of each text."""
    texts = as_strings(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.concatenate(([0], np.cumsum(full)))
    offsets = np.asarray(parts.offsets)
    counts = ends[offsets[1:]] - ends[offsets[:-1]]
    if not full.all():
        flat = flat.filter(pa.array(full))
    return flat, counts.astype(np.int64)


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word into the array of distinct words, and that array."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string's UTF-8 bytes, the same on every machine."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8)
    return slice_hashes(np.frombuffer(strings.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets))


def slice_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice of a byte array."""
    out = mix64(lengths.astype(np.uint64) + _ODD)
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    # Eight bytes at a time, over the slices that are that long.
    step = 0
    longest = int(sorted_lengths[-1]) if len(order) else 0
    while step < longest:
        live = order[np.searchsorted(sorted_lengths, step, side="right") :]
        word = np.zeros(len(live), np.uint64)
        for k in range(min(8, longest - step)):
            skip = int(np.searchsorted(sorted_lengths, step + k, side="right")) - (len(order) - len(live))
            word[skip:] |= data[starts[live[skip:]] + step + k].astype(np.uint64) << np.uint64(8 * k)
        out[live] = mix64((out[live] ^ word) * _ODD + np.uint64(step + 1))
        step += 8
    return out


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text in order, and the words of each text."""
    flat, counts = split(texts, lower)
    codes, distinct = encode(flat)
    return string_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64), counts


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``k``-word shingles of each text, sorted within it.

    A text of fewer than ``k`` words, but not none, has its whole sequence as its
    one shingle; a text without words has none.  Returns the hashes, text by
    text, and how many each text has.
    """
    n = len(counts)
    starts = np.cumsum(counts) - counts
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(made.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), made)
    first = np.arange(total) - np.repeat(np.cumsum(made) - made, made) + starts[doc]
    width = np.minimum(counts, k)[doc]
    value = width.astype(np.uint64) * _ODD
    for i in range(k):
        inside = i < width
        if inside.all():
            value = mix64(value ^ hashes[first + i]) + _ODD
        else:
            value[inside] = mix64(value[inside] ^ hashes[first[inside] + i]) + _ODD
    sizes = np.zeros(n, np.int64)
    at = 0
    for i, (begin, many) in enumerate(zip((np.cumsum(made) - made).tolist(), made.tolist(), strict=True)):
        if many:
            own = value[begin : begin + many]
            own.sort()
            if many > 1:
                fresh = own[np.concatenate(([True], own[1:] != own[:-1]))]
            else:
                fresh = own
            value[at : at + len(fresh)] = fresh  # never ahead of what is still to be read
            sizes[i] = len(fresh)
            at += len(fresh)
    return value[:at].copy(), sizes
