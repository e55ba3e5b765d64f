"""A fixed public piece vocabulary and vectorised lookups of substrings in it.

The vocabulary is read from a SentencePiece model file on the driver; only the
piece strings, scores and ids are shipped, never the file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Where the public model lies by default; every operator takes another path.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: SentencePiece's mark for a space before a word.
SPACE = "▁"
#: Units of up to this many code points are handled many at a time, longer ones one by one; both whole.
SPAN = 32

_BASE = np.uint64(0x100000001B3)


@dataclass
class Pieces:
    """Pieces by index, their scores and model ids; ``byte_ids[b]`` is the fallback of byte ``b``."""

    texts: list[str]
    scores: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    byte_scores: np.ndarray
    longest: int = field(init=False)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.texts), default=1)
        by_length: dict[int, list[int]] = {}
        for i, text in enumerate(self.texts):
            by_length.setdefault(len(text), []).append(i)
        self.tables = {}
        for length, own in by_length.items():
            codes = np.array([[ord(c) for c in self.texts[i]] for i in own], np.uint64)
            keys = np.zeros(len(own), np.uint64)
            for k in range(length):
                keys = keys * _BASE + codes[:, k]
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array(own, np.int32)[order])

    def find(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Index of the piece with each key, or -1."""
        if length not in self.tables:
            return np.full(len(keys), -1, np.int32)
        known, own = self.tables[length]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, own[at], np.int32(-1))


def load(path: str = MODEL_PATH, runs: bool = True) -> Pieces:
    """Read the normal and byte pieces of a model.

    Pieces with an inner space mark are left out, but for ``runs`` of marks alone;
    no word, and no unit of encoding, holds one inside.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores, ids = [], [], []
    byte_ids, byte_scores = np.full(256, -1, np.int64), np.zeros(256)
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            byte_scores[int(text[3:5], 16)] = model.get_score(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and (SPACE not in text[1:] or (runs and not text.strip(SPACE))):
            texts.append(text)
            scores.append(model.get_score(i))
            ids.append(i)
    return Pieces(texts, np.array(scores), np.array(ids, np.int64), byte_ids, byte_scores)


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of all strings in order, and the length of each string in code points."""
    strings = strings.cast(pa.large_string())
    joined = "".join(strings.to_pylist())
    import pyarrow.compute as pc

    lengths = np.asarray(pc.utf8_length(strings)).astype(np.int64)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def by_length(codes: np.ndarray, lengths: np.ndarray, points: int = 1 << 18, longest: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Blocks of strings of one length each, ``points`` code points or so: their indices, and their code points as a matrix.

    With ``longest``, longer strings are left out.
    """
    starts = np.cumsum(lengths) - lengths
    out = []
    for length in np.unique(lengths[(lengths > 0) & (lengths <= (longest or np.inf))]).tolist():
        rows = np.flatnonzero(lengths == length)
        most = max(1, points // length)
        for k in range(0, len(rows), most):
            own = rows[k : k + most]
            out.append((own, codes[starts[own][:, None] + np.arange(length)]))
    return out


def edges(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in one string, by end and then by length: their ends, lengths and indices."""
    ends, sizes, own = [], [], []
    keys = np.zeros(len(codes) + 1, np.uint64)
    for length in range(1, min(pieces.longest, len(codes)) + 1):
        keys = keys[:-1] * _BASE + codes[length - 1 :].astype(np.uint64)
        found = pieces.find(keys, length)
        at = np.flatnonzero(found >= 0)
        ends.append(at + length)
        sizes.append(np.full(len(at), length))
        own.append(found[at])
    end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(own)
    order = np.lexsort((size, end))
    return end[order], size[order], piece[order]


def lattice(pieces: Pieces, matrix: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For strings of one length: piece index of each span (start, end), or -1, where any string has a piece."""
    n, length = matrix.shape
    prefix = np.zeros((length + 1, n), np.uint64)
    for k in range(length):
        prefix[k + 1] = prefix[k] * _BASE + matrix[:, k].astype(np.uint64)
    power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(length + 1)], np.uint64)
    spans = {}
    for end in range(1, length + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.find(prefix[end] - prefix[start] * power[end - start], end - start)
            if end - start == 1 or (found >= 0).any():
                spans[start, end] = found
    return spans
