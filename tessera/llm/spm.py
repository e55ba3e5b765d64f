"""SentencePiece encoding with exact N-best segmentations, and decoding.

A text is a sequence of units that no piece crosses: a word with all spaces
before it, the rest of a line's first word, a line break.  For each distinct
unit, a forward Viterbi pass over the piece lattice gives the best score from
the unit's start to every position.  A backward A* search then grows
segmentations from the unit's end; the forward scores are its heuristic, which
is exact, so that completed segmentations leave the agenda in order of score and
no other path is ever expanded.  Many units of one length are searched in lock
step, each with its own agenda.  A unit of over 32 code points is searched alone, in
one forward pass that keeps the N best segmentations up to every position.

The N best segmentations of a whole text follow from those of its units: only
the ``n - 1`` units with the smallest loss of their second segmentation can
change, so their combinations are listed and the best kept.

The score of a segmentation is the sum of the model's piece scores; a code point
that is no piece is spelt in byte pieces, at the lowest score less ten.  Pieces of
several space marks are in the lattice; pieces that mix an inner space mark with
other characters, of which the public model has none, are not.  Encoding is lossless:
``decode(encode(text)) == text`` for every text, also one that holds the space
mark itself, which is spelt in bytes.

Defined results
---------------
* text null: ids and scores are null; text empty: the segmentation of the one
  leading space that every text has;
* fewer than ``n`` segmentations: as many as there are;
* ties: the segmentation whose last differing piece is the shorter comes first,
  the same on every machine;
* a unit of any length is segmented whole; an empty table gives an empty result;
* repeated rows: each is encoded, with the same result;
* other columns pass through untouched, except ones named like the outputs,
  which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces as P
from . import words

#: Rows in a batch that goes back to the JVM.
ROWS_OUT = 500


class Lattice:
    """Pieces with a plain space for the space mark, so that the mark itself matches nothing."""

    def __init__(self, pieces: P.Pieces):
        self.pieces = P.Pieces([t.replace(P.SPACE, " ") for t in pieces.texts], pieces.scores, pieces.ids, pieces.byte_ids, pieces.byte_scores)
        self.unknown = float(pieces.scores.min() - 10.0) if len(pieces.scores) else -10.0
        spelling = [b""] * (int(max(pieces.ids.max(initial=0), pieces.byte_ids.max(initial=0))) + 1)
        for text, i in zip(self.pieces.texts, pieces.ids.tolist(), strict=True):
            spelling[i] = text.encode()
        for b, i in enumerate(pieces.byte_ids.tolist()):
            if i >= 0:
                spelling[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelling), np.uint8)
        self.spelt_lengths = np.array([len(x) for x in spelling], np.int64)

    def nbest(self, strings: list[str], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores (a row per string, -inf where there are fewer), and for each rank the ids and their offsets."""
        lengths = np.array([len(s) for s in strings], np.int64)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        scores = np.full((len(strings), n), -np.inf)
        scores[lengths == 0, 0] = 0.0
        rows: list[list[np.ndarray]] = [[] for _ in range(n)]
        flat: list[list[np.ndarray]] = [[] for _ in range(n)]
        for own, matrix in P.by_length(codes, lengths, points=1 << 15, longest=P.SPAN):
            found, edges = self._search(matrix, n)
            scores[own] = found
            for k in range(n):
                at, col = np.nonzero(edges[:, k, :] != -1)
                rows[k].append(own[at])
                flat[k].append(edges[at, k, col])
        starts = np.cumsum(lengths) - lengths
        for i in np.flatnonzero(lengths > P.SPAN).tolist():
            found, paths = self._search_long(codes[starts[i] : starts[i] + lengths[i]], n)
            scores[i, : len(found)] = found
            for k, path in enumerate(paths):
                rows[k].append(np.full(len(path), i))
                flat[k].append(path)
        out = []
        for k in range(n):
            row = np.concatenate([np.zeros(0, np.int64), *rows[k]])
            edge = np.concatenate([np.zeros(0, np.int64), *flat[k]])
            order = np.argsort(row, kind="stable")
            row, edge = row[order], edge[order]
            if (odd := edge < -1).any():  # code points in bytes
                spelt = [[int(e)] if e >= 0 else [int(self.pieces.byte_ids[b]) for b in chr(-2 - e).encode("utf-8", "surrogatepass")] for e in edge[odd].tolist()]
                many = np.ones(len(edge), np.int64)
                many[odd] = [len(x) for x in spelt]
                ids = np.zeros(int(many.sum()), np.int64)
                where = np.repeat(odd, many)
                ids[~where] = self.pieces.ids[edge[~odd]]
                ids[where] = np.array([b for x in spelt for b in x])
                row = np.repeat(row, many)
            else:
                ids = self.pieces.ids[edge] if len(edge) else np.zeros(0, np.int64)
            out.append((ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(strings)))))))
        return scores, out

    def _search(self, matrix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For strings of one length: the n best scores, and their edges from left to right, padded with -1.

        An edge is a piece's index, or -2 less the code point that is spelt in bytes.
        """
        count, length = matrix.shape
        spans = P.lattice(self.pieces, matrix)
        width = max(end - start for start, end in spans)
        edge = np.full((length + 1, width, count), -1, np.int64)  # by end and length less one
        cost = np.full((length + 1, width, count), -np.inf)
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0.0
        for (start, end), found in spans.items():
            known = found >= 0
            own = np.where(known, self.pieces.scores[found], -np.inf)
            which = found.astype(np.int64)
            if end - start == 1:
                own = np.where(known, own, self.unknown)
                which = np.where(known, which, -2 - matrix[:, start].astype(np.int64))
            edge[end, end - start - 1], cost[end, end - start - 1] = which, own
            best[end] = np.maximum(best[end], best[start] + own)
        # The agenda: a column for each hypothesis. Estimated score, score so far, position, parent column, edge.
        scores = np.full((count, n), -np.inf)
        paths = np.full((count, n, length), -1, np.int64)
        live = np.arange(count)
        estimate = best[length][:, None].copy()
        so_far = np.zeros((count, 1))
        node = np.full((count, 1), length, np.int16)
        parent = np.full((count, 1), -1, np.int32)
        via = np.full((count, 1), -1, np.int64)
        done = np.zeros(count, np.int64)
        while len(live):
            r = np.arange(len(live))
            pick = estimate.argmax(axis=1)
            top = estimate[r, pick]
            empty = ~np.isfinite(top)
            at = node[r, pick].astype(np.int64)
            complete = np.flatnonzero((at == 0) & ~empty)
            if len(complete):
                rank = done[live[complete]]
                scores[live[complete], rank] = so_far[complete, pick[complete]]
                col, depth = pick[complete].astype(np.int64), 0
                walk = complete
                while len(walk):
                    paths[live[walk], rank, depth] = via[walk, col]
                    col = parent[walk, col].astype(np.int64)
                    more = col > 0
                    walk, rank, col, depth = walk[more], rank[more], col[more], depth + 1
                done[live[complete]] += 1
            estimate[r, pick] = -np.inf
            stay = ~empty & (done[live] < n)
            if not stay.all():
                keep = np.flatnonzero(stay)
                live, estimate, so_far, node, parent, via = live[keep], estimate[keep], so_far[keep], node[keep], parent[keep], via[keep]
                pick, at = pick[keep], at[keep]
                r = np.arange(len(live))
                if not len(live):
                    break
            g = so_far[r, pick]
            lengths = np.arange(1, width + 1)
            start = at[:, None] - lengths
            step = np.where(start >= 0, cost[at[:, None], lengths - 1, live[:, None]], -np.inf)
            new = g[:, None] + step
            start = np.maximum(start, 0)
            estimate = np.concatenate([estimate, new + best[start, live[:, None]]], axis=1)
            so_far = np.concatenate([so_far, new], axis=1)
            node = np.concatenate([node, start.astype(np.int16)], axis=1)
            parent = np.concatenate([parent, np.broadcast_to(pick[:, None], start.shape).astype(np.int32)], axis=1)
            via = np.concatenate([via, edge[at[:, None], lengths - 1, live[:, None]]], axis=1)
        return scores, paths


    def _search_long(self, codes: np.ndarray, n: int) -> tuple[list[float], list[np.ndarray]]:
        """For one long string: the n best scores, or all where there are fewer, and their edges as in ``_search``."""
        length, width = len(codes), self.pieces.longest
        back = np.zeros((length + 1, n), np.int8)  # code points of the last edge
        rank = np.zeros((length + 1, n), np.int8 if n < 128 else np.int32)  # of the segmentation before it
        last = np.full((length + 1, n), -1, np.int64)
        recent: list[list[float]] = [[] for _ in range(width + 1)]  # scores up to the last positions, in a ring
        recent[0] = [0.0]
        block = 1 << 16
        for low in range(0, length, block):
            begin, high = max(0, low - width + 1), min(length, low + block)
            end, size, piece = P.edges(self.pieces, codes[begin:high])
            inside = end + begin > low
            end, size, piece = (end + begin)[inside], size[inside], piece[inside]
            first = np.searchsorted(end, np.arange(low + 1, high + 2)).tolist()
            size, cost, piece = size.tolist(), self.pieces.scores[piece].tolist(), piece.tolist()
            for at in range(low + 1, high + 1):
                a, z = first[at - low - 1], first[at - low]
                options = [(-s - cost[e], size[e], k, piece[e]) for e in range(a, z) for k, s in enumerate(recent[(at - size[e]) % (width + 1)])]
                if a == z or size[a] > 1:  # the last code point is no piece
                    options += [(-s - self.unknown, 1, k, -2 - int(codes[at - 1])) for k, s in enumerate(recent[(at - 1) % (width + 1)])]
                options.sort()  # among equals, the shorter last piece
                del options[n:]
                recent[at % (width + 1)] = [-x[0] for x in options]
                for k, (_, own, before, edge) in enumerate(options):
                    back[at, k], rank[at, k], last[at, k] = own, before, edge
        found, paths = recent[length % (width + 1)], []
        for k in range(len(found)):
            path, at = [], length
            while at:
                path.append(int(last[at, k]))
                at, k = at - int(back[at, k]), int(rank[at, k])
            paths.append(np.array(path[::-1], np.int64))
        return found, paths


def _units(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Unit of each place of all texts in order, the distinct units, and the number of units of each text."""
    lines = pc.split_pattern(texts, "\n")
    per_text = np.asarray(pc.list_value_length(lines)).astype(np.int64)
    parts = pc.split_pattern(lines.flatten(), " ")
    per_line = np.asarray(pc.list_value_length(parts)).astype(np.int64)
    flat = parts.flatten()
    first_line = np.zeros(len(per_line), bool)
    first_line[np.cumsum(per_text) - per_text] = True
    spaced = np.ones(len(flat), bool)
    begins = np.cumsum(per_line) - per_line
    spaced[begins[~first_line]] = False
    # A run of spaces is one unit with the word after it, or alone at a line's end.
    closes = np.asarray(pc.binary_length(flat)) > 0
    closes[begins + per_line - 1] = True
    at = np.flatnonzero(closes)
    spaces = np.diff(np.concatenate(([0], np.cumsum(spaced)[at]))).astype(np.int64)
    done = np.cumsum(closes)
    units_done = done[begins + per_line - 1]  # up to each line's end
    per_line = np.diff(np.concatenate(([0], units_done)))
    begins = units_done - per_line
    codes, distinct = words.encode(flat.take(pa.array(at)))
    most = int(spaces.max(initial=0)) + 1
    code = codes.astype(np.int64) * most + spaces
    # A line break before every line but a text's first, as a unit of its own.
    break_code = most * len(distinct)
    code = np.insert(code, begins[~first_line], break_code)
    per_text_units = np.add.reduceat(per_line, np.cumsum(per_text) - per_text) + per_text - 1 if len(per_text) else per_text
    keys, unit = np.unique(code, return_inverse=True)
    names = distinct.to_pylist()
    strings = ["\n" if k == break_code else " " * (k % most) + names[k // most] for k in keys.tolist()]
    return unit, strings, per_text_units


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the given runs, one after the other."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def encode_texts(lattice: Lattice, texts: pa.Array, n: int = 1, rows: int = ROWS_OUT) -> Iterator[list[list[tuple[float, np.ndarray]]]]:
    """The n best segmentations of each text as (score, ids), best first, for ``rows`` texts at a time.

    Each distinct unit of all the texts is searched once.
    """
    texts = words.as_strings(texts)
    if not len(texts):
        return
    unit, strings, per_text = _units(texts)
    scores, found = lattice.nbest(strings, n)
    del strings
    best, offsets = found[0]
    sizes = np.diff(offsets)
    loss = scores[:, 0] - scores[:, 1] if n > 1 else None
    ends = np.cumsum(per_text)
    for k in range(0, len(per_text), rows):
        counts = per_text[k : k + rows]
        part = unit[ends[k] - counts[0] : ends[k + len(counts) - 1]]
        flat = best[_ragged(offsets[:-1][part], sizes[part])]
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, scores[part, 0], len(counts))
        id_ends = np.cumsum(np.bincount(owner, sizes[part], len(counts)).astype(np.int64))
        unit_ends = np.cumsum(counts)
        out = []
        for i in range(len(counts)):
            ids = flat[(id_ends[i - 1] if i else 0) : id_ends[i]]
            ranked = [(float(total[i]), ids)]
            if n > 1:
                own = part[unit_ends[i] - counts[i] : unit_ends[i]]
                ranked += _others(own, loss[own], scores, found, sizes[own], ids, float(total[i]), n)
            out.append(ranked)
        yield out


def _others(own: np.ndarray, loss: np.ndarray, scores: np.ndarray, found: list, sizes: np.ndarray, ids: np.ndarray, total: float, n: int) -> list[tuple[float, np.ndarray]]:
    """The second to n-th best segmentations of a text with units ``own``."""
    few = np.argpartition(loss, n - 2)[: n - 1] if len(loss) > n - 1 else np.arange(len(loss))
    edge = loss[few].max() if len(few) else np.inf
    if np.isfinite(edge) and len(loss) > n - 1:  # among equals, the earliest
        few = np.concatenate([np.flatnonzero(loss < edge), np.flatnonzero(loss == edge)])[: n - 1]
    combos: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for at in sorted(few.tolist()):
        options = [(float(scores[own[at], 0] - scores[own[at], k]), k) for k in range(n) if np.isfinite(scores[own[at], k])]
        combos = sorted((c + lost, chosen + ((at, k),) if k else chosen) for c, chosen in combos for lost, k in options)[:n]
    starts = np.cumsum(sizes) - sizes
    out = []
    for lost, chosen in combos[1:]:
        parts, at = [], 0
        for place, k in chosen:
            alt, offsets = found[k]
            parts += [ids[at : starts[place]], alt[offsets[own[place]] : offsets[own[place] + 1]]]
            at = starts[place] + sizes[place]
        out.append((total - lost, np.concatenate([*parts, ids[at:]])))
    return out


def decode_ids(lattice: Lattice, lists: list[np.ndarray]) -> list[str]:
    """Texts of id lists, vectorised over all of them."""
    data, lengths = lattice.spelt, lattice.spelt_lengths
    starts = np.cumsum(lengths) - lengths
    ids = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64)
    raw = data[_ragged(starts[ids], lengths[ids])].tobytes()
    counts = np.array([len(x) for x in lists], np.int64)
    owner = np.repeat(np.arange(len(lists)), counts)
    ends = np.cumsum(np.bincount(owner, lengths[ids], len(lists)).astype(np.int64)) if len(lists) else []
    out, at = [], 0
    for end in ends:
        text = raw[at:end].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
        at = int(end)
    return out


def encode(docs: DataFrame, text: str = "text", n: int = 2, path: str = P.MODEL_PATH, decoded: str | None = None, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``ids`` (n best lists of piece ids, best first) and ``scores``; one map, no shuffle.

    With ``decoded``, a column of that name has the text of the best ids, decoded in the same pass.
    ``chunk_bytes`` of text are segmented at once: more share more units, fewer take less memory.
    """
    docs = docs.drop("ids", "scores", *([decoded] if decoded else []))
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(P.load(path)))  # one fixed vocabulary
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("scores", T.ArrayType(T.DoubleType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches):
        for whole in words.chunks(batches, text, chunk_bytes):
            null = np.asarray(whole[text].is_null())
            for at, part in enumerate(encode_texts(shared.value, whole[text], n)):
                k = at * ROWS_OUT
                lists = [ids for own in part for _, ids in own]
                inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
                mask = pa.array(null[k : k + ROWS_OUT])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32))
                scores = pa.array(np.array([s for own in part for s, _ in own], np.float64))
                t = whole.slice(k, ROWS_OUT)
                t = t.append_column("ids", pa.ListArray.from_arrays(offsets, inner, mask=mask)).append_column("scores", pa.ListArray.from_arrays(offsets, scores, mask=mask))
                if decoded:
                    t = t.append_column(decoded, pa.array(decode_ids(shared.value, [own[0][1] for own in part]), pa.string(), mask=null[k : k + ROWS_OUT]))
                yield from t.combine_chunks().to_batches()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "best_ids", out: str = "decoded", path: str = P.MODEL_PATH) -> DataFrame:
    """``encoded`` with the text of each list of ids; a null list gives null, ids outside the model are an error."""
    encoded = encoded.drop(out)
    shared = encoded.sparkSession.sparkContext.broadcast(Lattice(P.load(path)))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_OUT):
                t = pa.Table.from_batches([batch.slice(k, ROWS_OUT)])
                column = t[ids].combine_chunks()
                flat = np.asarray(column.flatten())
                sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                ends = np.cumsum(sizes)
                texts = decode_ids(shared.value, [flat[e - s : e] for e, s in zip(ends, sizes, strict=True)])
                made = pa.array(texts, pa.string(), mask=np.asarray(column.is_null()))
                yield from t.append_column(out, made).combine_chunks().to_batches()

    return encoded.mapInArrow(run, schema)
