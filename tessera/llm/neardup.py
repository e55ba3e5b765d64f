"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct lower-cased word shingles.  Two permutations
make all signature coordinates: one places the shingles on a circle of 2**32
points, the other ranks the points; coordinate ``k`` is the lowest rank after
the circle is turned by ``k``.  Rows of coordinates are banded; documents that
share a band are candidates, and every link is confirmed by the exact Jaccard
similarity of the full sets.

Equal sets are one class, whatever their number, and only classes are banded.
Candidates are met in two steps, so that a large group never yields all of its
pairs.  First every class of a bucket is compared with the bucket's hub, the
class that shares most buckets with others; the confirmed links merge classes
into components.  Then buckets that still hold several components are completed:
in blocks of bounded size, all pairs of different components are screened by
their signatures, each in the first band that they share, and the likely ones
are confirmed inside the block, which returns only the links that join
components.  No pair that shares a band is left out, other than pairs
already in one component and pairs whose signatures agree in under ``screen`` of
the coordinates (for a similarity of 0.8, five standard deviations off).

With 20 bands of 4 rows, a pair at similarity 0.8 shares a band with probability
0.99997, and a more similar one with a higher.

Defined results
---------------
* text null, empty or blank: the set is empty, linked with nothing; kept;
* fewer words than a shingle: the whole sequence is the one shingle;
* null id: linked with nothing, ``component_id`` null; kept;
* repeated rows: equal ids are one node of the graph, and each row is returned;
* an empty table gives an empty result;
* other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import connected_components
from .runtime import written

BANDS, ROWS = 20, 4
BLOCK = 256
_CACHE = 1 << 16
_SIGMA = np.uint64(0x5851F42D4C957F2D)


def signatures(shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash signatures, a row for each set; sets lie one after the other."""
    out = np.full((len(counts), size), 0xFFFFFFFF, np.uint32)
    circle = (words.mix64(shingles ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    low = 0
    while low < len(full):
        begin = int(ends[full[low]] - counts[full[low]])
        high = max(low + 1, int(np.searchsorted(ends[full], begin + _CACHE, side="right")))
        own = full[low:high]
        place = circle[begin : ends[own[-1]]]
        starts = ends[own] - counts[own] - begin
        x, y = np.empty_like(place), np.empty_like(place)
        for k in range(size):
            np.subtract(place, np.uint32(k), out=x)  # the circle turned by k
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0x85EBCA6B), out=x)
            np.right_shift(x, np.uint32(13), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(0xC2B2AE35), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[own, k] = np.minimum.reduceat(x, starts)
        low = high
    return out


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = words.word_hashes(texts, lower=True)
    return words.shingle_hashes(hashes, counts, k)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=8).digest()


def sketches(docs: DataFrame, key: str, text: str, k: int, size: int) -> DataFrame:
    """Rows (id, n_shingles, class, signature); class is null for an empty set or a null id."""

    def run(batches):
        for t in words.chunks(batches, "text", 4 << 20):
            found, counts = _sets(t["text"], k)
            sig = signatures(found, counts, size)
            ends = np.cumsum(counts)
            ids = t["id"].combine_chunks()
            some = (counts > 0) & ~np.asarray(ids.is_null())
            node = np.zeros(len(counts), np.int64)
            for i in np.flatnonzero(some).tolist():
                node[i] = int.from_bytes(_digest(found[ends[i] - counts[i] : ends[i]]), "little", signed=True)
            raw = pa.array([x.tobytes() if s else None for x, s in zip(sig, some.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(node, mask=~some), raw], ["id", "n_shingles", "class", "signature"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_shingles long, class long, signature binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


_GROUP = ["bucket", "low", "high"]
_MEMBER = "bucket long, band int, low long, high long, block long, class long, label long, n_shingles long, signature binary"


def _by_group(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the adjoining rows of whole groups (bucket and pair of blocks), many groups at a time."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            same = np.ones(held.num_rows, bool)
            for c in _GROUP:
                own = np.asarray(held[c])
                same &= own == own[-1]
            tail = int(np.argmax(same))  # the last group may go on in the next batch
            if tail:
                yield from work(held.slice(0, tail).combine_chunks()).to_batches()
            held = held.slice(tail)
        if held is not None:
            yield from work(held.combine_chunks()).to_batches()

    return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, schema)


def _likely(t: pa.Table, size: int, per_band: int, screen: float, percent: int):
    """Per group: its first row and the next group's, and the row pairs whose signatures are alike in the first band they share."""
    cols = {c: np.asarray(t[c]) for c in ("bucket", "band", "low", "high", "block", "label", "n_shingles")}
    sig = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint32).reshape(-1, size)
    fresh = np.ones(len(sig), bool)
    fresh[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in _GROUP], axis=0)
    edges = np.append(np.flatnonzero(fresh), len(sig))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if cols["low"][s] == cols["high"][s]:
            i, j = np.triu_indices(e - s, 1)
        else:
            first = np.flatnonzero(cols["block"][s:e] == cols["low"][s])
            second = np.flatnonzero(cols["block"][s:e] == cols["high"][s])
            i, j = np.repeat(first, len(second)), np.tile(second, len(first))
        i, j = i + s, j + s
        n, m = cols["n_shingles"][i], cols["n_shingles"][j]
        ok = (cols["label"][i] != cols["label"][j]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        i, j = i[ok], j[ok]
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 13):
            same = sig[i[k : k + (1 << 13)]] == sig[j[k : k + (1 << 13)]]
            shared = same.reshape(len(same), -1, per_band).all(axis=2)
            good[k : k + (1 << 13)] = (same.mean(axis=1) >= screen) & (shared.argmax(axis=1) == cols["band"][s])
        yield s, e, i[good], j[good]


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sets."""
    if len(i) <= 8 * len(sets):
        out = np.zeros(len(i), np.int64)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            x, y = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            out[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        return out
    # Many pairs of few sets: products of indicator matrices, in slices of the shingles that several sets have.
    values, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.flatnonzero(many > 1)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, len(common), 1 << 13):
        inside = (column >= k) & (column < k + (1 << 13))
        part = np.zeros((len(sets), min(1 << 13, len(common) - k)), np.float32)
        part[row[inside], column[inside] - k] = 1.0
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _completed(rows: DataFrame, sets: DataFrame, size: int, per_band: int, screen: float, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket; of the confirmed ones, those that join them."""

    def screened(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, bool)
        for _, _, i, j in _likely(t, size, per_band, screen, percent):
            keep[i] = keep[j] = True
        return t.filter(pa.array(keep))

    def confirmed(t: pa.Table) -> pa.Table:
        left, right = [], []
        node, label = np.asarray(t["class"]), np.asarray(t["label"])
        blobs = t["shingles"].to_pylist()
        for s, e, i, j in _likely(t, size, per_band, screen, percent):
            if not len(i):
                continue
            own = [np.frombuffer(x, np.uint64) for x in blobs[s:e]]
            both = _intersections(own, i - s, j - s)
            count = np.array([len(x) for x in own])
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for k in np.flatnonzero(100 * both >= percent * (count[i - s] + count[j - s] - both)).tolist():
                x, y = root(int(label[i[k]])), root(int(label[j[k]]))
                if x != y:
                    parent[x] = y
                    left.append(node[i[k]])
                    right.append(node[j[k]])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    likely = _by_group(rows.select(*[c.split()[0] for c in _MEMBER.split(", ")]), screened, _MEMBER)
    return _by_group(likely.join(sets, "class"), confirmed, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, screen: float = 0.58) -> DataFrame:
    """One row per input row: (``key``, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links of at least
    ``percent`` per cent similarity; ``kept`` is whether the row has that id.
    """
    size = bands * rows
    found = written(sketches(docs, key, text, k, size), "sketches")
    classes = written(found.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")

    banded = classes.select("class", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 4 * rows * b + 1, 4 * rows)) for b in range(bands)])).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = written(banded.join(sizes, "bucket"), "buckets")
    involved = shared.groupBy("class").agg(F.sum("many").alias("weight"))
    nodes = written(classes.join(involved, "class"), "nodes")

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(nodes.select("id", "class").hint("shuffle_hash"), "id")

    def full_sets(batches):
        for t in words.chunks(batches, "text", 4 << 20):
            own, counts = _sets(t["text"], k)
            ends = np.cumsum(counts)
            blobs = [own[e - c : e] for e, c in zip(ends, counts, strict=True)]
            match = [int.from_bytes(_digest(x), "little", signed=True) == c for x, c in zip(blobs, t["class"].to_pylist(), strict=True)]  # an id may have several texts
            yield pa.RecordBatch.from_arrays([t["class"].combine_chunks(), pa.array([x.tobytes() for x in blobs], pa.binary())], ["class", "shingles"]).filter(pa.array(match, pa.bool_()))

    sets = written(texts.mapInArrow(full_sets, "class long, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")

    # Step one: every class against the hub of each of its buckets.
    weighed = shared.join(nodes.select("class", "weight"), "class")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "class"))["class"].alias("hub"))
    spokes = weighed.join(hubs, "bucket").where("class <> hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    sides = [nodes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}")) for c in ("a", "b")]
    spokes = spokes.join(sides[0], "a").join(sides[1], "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b")
    links = written(_confirm(spokes, sets, percent), "links")
    labels = connected_components(links)

    # Step two: what is still apart in a bucket.
    labelled = nodes.join(labels, F.col("class") == F.col("node"), "left").select("class", "n_shingles", "signature", F.coalesce("label", "class").alias("label"))
    members = shared.join(labelled, "class")
    apart = members.groupBy("bucket").agg(F.min("label").alias("lowest"), F.max("label").alias("highest")).where("lowest <> highest").select("bucket")
    dealt = members.join(apart, "bucket").withColumn("blocks", F.ceil(F.col("many") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    more = written(_completed(dealt, sets, size, rows, screen, percent), "links")
    labels = connected_components(links.unionByName(more)) if more.limit(1).count() else labels

    grouped = classes.join(labels, F.col("class") == F.col("node"), "left").select("class", "id", F.coalesce("label", "class").alias("label"))
    lowest = grouped.groupBy("label").agg(F.min("id").alias("component"))
    own = grouped.join(lowest, "label").select("class", "component")
    out = found.select("id", "n_shingles", "class").join(own, "class", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
