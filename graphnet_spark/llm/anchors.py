"""Anchored runs: finding equal windows across a corpus without shuffling every window.

A window of W units (words or bytes) is owned by its anchor, the k-gram inside it whose hash is smallest (the leftmost of
equals). Equal windows have equal anchors at equal places, so only windows with the same anchor k-gram can be equal.
Consecutive windows with one anchor form a run, and a run is described by a digest; a repeated passage consists of
equal runs but for its two ends, so whole runs are grouped first and single windows only where runs differ.

Neighbouring runs of one anchor, as in periodic text, are joined and cut into pieces of PIECE windows, so that a text of
one repeated byte or line gives few runs, equal ones at that.

The count-min sketch counts anchors, which bounds the counts of their windows from above: tasks sketch their own
documents, the sketches are added slice by slice, and a window whose anchor is estimated to occur once is known to
occur once. Its size follows the corpus up to MOST_CELLS, which bounds what is broadcast; beyond that more windows pass
the filter, and the exact grouping has more to do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged_by_key, packed_texts

#: Rows of the sketch, and as powers of two the least and most cells of a row and the cells of a slice. The merged sketch is
#: one bit a cell: at most 64 MB a row.
DEPTH, LEAST_CELLS, MOST_CELLS, SLICE = 2, 20, 29, 20
#: Cells for each anchor that is expected, up to MOST_CELLS; groups of tasks whose sketches are added first.
ROOM, GROUPS = 8, 16
#: Windows of a run at most.
PIECE = 1 << 14
MULTIPLIER = 0x9E3779B97F4A7C15
ROWS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poly(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k hashes from each place on (len(h) - k + 1 values)."""
    out, done, power, width = None, 0, h, 1
    while k >> (width.bit_length() - 1):
        if k & width:
            if out is None:
                out, done = power, width
            else:  # power covers what comes before
                head = power[: len(power) - done]
                n = min(len(head), len(out) - width)
                out = head[:n] * np.uint64(pow(MULTIPLIER, done, 1 << 64)) + out[width : width + n]
                done += width
        n = len(power) - width
        if n <= 0:
            power = power[:0]
        else:
            power = power[:n] * np.uint64(pow(MULTIPLIER, width, 1 << 64)) + power[width:]
        width *= 2
    return out[: max(0, len(h) - k + 1)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(units: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor hash and number of anchors (2 at most) of every run. units: 64-bit hashes; doc: document of each unit.

    The choice of an anchor uses the upper 32 bits of its hash, whatever stands around the window.
    """
    none = np.empty(0, np.int64)
    if len(units) < window:
        return none, none, np.empty(0, np.uint64), none
    grams = mix64(poly(units, k))
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(ranked, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = len(units) - window + 1
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return none, none, np.empty(0, np.uint64), none
    own = owner[at]
    # an anchor lies inside its window and so inside one document: a change of document changes the owner
    # one run ends where the anchor's hash changes, or where windows do not follow each other
    g = grams[own]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    places = 1 + (own[first + count - 1] != own[first])
    pieces = -(-count // PIECE)
    if len(count) and pieces.max() > 1:
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(PIECE, np.repeat(count, pieces) - step * PIECE)
        first, places = np.repeat(first, pieces) + step * PIECE, np.repeat(places, pieces)
    return at[first], count, g[first], places


def anchors_of(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """The anchors of runs() as often as a sketch must count them."""
    return np.repeat(found[2], found[3])


class Sketch:
    """The merged sketch: one bit per cell, set where the count is two or more."""

    def __init__(self, bits: list[np.ndarray], size: int):
        self.bits, self.size = bits, size

    def repeated(self, item: np.ndarray) -> np.ndarray:
        out = np.ones(len(item), bool)
        for row, bits in enumerate(self.bits):
            cell = cells(item, row, self.size)
            out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def cells(item: np.ndarray, row: int, size: int) -> np.ndarray:
    return (mix64(item * np.uint64(ROWS[row])) >> np.uint64(64 - size)).astype(np.int64)


def sketch_size(docs: DataFrame, bytes_per_item: int) -> int:
    """Cells of a row, as a power of two, for texts with one item in so many bytes."""
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_CELLS, max(LEAST_CELLS, math.ceil(math.log2(1 + ROOM * n / bytes_per_item))))


def add(counts: np.ndarray, blob: bytes) -> np.ndarray:
    """Adds a sparse slice, cells doubled plus one where the count is two or more, to saturating counts."""
    x = np.frombuffer(blob, "<u4")
    counts[x >> 1] = np.minimum(counts[x >> 1] + (x & 1) + 1, 2)
    return counts


def sparse(counts: np.ndarray) -> bytes:
    seen = np.flatnonzero(counts)
    return (seen * 2 + (counts[seen] > 1)).astype("<u4").tobytes()


def sketch_items(docs: DataFrame, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bytes_per_item: int) -> Sketch:
    """Count-min sketch of all items of docs (text). Partition sketches are added in two steps, each slice apart from the others."""
    width = sketch_size(docs, bytes_per_item)
    schema = "slice int, part int, cells binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size = TaskContext.get().partitionId(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            item = np.concatenate(held)
            for row in range(DEPTH):
                cell, n = np.unique(cells(item, row, width), return_counts=True)
                coded = ((cell & ((1 << SLICE) - 1)) * 2 + (n > 1)).astype("<u4")
                part = cell >> SLICE
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                blobs = [coded[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(cell)), strict=True)]
                ids = (part[first] + (row << (width - SLICE))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), task % GROUPS, np.int32)), pa.array(blobs, pa.binary())], names=["slice", "part", "cells"])

        for batch in batches:
            for found in items(batch):
                if len(found):
                    held.append(found)
                    size += len(found)
            if size > 1 << 21:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def partial(key: tuple, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([sparse(counts)], pa.binary())], names=["slice", "part", "cells"])

    def last(key: tuple, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    start, own = lambda: np.zeros(1 << SLICE, np.uint8), lambda counts, row: add(counts, row["cells"])
    merged = merged_by_key(docs.mapInArrow(count, schema), ["slice", "part"], start, own, partial, schema)
    whole = merged_by_key(merged, ["slice"], start, own, last, "slice int, bits binary")
    bits = [np.zeros(1 << (width - 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << (SLICE - 3)
    for r in whole.toLocalIterator():  # the sketch, of bounded size
        row, at = divmod(r["slice"], 1 << (width - SLICE))
        bits[row][at * size : (at + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(bits, width)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, spans (or null) and the compressed text of docs (doc_id, tag, text); a null doc_id is a value like any other.

    spans has doc_id, tag, start, n and any others, all of which come back in the array.
    """
    own = [c for c in spans.columns if c not in ("doc_id", "tag")]
    s = spans.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct(*own)).alias("spans"))
    small = packed_texts(docs.select("doc_id", "tag", "text"))
    joined = small.join(s, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    return joined.select("doc_id", "spans", "packed")


def covered(spans: list[dict] | None, size: int, window: int) -> np.ndarray:
    """Which of `size` units are covered by windows that start in the spans."""
    step = np.zeros(size + 1, np.int64)
    for s in spans or ():
        step[s["start"]] += 1
        step[s["start"] + s["n"] + window - 1] -= 1
    return np.cumsum(step[:-1]) > 0
