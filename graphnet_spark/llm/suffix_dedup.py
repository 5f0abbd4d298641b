"""Suffix-array dedup of byte strings.

Every place of MATCH bytes is brought together with its equals by its anchor (anchors.py), so that all equal strings lie in
one group; each place carries LENGTH bytes as far as its document has them. Equal runs are one kind, for which one run
stands. Where an anchor has several kinds, or a run several anchors, a suffix array over them orders their places; previous and next smaller
positions in that order give each place's longest previous factor, i.e. its longest match with an earlier place. A place
whose factor reaches the length is a later copy; the places that such factors come from are the first ones. Groups of very
many bytes are cut into chunks with a suffix array each, and what a chunk leaves open is compared across chunks by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Sketch, anchors_of, covered, mix64, runs, sketch_items, with_spans
from .common import map_texts, slices, stored, table, unpacked

#: Bytes of a repeated string that is removed, of the shortest match that is looked for, and of an anchor.
LENGTH, MATCH, ANCHOR = 400, 256, 32
#: Bytes of text for each anchor, about: a run has (MATCH - ANCHOR + 2) / 2 windows on average.
BYTES_PER_ANCHOR = 110
#: Bytes of runs in one chunk, and of one suffix array over several. A chunk's arrays take about 60 times its bytes.
CHUNK_BYTES, ARRAY_BYTES = 1 << 22, 1 << 18
RUNS = "doc_id long, tag long, g long, r1 long, r2 long, start int, n int, size int, periodic boolean, segment binary"
#: Spans of places. full: copies of LENGTH bytes that go; else later copies of MATCH bytes. With w, a place is still open.
PARTS = "doc_id long, tag long, start int, n int, full boolean, g long, w binary, settled boolean"
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(batch: pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The joined bytes of a batch's texts (its last column), each text's first place, and the text of each byte."""
    raw = [(x.as_py() or "").encode() for x in batch.column(batch.num_columns - 1)]
    sizes = np.array([len(x) for x in raw], np.int64)
    return b"".join(raw), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(raw), dtype=np.int32), sizes)


def byte_runs(joined: bytes, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    return runs(BYTE_HASH[np.frombuffer(joined, np.uint8)], doc, MATCH, ANCHOR)


def anchor_items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch, 1 << 20):
        joined, _, doc = byte_units(part)
        yield anchors_of(byte_runs(joined, doc))


def repeated_runs(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Runs of places whose anchor is estimated to occur again; of equal runs of a slice, the first has their bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        joined, base, doc = byte_units(batch)
        start, n, g, places = byte_runs(joined, doc)
        keep = shared.value.repeated(g)
        start, n, g, places = start[keep], n[keep], g[keep], places[keep]
        if not len(start):
            return None
        of = doc[start]
        ends = np.minimum(start + n + LENGTH - 1, np.append(base[1:], len(joined))[of])
        digests, segments, seen = [], [], set()
        for a, b, k in zip(start.tolist(), ends.tolist(), n.tolist(), strict=True):
            segment = joined[a:b]
            digest = xxhash.xxh3_128_digest(segment, seed=k)
            digests.append(digest)
            segments.append(None if digest in seen else segment)
            seen.add(digest)
        r = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        cols = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(g.view(np.int64)), pa.array(r[:, 0].copy()), pa.array(r[:, 1].copy())]
        cols += [pa.array(x.astype(np.int32)) for x in (start - base[of], n, ends - start)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(places > 1), pa.array(segments, pa.binary())], names=["doc_id", "tag", "g", "r1", "r2", "start", "n", "size", "periodic", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                if (out := rows(part)) is not None:
                    yield out

    return docs.mapInArrow(run, RUNS)


def prefix_ranks(buffer: bytes, limit: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks) by prefix doubling from 8 bytes up to at least limit: ranks of all suffixes by their first bytes."""
    padded = np.frombuffer(buffer + bytes(8), np.uint8)
    packed = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buffer)].copy().view(">u8").ravel()
    ranks, length = np.unique(packed, return_inverse=True)[1].astype(np.int32), 8
    del packed
    levels = [(length, ranks)]
    while length < limit:
        pair = ranks.astype(np.int64) << 32
        pair[: len(ranks) - length] += ranks[length:] + 1
        ranks, length = np.unique(pair, return_inverse=True)[1].astype(np.int32), 2 * length
        levels.append((length, ranks))
    return levels


def common_prefix(levels: list[tuple[int, np.ndarray]], buffer: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to limit."""
    same = np.zeros(len(a), np.int64)
    for length, ranks in reversed(levels):
        at, other = np.minimum(a + same, len(ranks) - 1), np.minimum(b + same, len(ranks) - 1)
        same += np.where((ranks[at] == ranks[other]) & (same + length <= limit), length, 0)
    for _ in range(min(7, limit % 8)):
        at, other = np.minimum(a + same, len(buffer) - 1), np.minimum(b + same, len(buffer) - 1)
        same += (buffer[at] == buffer[other]) & (same < limit)
    return same


def nearest_smaller(place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each entry, the nearest one before it with a smaller place, or -1; not before its own group's first entry.

    All entries between one and its candidate have larger places, so a candidate that is too large hands on its own.
    """
    found = np.arange(-1, len(place) - 1)
    found[found < first] = -1
    open_ = np.flatnonzero(found >= 0)
    while len(open_):
        open_ = open_[place[found[open_]] > place[open_]]
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def longest_previous(levels: list[tuple[int, np.ndarray]], raw: np.ndarray, order: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in their order: class by the first limit bytes, longest previous factor up to limit, and whether a factor that reaches it comes from here.

    Factors below the limit are given as 0. Every suffix has limit bytes of its own.
    """
    near = common_prefix(levels, raw, order[:-1], order[1:], limit) >= limit
    classes = np.concatenate([[0], np.cumsum(~near)]) if len(order) else np.empty(0, np.int64)
    factor, source = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
    among = np.flatnonzero(np.concatenate([[False], near]) | np.concatenate([near, [False]])) if len(order) else classes
    if len(among):
        place, own = order[among], classes[among]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.append(head, len(own)))
        before = nearest_smaller(place, np.repeat(head, size))
        after = len(own) - 1 - nearest_smaller(place[::-1], np.repeat(len(own) - (head + size)[::-1], size[::-1]))[::-1]
        for other in (before, np.where(after < len(own), after, -1)):
            has = np.flatnonzero(other >= 0)
            match = common_prefix(levels, raw, place[has], place[other[has]], limit)
            factor[among[has]] = np.maximum(factor[among[has]], match)
            source[among[other[has[match >= limit]]]] = True
    return classes, factor, source


def settle(kinds: list[dict], first_only: bool) -> Iterator[tuple]:
    """Rows of PARTS for kinds of one or several whole chunks, sorted by group and place."""
    buffer = b"".join(k["segment"] for k in kinds)
    raw = np.frombuffer(buffer, np.uint8)
    size, n = np.array([len(k["segment"]) for k in kinds]), np.array([k["n"] for k in kinds])
    base = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(kinds)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    places = base[owner] + step
    levels = prefix_ranks(buffer, LENGTH)
    order = np.argsort(levels[-1][1][places], kind="stable")
    once, large = np.array([k["copies"] for k in kinds]) == 1, np.array([k["large"] for k in kinds])
    for full, limit in ((True, LENGTH), (False, MATCH)):
        among = order[(base + size)[owner[order]] - places[order] >= limit]
        classes, factor, source = longest_previous(levels, raw, places[among], limit)
        later = factor >= limit
        gone = later if first_only or not full else (later | source) & once[owner[among]]
        at = np.sort(among[gone])
        if len(at):
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)]))
            for i, count in zip(at[heads].tolist(), np.diff(np.append(heads, len(at))).tolist(), strict=True):
                k = kinds[owner[i]]
                yield k["doc_id"], k["tag"], k["start"] + int(step[i]), count, full, None, None, None
        # of very large groups, the first place of each class goes on to the comparison between chunks
        for i in np.flatnonzero(~later & large[owner[among]]).tolist():
            p = among[i]
            k = kinds[owner[p]]
            w = xxhash.xxh3_128_digest(buffer[places[p] : places[p] + limit])
            yield k["doc_id"], k["tag"], k["start"] + int(step[p]), 1, full, k["g"], w, bool(source[i] or k["copies"] > 1)


def settle_chunks(mixed: DataFrame, first_only: bool) -> DataFrame:
    """Suffix arrays over whole chunks: mixed has g, chunk, large, copies, segment, n and the place of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            # chunks of one group may meet here; places must ascend over all of them
            held.sort(key=lambda k: (k["g"], k["doc_id"] is not None, k["doc_id"] or 0, k["tag"], k["start"]))
            cols = list(zip(*settle(held, first_only), strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "tag", "start", "n", "full", "g", "w", "settled"])

        for batch in batches:
            for part in slices(batch, 1 << 20):
                for row in part.to_pylist():
                    if size > ARRAY_BYTES and (row["g"], row["chunk"]) != last:
                        yield flush()
                        held, size = [], 0
                    held.append(row)
                    size, last = size + len(row["segment"]), (row["g"], row["chunk"])
        if held:
            yield flush()

    spread = mixed.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "doc_id", "tag", "start")
    return spread.mapInArrow(run, PARTS)


def repeated_spans(docs: DataFrame, first_only: bool) -> DataFrame:
    """doc_id, tag, start, n, full: places of strings that occur again. docs: doc_id, tag, text.

    Where full, strings of LENGTH bytes: first_only leaves the earliest copy (by doc_id, tag, start) of each, else every copy
    is given. Where not, the later copies of strings of MATCH bytes.
    """
    found = repeated_runs(docs, sketch_items(docs.select("text"), anchor_items, BYTES_PER_ANCHOR))
    place = F.struct("doc_id", "tag", "start")
    kinds = stored(
        found.groupBy("g", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.max("periodic").alias("periodic"), F.first("segment", True).alias("segment")),
        "byte-runs",
    )
    several = kinds.filter("copies > 1").select("g", "r1", "r2", "first")
    whole = found.drop("segment", "periodic").join(several, ["g", "r1", "r2"]).withColumn("later", ~place.eqNullSafe(F.col("first")))
    longer = F.least(F.col("n"), F.col("size") - (LENGTH - 1))
    sorts = [(longer, True, F.col("later") if first_only else F.lit(True)), (F.col("n"), False, F.col("later"))]
    spans = F.array_compact(F.array(*(F.when(test & (n > 0), F.struct("start", n.alias("n"), F.lit(full).alias("full"))) for n, full, test in sorts)))
    whole = whole.select("doc_id", "tag", F.explode(spans).alias("s")).select("doc_id", "tag", "s.*")
    groups = stored(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("different"), F.max("periodic").alias("periodic"), F.sum(F.octet_length("segment")).alias("bytes")).filter("different > 1 OR periodic").drop("periodic"), "byte-groups")
    parts = F.ceil(F.col("bytes") / CHUNK_BYTES)
    mixed = kinds.join(groups, "g").select("g", F.pmod(F.xxhash64("r1", "r2"), parts).cast("int").alias("chunk"), (parts > 1).alias("large"), "copies", "n", "segment", "first.*")
    out = stored(settle_chunks(mixed, first_only), "byte-windows")
    open_ = out.filter(F.col("w").isNotNull())
    classes = stored(open_.groupBy("g", "full", "w").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "byte-classes")
    later = ~place.eqNullSafe(F.col("first"))
    across = open_.join(classes, ["g", "full", "w"]).filter(later if first_only else F.when(F.col("full"), ~F.col("settled")).otherwise(later))
    cols = ["doc_id", "tag", "start", "n", "full"]
    return whole.select(cols).unionByName(out.filter(F.col("w").isNull()).select(cols)).unionByName(across.select(cols))


def deduplicated(docs: DataFrame, first_only: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_later and kept (the bytes that stay) of each document.

    first_only keeps the earliest copy of every string of LENGTH bytes; otherwise all copies go. n_later counts the bytes
    covered by strings of MATCH bytes that also start earlier in the corpus, whether they go or not. Rows that repeat both
    doc_id and text are told apart only by that: each has the other's strings.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(own).alias("tag"), own.alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, spans, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = unpacked(text.as_py())
            left, n, later = raw, 0, 0
            if spans:
                gone = covered([s for s in spans if s["full"]], len(raw), LENGTH)
                n = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                later = int(covered([s for s in spans if not s["full"]], len(raw), MATCH).sum())
            out.append((doc, len(raw), len(raw) - len(left), n, later, left))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_later", "kept"])

    return map_texts(with_spans(docs, repeated_spans(docs, first_only)), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, n_later long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document's bytes without any copy of a repeated 400-byte string, and what are later copies.

    A null text is empty; a null doc_id is a value of its own and the smallest; rows that repeat doc_id and text get equal
    results; an empty table gives no rows; other columns are ignored. Very long texts are worked on in whole, and one of a
    repeated byte or line is a few runs. Of copies, the one with the smallest doc_id, then the first in the text, is the
    earliest. n_later counts bytes in 256-byte strings that also start earlier; the earliest copy has none. repeats says
    whether there are any.
    """
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), first_only=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_later", (F.col("n_later") > 0).alias("repeats"))


ORACLE: dict[str, str] = {}
