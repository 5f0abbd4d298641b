"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words; the weight is the shingle's count times an inverse document
frequency between 1 and 1.5, so that a copy's edits, which are rare, do not outweigh what it shares. Document frequencies
come from a count sketch over all documents, merged slice by slice, whose size follows the corpus up to MOST_CELLS; what
other shingles add to a cell on average is taken off again, so that rare shingles weigh the same in corpora of any size.
Each of BANDS * ROWS samples picks one shingle with a chance in proportion to its weight, and two texts pick the same with a
chance equal to their weighted Jaccard similarity. Texts that agree in a whole band are candidates.

Candidates are verified by their weighted Jaccard similarity: first each text with the smallest text of each of its
buckets; then, in buckets that hold several components, with another text drawn for each bucket; then, in buckets that
still do, all texts of different components, in blocks of bounded size, so that no link between candidates is lost and
no bucket meets in one task. Exact copies are one text throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import mix64, poly
from .common import discard, give_back, merged_by_key, packed_texts, slices, stored, table, unpacked
from .graph import components, merged

#: Words of a shingle, least similarity, bands and samples of a band: a pair at the threshold is missed once in 2,700.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 15, 4
#: How far the weight of the rarest shingle exceeds that of one in every document.
IDF = 0.5
#: Rows of the frequency sketch, and as powers of two the least and most cells of a row and the cells of a slice. Tasks are
#: handed one byte a cell, 32 MB at most.
DEPTH, LEAST_CELLS, MOST_CELLS, SLICE = 2, 18, 24, 18
#: Bytes of text for each shingle, about, groups of tasks whose sketches are added first, and steps of a doubling in the byte.
BYTES_PER_SHINGLE, GROUPS, STEPS = 6, 16, 5
SKETCH_ROWS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
#: Rounds in which a text is drawn for each bucket, and texts of a bucket that are compared as one block.
DRAWS, BLOCK = 1, 128
#: Random variates of the sampling: a table of 65,536 triples (r, ln c, beta), indexed by a hash of shingle and sample.
TABLE_BITS = 16
SEED = 20240501


def text_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of the distinct shingles of each text, one text after another, and the number of each text's.

    A text of one to four words is one shingle; a text without words has none.
    """
    words: list[bytes] = []
    sizes = []
    for text in texts:
        own = text.encode().split()
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    units = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[coded.indices.to_numpy(zero_copy_only=False)]
    grams = mix64(poly(units, SHINGLE)) if len(units) >= SHINGLE else np.empty(0, np.uint64)
    at, hashes, counts, each = 0, [], [], []
    for n in sizes:
        if n >= SHINGLE:
            h, c = np.unique(grams[at : at + n - SHINGLE + 1], return_counts=True)
        elif n:
            h, c = mix64(poly(units[at : at + n], n) + np.uint64(n)), np.ones(1, np.int64)
        else:
            h, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        hashes.append(h)
        counts.append(c)
        each.append(len(h))
        at += n
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(hashes, np.uint64), join(counts, np.int64), np.array(each, np.int64)


def cells(item: np.ndarray, row: int, size: int) -> np.ndarray:
    return (mix64(item * np.uint64(SKETCH_ROWS[row])) >> np.uint64(64 - size)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """A slice as cells and counts if few are set, and else as counts of the least width that holds them; compressed."""
    seen = np.flatnonzero(counts)
    if len(seen) * 16 < len(counts):
        kind, body = b"s", np.concatenate([seen.astype("<u8"), counts[seen].astype("<u8")]).tobytes()
    else:
        kind, width = next((k, w) for k, w, most in ((b"1", "<u1", 1 << 8), (b"4", "<u4", 1 << 32), (b"8", "<u8", 1 << 64)) if int(counts.max()) < most)
        body = counts.astype(width).tobytes()
    return kind + zstandard.ZstdCompressor(level=1).compress(body)


def add(total: np.ndarray, blob: bytes) -> np.ndarray:
    kind, body = blob[:1], zstandard.ZstdDecompressor().decompress(blob[1:])
    if kind == b"s":
        at, n = np.frombuffer(body, "<u8").reshape(2, -1)
        total[at.astype(np.int64)] += n
    else:
        total += np.frombuffer(body, f"<u{kind.decode()}")
    return total


class Carried:
    """What counts of cells exceed 255 by, in units of 256, for the few cells that do."""

    def __init__(self):
        self.cells, self.units, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, at: np.ndarray, units: np.ndarray) -> None:
        if len(at):
            self.waiting.append((at, units))
        if sum(len(x) for x, _ in self.waiting) > 1 << 16:
            self.settle()

    def settle(self) -> None:
        cells_, units = (np.concatenate(x) for x in zip((self.cells, self.units), *self.waiting, strict=True))
        self.cells, at = np.unique(cells_, return_inverse=True)
        self.units, self.waiting = np.zeros(len(self.cells), np.int64), []
        np.add.at(self.units, at, units)

    def onto(self, low: np.ndarray, start: int) -> np.ndarray:
        """The whole counts of the cells from start on."""
        self.settle()
        counts = low.astype(np.uint64)
        a, b = np.searchsorted(self.cells, (start, start + len(low)))
        counts[self.cells[a:b] - start] += self.units[a:b].astype(np.uint64) << np.uint64(8)
        return counts


class Frequencies:
    """Document frequencies of shingles, in steps of a doubling, and the weights that follow."""

    def __init__(self, codes: list[np.ndarray], documents: int):
        self.codes, self.documents = codes, documents
        self.size = int(len(codes[0])).bit_length() - 1

    def idf(self, item: np.ndarray) -> np.ndarray:
        """1 + IDF * ln(N / df) / ln(N), between 1 (in every document) and 1 + IDF (in one)."""
        n = max(2, self.documents)
        doublings = np.minimum.reduce([c[cells(item, row, self.size)] for row, c in enumerate(self.codes)]) / STEPS
        return 1 + IDF * np.clip(1 - doublings * np.log(2) / np.log(n), 0, 1)


def frequencies(docs: DataFrame) -> Frequencies:
    """The frequencies of docs (text)."""
    whole = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    width = min(MOST_CELLS, max(LEAST_CELLS, int((whole[1] or 0) // BYTES_PER_SHINGLE).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() % GROUPS
        # the lowest byte of each count, and what is carried over from it
        low, carried = [np.zeros(1 << width, np.uint8) for _ in range(DEPTH)], [Carried() for _ in range(DEPTH)]
        for batch in batches:
            for part in slices(batch, 1 << 21):
                hashes, _, _ = text_shingles(part.column(0).to_pylist())
                for row in range(DEPTH):
                    at, n = np.unique(cells(hashes, row, width), return_counts=True)
                    n = n + low[row][at]
                    low[row][at] = (n & 255).astype(np.uint8)
                    carried[row].add(at[n > 255], n[n > 255] >> 8)
        for row in range(DEPTH):
            for k, part in enumerate(low[row].reshape(-1, 1 << SLICE)):
                counts = carried[row].onto(part, k << SLICE)
                if counts.any():
                    yield one((row << width - SLICE) + k, group, packed(counts))
        low.clear()
        give_back()

    def one(s: int, g: int, blob: bytes, documents: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([g], pa.int32()), pa.array([blob], pa.binary()), pa.array([documents], pa.int64())], names=["slice", "part", "cells", "items"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, _, blob, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.zeros(1 << SLICE, np.uint64)
                add(counts, blob)
                # what the other shingles add to a cell on average
                rest = (items - counts) / ((1 << width) - 1)
                own = np.maximum(1.0, counts - rest)
                yield one(s, 0, zstandard.ZstdCompressor(level=1).compress(np.minimum(255, np.round(STEPS * np.log2(own))).astype(np.uint8).tobytes()))

    schema = "slice int, part int, cells binary, items long"
    start, own = lambda: np.zeros(1 << SLICE, np.uint64), lambda total, row: add(total, row["cells"])
    first = merged_by_key(docs.select("text").mapInArrow(count, schema), ["slice", "part"], start, own, lambda key, counts: one(*key, packed(counts)), schema)
    last = stored(merged_by_key(first, ["slice"], start, own, lambda key, counts: one(key[0], 0, packed(counts), int(counts.sum())), schema), "frequencies")
    items = (last.agg(F.sum("items")).first()[0] or 0) / DEPTH
    codes = [np.zeros(1 << width, np.uint8) for _ in range(DEPTH)]
    for r in last.mapInArrow(coded, schema).toLocalIterator():  # the sketch, of bounded size
        row, k = divmod(r["slice"], 1 << width - SLICE)
        codes[row][k << SLICE : k + 1 << SLICE] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["cells"]), np.uint8)
    discard(last)
    return Frequencies(codes, whole[0])


def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = np.random.Generator(np.random.PCG64(SEED)).random((5, 1 << TABLE_BITS))
    u = np.maximum(u, 1e-12)
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32), u[4].astype(np.float32)


class Sampler:
    """BANDS * ROWS consistent samples of weighted sets (Ioffe's scheme), as one 64-bit key per band."""

    def __init__(self):
        self.r, self.c, self.beta = variates()
        self.inverse = 1 / self.r
        # ln a = ln c - r (t - beta) - r; the part without t is kept, moved so that it is positive
        self.fixed = self.c + self.r * self.beta - self.r + np.float32(64)
        self.odd = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def bands(self, hashes: np.ndarray, weights: np.ndarray, each: np.ndarray) -> np.ndarray:
        """(sets, BANDS) keys; every set has at least one element."""
        first = np.cumsum(each) - each
        log_weight = np.log(weights).astype(np.float32)
        own = (hashes >> np.uint64(7)) & np.uint64(0xFFFFFFFF)
        keys = np.empty((len(each), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(each), band + 1, np.uint64)
            for odd in self.odd[band * ROWS : (band + 1) * ROWS]:
                at = ((hashes * odd) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                t = np.floor(log_weight * self.inverse[at] + self.beta[at])
                a = self.fixed[at] - self.r[at] * t
                low = own ^ (t.astype(np.int64).astype(np.uint64) & np.uint64(0xFF)) * np.uint64(0x9E3779B1)
                best = np.minimum.reduceat((a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF)), first)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + (best & np.uint64(0xFFFFFFFF)))
            keys[:, band] = key
        return keys


def signatures(docs: DataFrame, known: Broadcast) -> DataFrame:
    """doc_id, node and the band keys (null for a text without words) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                hashes, counts, each = text_shingles(part.column(2).to_pylist())
                weights = counts * known.value.idf(hashes)
                keys = sampler.bands(hashes, weights, each[each > 0])
                rows = np.full(part.num_rows, -1)
                rows[each > 0] = np.arange(len(keys))
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.FixedSizeListArray.from_arrays(flat, BANDS).cast(pa.list_(pa.int64())).take(pa.array(rows, mask=rows < 0))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, bands array<bigint>")


def weighted_sets(docs: DataFrame, known: Broadcast) -> DataFrame:
    """node and items: the shingles of each compressed text (upper 32 bits of the hash, ascending) and their weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 19):
                hashes, counts, each = text_shingles([unpacked(x).decode() for x in part.column(1).to_pylist()])
                weights = (counts * known.value.idf(hashes)).astype("<f4")
                short = (hashes >> np.uint64(32)).astype("<u4")
                ends = np.cumsum(each)
                blobs = [short[b - n : b].tobytes() + weights[b - n : b].tobytes() for b, n in zip(ends.tolist(), each.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["node", "items"])

    return docs.select("node", "packed").mapInArrow(run, "node binary, items binary")


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 8
    return np.frombuffer(blob, "<u4", n), np.frombuffer(blob, "<f4", n, 4 * n).astype(float)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of the smaller weights over sum of the larger ones."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return both / (a[1].sum() + b[1].sum() - both)


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs that are similar."""
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(opened(x), opened(y)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """Each text with the smallest text of each of its buckets, which is the same one in most buckets of a group of copies."""
    leaders = stored(buckets.groupBy("band").agg(F.min("node").alias("b")), "leaders")
    return buckets.join(leaders, "band").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """buckets with each node's label, its own name where it has none, written so that large buckets can be split."""
    return stored(buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def other_pairs(own: DataFrame, draw: int) -> DataFrame:
    """In buckets of several components, each text with a text drawn for the bucket, another one for each bucket."""
    drawn = own.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band", F.lit(draw)).alias("h"), "node", "label")).alias("d"), F.min("label").alias("low"), F.max("label").alias("high"))
    drawn = stored(drawn.filter("low <> high").select("band", "d"), "drawn")
    pairs = own.join(drawn, "band").filter("label <> d.label").select(F.col("node").alias("a"), F.col("d.node").alias("b"))
    return pairs.distinct()


def block_links(own: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b: similar texts of one bucket that are in different components so far. own: band, node, label.

    A bucket's largest component, which needs no comparison with itself, and its other texts are dealt into blocks of about
    BLOCK; each pair of blocks but two of the largest component's meets in one task, which keeps only links.
    """
    parts = own.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = stored(mixed.select("band", F.col("main.label").alias("most"), blocks(F.col("main.n")).alias("inner"), blocks(F.col("n") - F.col("main.n")).alias("outer")), "sizes")
    rows = own.join(sizes, "band").withColumn("is_main", F.col("label") == F.col("most"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("is_main"), mine - F.col("inner")).otherwise(mine))
    # blocks of the main component are below 0, all others from 0 on; two blocks of the main component never meet
    others = F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.col("outer") - 1))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "label", "mine")
    full = rows.join(sets, "node").select("band", "i", "j", "node", "label", "mine", "items")

    def links(group: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        i, j = group[0]["i"], group[0]["j"]
        items = [opened(r["items"]) for r in group]
        total = [x[1].sum() for x in items]
        label = {r["label"]: r["label"] for r in group}

        def root(x: bytes) -> bytes:
            while label[x] != x:
                x = label[x]
            return x

        for p, a in enumerate(group):
            for q in range(p):
                b = group[q]
                if (i != j and a["mine"] == b["mine"]) or min(total[p], total[q]) < threshold * max(total[p], total[q]):
                    continue
                x, y = root(a["label"]), root(b["label"])
                if x != y and similarity(items[p], items[q]) >= threshold:
                    label[max(x, y)] = min(x, y)
                    yield a["node"], b["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: list[tuple[bytes, bytes]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["band"], row["i"], row["j"]) != (held[0]["band"], held[0]["i"], held[0]["j"]):
                    found += links(held)
                    held = []
                held.append(row)
        if held:
            found += links(held)
        yield out()

    spread = full.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return spread.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (16 bytes that stand for the text), class_id and representative for every row of docs (doc_id, text).

    class_id is the smallest doc_id of the class (null counts as largest) and representative marks the row, or repeated rows,
    that have it with the smallest node. Texts without words are near copies of nothing but their equals.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(own)).alias("node"), own.alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequencies(docs))
    rows = stored(signatures(docs, known), "signatures")
    nodes = rows.filter("bands IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    every = nodes.select("node", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    buckets = stored(every.join(shared, "band"), "buckets")
    involved = buckets.select("node").distinct()
    texts = packed_texts(docs.select("node", "text")).join(involved, "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed"))
    sets = stored(weighted_sets(texts, known), "sets")
    known.destroy()
    labels = components(stored(compared(leader_pairs(buckets), sets, threshold), "links"))
    for draw in range(DRAWS):
        own = labelled(buckets, labels)
        labels = merged(labels, stored(compared(other_pairs(own, draw), sets, threshold), "links"))
        discard(own)
    own = labelled(buckets, labels)
    labels = merged(labels, stored(block_links(own, sets, threshold), "links"))
    discard(own, buckets, sets)
    classed = stored(rows.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "classed")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")
    firsts = stored(classed.groupBy("label").agg(F.min(place).alias("first")), "firsts")
    discard(rows, labels)
    out = classed.join(firsts, "label")
    return out.select("doc_id", "node", F.col("first.doc_id").alias("class_id"), place.eqNullSafe(F.col("first")).alias("representative"))


def op4_icws_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document.

    A null text is empty, a null doc_id counts as the largest, repeated rows fall into one class, an empty table gives no
    rows and other columns are ignored. Very long texts are sets of all their shingles. Of a class, the smallest doc_id, then
    the smallest hash of the text, is the representative; rows that repeat it are representatives too.
    """
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "representative")


ORACLE: dict[str, str] = {}
