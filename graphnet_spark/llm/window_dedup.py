"""Substring dedup of word windows, with a count-min prefilter.

Every word covered by a window whose words also start earlier in the corpus is removed. A first pass sketches window
counts (see anchors.py); a second pass groups exactly, and only, the windows that are estimated to be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Sketch, anchors_of, covered, mix64, poly, runs, sketch_items, with_spans
from .common import discard, map_texts, slices, stored, table, unpacked

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 20, 5
#: Bytes of text for each anchor, about: a run has (WINDOW - ANCHOR + 2) / 2 windows on average.
BYTES_PER_ANCHOR = 50
RUNS = "doc_id long, tag long, g long, r1 long, r2 long, start int, n int, periodic boolean, windows binary"
FIRST = "doc_id", "tag", "start"


def word_units(batch: pa.RecordBatch, lanes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the words of a batch's texts (its last column) per lane, each word's text and its place there."""
    words: list[bytes] = []
    sizes = []
    for text in batch.column(batch.num_columns - 1):
        own = (text.as_py() or "").encode().split()
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    known = coded.dictionary.to_pylist()
    out = [np.fromiter((xxhash.xxh3_64_intdigest(w, seed=lane) for w in known), np.uint64, len(known))[ids] for lane in range(lanes)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out, doc, place


def anchor_items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in slices(batch, 1 << 21):
        (units,), doc, _ = word_units(part, 1)
        yield anchors_of(runs(units, doc, WINDOW, ANCHOR))


def repeated_runs(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Runs of windows that are estimated to be repeated: place, digest (r1, r2) and the windows' own hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        (a, b), doc, place = word_units(batch, 2)
        start, n, g, places = runs(a, doc, WINDOW, ANCHOR)
        keep = shared.value.repeated(g)
        start, n, g, places = start[keep], n[keep], g[keep], places[keep]
        if not len(start):
            return None
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(start, n) + step
        hashed = [mix64(poly(x, WINDOW)[at]) for x in (a, b)]
        tag = mix64(step.astype(np.uint64) + np.uint64(1))
        digest = [mix64(np.add.reduceat(mix64(h + tag), first) + n.astype(np.uint64)) for h in hashed]
        ends = np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(hashed[0].astype("<u8"))])
        of = pa.array(doc[start])
        signed = [pa.array(x.view(np.int64)) for x in (g, *digest)]
        cols = [batch.column(0).take(of), batch.column(1).take(of), *signed, pa.array(place[start].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places > 1), blob]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "g", "r1", "r2", "start", "n", "periodic", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 21):
                if (out := rows(part)) is not None:
                    yield out

    return docs.mapInArrow(run, RUNS)


def other(place: tuple[str, ...], first: str = "first") -> Column:
    """Whether a place differs from the first one."""
    return ~F.struct(*place).eqNullSafe(F.col(first))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag, start, n: the n windows from word `start` on also start earlier. docs: doc_id, tag, text.

    Runs are grouped by digest, and all but the first of equal ones are repeats. Where an anchor has different runs,
    or a run several anchors, the windows of the first run of each kind are grouped one by one. The spans are written, and
    the larger tables that lead to them deleted, before any text is shuffled.
    """
    found = repeated_runs(docs, sketch_items(docs.select("text"), anchor_items, BYTES_PER_ANCHOR))
    kinds = stored(found.groupBy("g", "r1", "r2").agg(F.min(F.struct(*FIRST)).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("periodic").alias("periodic"), F.first("windows").alias("windows")), "runs")
    several = kinds.filter("copies > 1").select("g", "r1", "r2", "first")
    whole = found.drop("windows", "periodic").join(several, ["g", "r1", "r2"]).filter(other(FIRST)).select("doc_id", "tag", "start", "n")
    mixed = stored(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("different"), F.max("periodic").alias("periodic")).filter("different > 1 OR periodic").select("g"), "groups")
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("windows") / 8).cast("int") - 1))
    single = kinds.join(mixed, "g").select("g", "first", "windows", place.alias("i"))
    single = single.select("g", F.substring("windows", F.col("i") * 8 + 1, F.lit(8)).alias("w"), F.struct("first.doc_id", "first.tag", (F.col("first.start") + F.col("i")).alias("start")).alias("own"))
    single = stored(single, "windows")
    twice = stored(single.groupBy("g", "w").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"), "classes")
    parts = single.join(twice, ["g", "w"]).filter(~F.col("own").eqNullSafe(F.col("first"))).select("own.*", F.lit(1).alias("n"))
    spans = stored(whole.unionByName(parts), "spans")
    discard(kinds, mixed, single, twice)
    return spans


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of each document.

    Rows that repeat both doc_id and text count as one document and get the same result.
    """
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(own).alias("tag"), own.alias("text"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, spans, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = unpacked(text.as_py()).split()
            if spans:
                gone = covered(spans, len(words), WINDOW)
                left = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            else:
                left = words
            out.append((doc, len(words), len(words) - len(left), b" ".join(left)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return map_texts(with_spans(docs, repeated_spans(docs)), rows, "doc_id long, n_words long, n_removed long, kept string")


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What dedup keeps of each document.

    A null text has no words; a null doc_id counts as the smallest; an empty table gives no rows; other columns are ignored.
    """
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op8_window_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM gone, (SELECT unnest(range(0, 20)) AS j)),
lst AS (SELECT doc_id, list(p) AS ps FROM cov GROUP BY 1),
k AS (SELECT d.doc_id, w, CASE WHEN ps IS NULL THEN w ELSE [w[x] FOR x IN range(1, len(w) + 1) IF NOT list_contains(ps, x)] END AS kept FROM d LEFT JOIN lst USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""
}
