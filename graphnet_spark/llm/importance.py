"""Importance resampling towards a target distribution over hashed runs of words.

One scan per document keeps a ring of running CRC-32 states, one for each of the last few words as a start; each further
word extends them by a blank and its bytes, so a run's hash never rereads its words. The scan leaves two bytes per feature
in a table; counting, weighting and drawing read that table and no text again. Only bucket counts, whose number is a
parameter, reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, extended, map_texts, stored, table

BUCKETS, SHORTEST, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 1, 20, 10, "2024"
#: Words in UTF-8 once A to Z are lower case: digits, lower-case letters and whatever is not ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def run_hashes(words: Iterable[bytes], shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[int, array]:
    """The number of words, and the CRC-32 of every run of shortest to longest consecutive words joined by one blank."""
    crc, out, ring, n = zlib.crc32, array("I"), [], 0
    for word in words:
        ring = [crc(word, crc(b" ", state)) for state in ring[max(0, len(ring) - longest + 1) :]]
        ring.append(crc(word))
        out.extend(ring[: len(ring) - shortest + 1] if len(ring) >= shortest else ())
        n += 1
    return n, out


def scanned(texts: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The columns of texts but the last, which is the text, with n_words and the features' buckets as little-endian numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    *kept, text = texts.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, found = [], []
        for raw in batch.column(len(kept)):
            words = (m.group() for m in WORDS.finditer((raw.as_py() or b"").lower()))
            n, hashes = run_hashes(words, shortest, longest)
            counts.append(n)
            found.append((np.frombuffer(hashes, np.uint32) % buckets).astype(kind).tobytes())
        columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "buckets"])

    schema = extended(texts.select(*kept).schema, "n_words long, buckets binary")
    return map_texts(texts.select(*kept, F.col(text).cast("string").cast("binary").alias("text")), rows, schema)


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of a binary column's values, and where each value's end."""
    parts = [x.as_py() for x in column]
    return np.frombuffer(b"".join(parts), kind), np.cumsum([len(p) for p in parts], dtype=np.int64) // np.dtype(kind).itemsize


def bucket_counts(scan: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: tasks count what they hold, and sums of at most `buckets` rows reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in scan.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the source, both smoothed by one."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + float(size)) / ((s + 1.0) * (t_all + float(size)))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(scan: DataFrame, gains: np.ndarray) -> DataFrame:
    """scan with n_features and weight, the floored mean of its features' gains (0 without any), instead of the buckets."""
    kept, kind = [c for c in scan.columns if c != "buckets"], "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = flat(batch.column(len(kept)), kind)
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
            n = ends - starts
            weight = np.where(n > 0, (sums[ends] - sums[starts]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(weight)], names=[*kept, "n_features", "weight"])

    return scan.select(*kept, "buckets").mapInArrow(run, extended(scan.select(*kept).schema, "n_features long, weight long"))


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(1000 g) of a Gumbel variate g drawn from the sha256 of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, in the given total order: sorted by ranges, numbered within these, and moved on by the counts before.

    No partition is ever held whole, and the driver sees one count for each partition.
    """
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before, starts = 0, []
    for k, n in sorted(placed.groupBy("_part").count().collect()):
        starts.append((k, before))
        before += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _first long"))
    place = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(first, "_part").withColumn(name, place).drop("_at", "_part", "_first")


def resampled(documents: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, seed: str = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document (doc_id, text); the rank is null where it is not drawn.

    target has a text column. Documents of at least least_words words take part in the draw.
    """
    scan = stored(scanned(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shortest, longest, buckets), "scanned")
    gains = bucket_gains(bucket_counts(scan, buckets), bucket_counts(scanned(target.select("text"), shortest, longest, buckets), buckets))
    rows = weighted(scan, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = rows.withColumn("_in", F.col("n_words") >= least_words)
    order = [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(rows, order)
    drawn = percent * placed.filter("_in").count() // 100
    discard(scan)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_in") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


def op13_importance_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark texts.

    Null and empty texts have no features, weigh 0 and are not drawn; very long texts are scanned word by word. Ties in score go
    to the smaller doc_id, null last; rows that repeat a doc_id take a place each. Without documents there are no rows, without
    benchmark texts all counts of the target are 0. Other columns are ignored, whatever their names.
    """
    out = resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op13_importance_ring": f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v
    FROM range(256) r(i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), used AS (
  SELECT r, unnest(words) AS w FROM docs
), wanted AS (
  SELECT unnest({_WORDS}) AS w FROM benchmark
), known AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda s, b: xor(s // 256, t[(xor(s, b) & 255) + 1]))) % 10000 AS bucket
  FROM (SELECT w FROM used UNION SELECT w FROM wanted), crc
), s AS (SELECT bucket, count(*) AS n FROM used JOIN known USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN known USING (w) GROUP BY bucket),
gains AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM used) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS g
  FROM range(10000) x(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b
), sums AS (SELECT r, sum(g)::DOUBLE AS g, count(*) AS n FROM used JOIN known USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(floor(sums.g / sums.n), 0)::BIGINT AS weight,
    (coalesce(floor(sums.g / sums.n), 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM drawn
"""
}
