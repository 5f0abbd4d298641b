"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of a text are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications that name no shared folder.
OWN_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and Spark runs on one machine, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        base = OWN_FOLDERS[app] = OWN_FOLDERS.get(app) or tempfile.mkdtemp(prefix="graphnet-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that later jobs do not repeat its work."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def extended(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def row_key(*cols: Column) -> Column:
    """16 bytes that tell rows apart by these columns; nulls count as a value of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of these columns: 52 bits, the same in any SQL engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch. Batches are cut so that a slice holds about 16 MB of its last column's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def packed_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text column, which must hold no nulls, as a compressed binary column named packed, in the last place.

    Texts are compressed one by one before they are shuffled, to half of what the shuffle's own blocks come to.
    """
    rest = [c for c in df.columns if c != text]

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            small = pa.array([z.compress(x.as_py().encode()) for x in batch.column(len(rest))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], small], names=[*rest, "packed"])

    return df.select(*rest, text).mapInArrow(shrink, extended(df.select(*rest).schema, "packed binary"))


def unpacked_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The opposite of packed_texts; packed is the last column."""
    rest = df.columns[:-1]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 20):
                texts = pa.array([unpacked(x).decode() for x in part.column(len(rest)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*rest, text])

    return df.mapInArrow(grow, extended(df.select(*rest).schema, f"`{text}` string"))


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def slices(batch: pa.RecordBatch, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(n, n * limit // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, which workers that wait for their next task would keep."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(c := ctypes.CDLL(libc), "malloc_trim"):
        c.malloc_trim(0)


def merged_by_key(rows: DataFrame, keys: list[str], start: Callable[[], Any], add: Callable[[Any, dict], Any], finish: Callable[[tuple, Any], pa.RecordBatch], schema: str) -> DataFrame:
    """Folds the rows of each key, one key at a time, whatever number of keys a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for part in slices(batch, 1 << 22):
                for row in part.to_pylist():
                    if (key := tuple(row[k] for k in keys)) != last:
                        if last is not None:
                            yield finish(last, total)
                        last, total = key, start()
                    total = add(total, row)
        if last is not None:
            yield finish(last, total)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
