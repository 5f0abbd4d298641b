"""Packed binary records: little-endian 32-bit floats, inputs then targets, in numbered .bin shards.

Shards are read by Spark's binaryFile source, so any store and both batch and streaming work; files are the unit of
parallelism, and a file is decoded in one step by numpy.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = "path STRING, length BIGINT, content BINARY"
#: Fixed value: most bytes of a written file. Readers hold a file whole.
FILE_BYTES = 64 << 20
RECORDS = "file STRING, row BIGINT, inputs ARRAY<FLOAT>, outputs ARRAY<FLOAT>"


class RecordError(ValueError):
    """A layout or a shard that does not fit."""


def check(inputs: int, outputs: int) -> int:
    """Bytes of a record."""
    if inputs <= 0 or outputs <= 0:
        raise RecordError("records need inputs and outputs")
    return 4 * (inputs + outputs)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """path, length, stem order and content of .bin files; a missing folder has none. The content is read only if asked for."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or str(e)):
            raise
        return spark.createDataFrame([], f"{SHARDS}, number BIGINT")
    stem = F.regexp_extract("path", r"([^/]*)\.bin$", 1)
    return files.select("path", "length", "content", stem.try_cast("bigint").alias("number"))


def in_order(files: DataFrame) -> DataFrame:
    """By number where the name is one, all others after them by name."""
    return files.orderBy(F.col("number").asc_nulls_last(), "path")


def bad_shards(files: DataFrame, record_bytes: int) -> DataFrame:
    return files.filter(F.col("length") % record_bytes != 0).select("path", "length")


def decode(files: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """file, row, inputs and outputs of every record; a shard that does not hold whole records is an error."""
    size, width = check(inputs, outputs), inputs + outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                if raw.size % size:
                    raise RecordError(f"{path}: {raw.size} bytes are not whole records of {size}")
                x = np.frombuffer(raw, "<f4").reshape(-1, width)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000]
                    ends = lambda w, n=len(part): pa.array(np.arange(0, n * w + 1, w, dtype=np.int32))
                    lists = [pa.ListArray.from_arrays(ends(w), pa.array(np.ascontiguousarray(p).ravel())) for w, p in ((inputs, part[:, :inputs]), (outputs, part[:, inputs:]))]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), *lists], names=["file", "row", "inputs", "outputs"])

    return files.select("path", "content").mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str, inputs: int, outputs: int) -> DataFrame:
    return decode(shards(spark, path), inputs, outputs)


def read_stream(spark: SparkSession, path: str, inputs: int, outputs: int, files_per_batch: int = 1) -> DataFrame:
    check(inputs, outputs)
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.bin").option("maxFilesPerTrigger", files_per_batch).load(path)
    return decode(files, inputs, outputs)


def count(spark: SparkSession, path: str, inputs: int, outputs: int) -> DataFrame:
    """The number of records, from file lengths alone."""
    size = check(inputs, outputs)
    return shards(spark, path).select(F.coalesce(F.sum((F.col("length") / size).cast("bigint")), F.lit(0)).alias("records"))


def record(spark: SparkSession, path: str, inputs: int, outputs: int, row: int) -> DataFrame:
    """One record of one shard by its place."""
    return read(spark, path, inputs, outputs).filter(F.col("row") == row)


def buffer_bytes(record_bytes: int, asked: int = 2 << 20) -> int:
    """Bytes of one read: at least a record and at most 64 MiB, in whole records."""
    return max(record_bytes, min(asked, 64 << 20) // record_bytes * record_bytes)


def joined(batch: pa.RecordBatch) -> np.ndarray:
    """The records of a batch whose last two columns are the lists of inputs and outputs."""
    parts = []
    for lists in batch.columns[-2:]:
        width = pc.unique(pc.list_value_length(lists)).to_pylist()
        if len(width) != 1 or not width[0]:
            raise RecordError("records need inputs and outputs, as many in every row")
        parts.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width[0]))
    return np.ascontiguousarray(np.concatenate(parts, axis=1), "<f4")


def write(df: DataFrame, path: str, inputs: str, outputs: str, shard: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes the rows of every value of the integer column shard into .bin files of at most file_bytes (or one record).

    Rows are dealt by ranges of shard and row, and tasks write them in this order as they come, so neither a shard nor a
    partition is ever held whole; only file names reach the driver. Names sort by shard and row. A file gets its .bin
    name once all tasks are done, so failed attempts leave none. path is a new folder that tasks reach by its URI.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(folder) and any(f.getPath().getName().endswith(".bin") for f in store.listStatus(folder)):
        raise RecordError(f"{path} has shards already")
    store.mkdirs(folder)
    place = re.sub("^file:/+", "file:///", store.makeQualified(folder).toString())
    rows = df.select(F.col(shard).cast("long").alias("shard"), F.col("row").alias("row"), F.col(inputs).cast("array<float>").alias("i"), F.col(outputs).cast("array<float>").alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(place)
        part, names, out, left, last, width = TaskContext.get().partitionId(), [], None, 0, None, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, keys = joined(batch), batch.column(0)
                if keys.null_count or pc.min(keys).as_py() < 0 or width not in (None, x.shape[1]):
                    raise RecordError("shards are numbers from 0, and all records of one length")
                keys, width = keys.to_numpy(), x.shape[1]
                per_file, at = max(1, file_bytes // (4 * width)), 0
                while at < len(x):
                    if not left or keys[at] != last:
                        if out:
                            out.close()
                        last, left = int(keys[at]), per_file
                        names.append((f"{uuid.uuid4().hex}.part", f"{last:019}-{part:07}-{len(names):07}.bin"))
                        out = files.open_output_stream(f"{base}/{names[-1][0]}")
                    end = min(at + left, int(np.searchsorted(keys, last, "right")))
                    out.write(x[at:end])
                    at, left = end, left - (end - at)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n[k] for n in names], pa.string()) for k in range(2)], names=["part", "name"])

    dealt = rows.repartitionByRange("shard", "row").sortWithinPartitions("shard", "row")
    for r in dealt.mapInArrow(run, "part STRING, name STRING").collect():  # two names a file
        if not store.rename(hadoop.Path(folder, r["part"]), hadoop.Path(folder, r["name"])):
            raise RecordError(f"{path}/{r['name']} could not be named")
