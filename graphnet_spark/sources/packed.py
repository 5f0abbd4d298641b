"""Packed record shards as a data source: format("packed_records") for batch reads and streams.

A shard has no header, so any record-aligned range of it can be read by itself. Batch reads cut shards into such ranges, and
options on files and rows prune them: only the shards and records that they leave are opened and read. Streams keep a
place (shard and byte) as their offset and take a bounded number of bytes a batch.

Filters are not pushed to the source: in Spark 4.1.2 two plans over one Python relation share what was pushed last, so that the
union of row = 1 and row = 2 has row 2 twice. Pruning is by options, which belong to one relation, and by lookup().

Options: path (a folder of .bin files, or one file, by a path or URI that tasks reach), inputs and outputs (values of a
record), split_bytes (bytes of a partition, 32 MB), read_bytes (bytes of one read, 2 MB, at most 64 MB), batch_bytes (bytes of a
stream's batch, 64 MB) and count_bytes (true adds the column bytes, whose sum is what was read).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .records import RECORDS, RecordError, buffer_bytes, check

FORMAT = "packed_records"


@dataclass(frozen=True)
class Layout:
    """Where shards are and what their records hold."""

    path: str
    inputs: int
    outputs: int
    split_bytes: int = 32 << 20
    read_bytes: int = 2 << 20
    batch_bytes: int = 64 << 20
    count_bytes: bool = False
    files: frozenset[str] | None = None
    rows: tuple[int, ...] | None = None
    first_row: int = 0
    last_row: int | None = None

    @classmethod
    def of(cls, options: dict[str, str]) -> Layout:
        given = {k.lower(): v for k, v in options.items()}
        if not given.get("path"):
            raise RecordError("packed records need a path")
        numbers = {k: int(given[k]) for k in ("split_bytes", "read_bytes", "batch_bytes") if k in given}
        if any(n <= 0 for n in numbers.values()):
            raise RecordError("byte options are positive")
        numbers |= {k: int(given[k]) for k in ("first_row", "last_row") if k in given}
        files = frozenset(json.loads(given["files"])) if "files" in given else None
        rows = tuple(sorted(set(json.loads(given["rows"])))) if "rows" in given else None
        out = cls(given["path"], int(given.get("inputs", 0)), int(given.get("outputs", 0)), count_bytes=given.get("count_bytes", "false").lower() == "true", files=files, rows=rows, **numbers)
        check(out.inputs, out.outputs)
        return out

    @property
    def size(self) -> int:
        return check(self.inputs, self.outputs)

    def store(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        """The file system, the path in it, and what a file's path starts with in results."""
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", self.path)
        if not scheme or scheme[1] == "file":
            return pyarrow.fs.LocalFileSystem(), str(Path(re.sub("^file:/*", "/", self.path)).absolute()), "file:"
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        return files, base, f"{scheme[1]}://"

    def shards(self) -> list[tuple[str, int]]:
        """Path and bytes of every shard, by number where the name is one, all others after them by name."""
        files, base, _ = self.store()
        info = files.get_file_info(base)
        if info.type == pyarrow.fs.FileType.File:
            found = [info]
        else:
            found = [f for f in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if f.type == pyarrow.fs.FileType.File and f.extension == "bin"]
        return [(f.path, f.size) for f in sorted(found, key=lambda f: place_of(f.path))]

    def records(self, path: str, length: int) -> int:
        if length % self.size:
            raise RecordError(f"{path}: {length} bytes are not whole records of {self.size}")
        return length // self.size


def place_of(path: str) -> tuple:
    name = path.rsplit("/", 1)[-1].removesuffix(".bin")
    number = int(name) if re.fullmatch(r"[0-9]{1,18}", name) else None
    return (number is None, number or 0, path)


class Ranges(InputPartition):
    """Runs (first row, rows) of one shard."""

    def __init__(self, path: str, runs: list[tuple[int, int]]):
        self.path, self.runs = path, runs


def runs_of(rows: list[int]) -> list[tuple[int, int]]:
    """Sorted distinct rows as runs of neighbours."""
    out: list[list[int]] = []
    for r in rows:
        if out and r == out[-1][0] + out[-1][1]:
            out[-1][1] += 1
        else:
            out.append([r, 1])
    return [(a, n) for a, n in out]


def batches_of(layout: Layout, part: Ranges | None) -> Iterator[pa.RecordBatch]:
    """The records of a partition (None: where there are none); each read is of whole records, and no byte beyond them is asked for."""
    if part is None:
        return
    files, _, prefix = layout.store()
    width, size, most = layout.inputs + layout.outputs, layout.size, buffer_bytes(layout.size, layout.read_bytes) // layout.size
    ends = lambda n, w: pa.array(np.arange(0, n * w + 1, w, dtype=np.int32))
    with files.open_input_file(part.path) as f:
        for first, n in part.runs:
            for at in range(first, first + n, most):
                k = min(most, first + n - at)
                raw = f.read_at(k * size, at * size)
                if len(raw) != k * size:
                    raise RecordError(f"{part.path} ends before record {at + k}")
                x = np.frombuffer(raw, "<f4").reshape(k, width)
                lists = [pa.ListArray.from_arrays(ends(k, w), pa.array(np.ascontiguousarray(v).ravel())) for w, v in ((layout.inputs, x[:, : layout.inputs]), (layout.outputs, x[:, layout.inputs :]))]
                columns = [pa.array([prefix + part.path] * k), pa.array(np.arange(at, at + k)), *lists]
                names = ["file", "row", "inputs", "outputs"]
                if layout.count_bytes:
                    columns.append(pa.array(np.full(k, size)))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names=names)


class PackedReader(DataSourceReader):
    """Record-aligned ranges of the shards, as far as the options leave any."""

    def __init__(self, layout: Layout):
        self.layout = layout

    def partitions(self) -> list[Ranges]:
        at, prefix, out = self.layout, self.layout.store()[2], []
        step = max(1, at.split_bytes // at.size)
        for path, length in at.shards():
            if at.files is not None and prefix + path not in at.files:
                continue
            n = at.records(path, length)
            low, high = max(0, at.first_row), n if at.last_row is None else min(n, at.last_row + 1)
            if at.rows is None:
                out += [Ranges(path, [(r, min(step, high - r))]) for r in range(low, high, step)]
            else:
                rows = [r for r in at.rows if low <= r < high]
                out += [Ranges(path, runs_of(rows[k : k + step])) for k in range(0, len(rows), step)]
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return batches_of(self.layout, partition)


class PackedStream(DataSourceStreamReader):
    """Shards in their order; an offset is a shard and how many of its bytes, in whole records, were taken.

    A batch takes batch_bytes at most (one record at least), so a slow query holds the source back rather than
    falling behind. Shards are complete when they get their names, and later ones come after earlier ones in order.
    """

    def __init__(self, layout: Layout):
        self.layout, self.at = layout, None

    def initialOffset(self) -> dict:
        return {"shard": "", "byte": 0}

    def remaining(self, start: dict) -> list[tuple[str, int, int]]:
        """Path, first byte and length of the shards that have bytes after an offset."""
        out = []
        for path, length in self.layout.shards():
            self.layout.records(path, length)
            if not start["shard"] or place_of(path) > place_of(start["shard"]):
                out.append((path, 0, length))
            elif path == start["shard"]:
                out.append((path, start["byte"], length))
        return [x for x in out if x[1] < x[2]]

    def latestOffset(self) -> dict:
        self.at = self.at or self.initialOffset()
        left = max(1, self.layout.batch_bytes // self.layout.size) * self.layout.size
        for path, first, length in self.remaining(self.at):
            taken = min(left, length - first)
            self.at, left = {"shard": path, "byte": first + taken}, left - taken
            if not left:
                break
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        self.at = self.at or end  # after a restart, go on from the last planned batch
        size, out = self.layout.size, []
        step = max(1, self.layout.split_bytes // size)
        for path, first, length in self.remaining(start):
            if place_of(path) > place_of(end["shard"] or path):
                break
            last = min(length, end["byte"]) if path == end["shard"] else length
            out += [Ranges(path, [(r, min(step, last // size - r))]) for r in range(first // size, last // size, step)]
        return out if end["shard"] else []

    def commit(self, end: dict) -> None:
        self.at = self.at or end

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return batches_of(self.layout, partition)


class PackedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORDS + (", bytes BIGINT" if Layout.of(self.options).count_bytes else "")

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(Layout.of(self.options))

    def streamReader(self, schema: StructType) -> PackedStream:
        return PackedStream(Layout.of(self.options))


def scan(spark: SparkSession, path: str, inputs: int, outputs: int, files: list[str] | None = None, rows: list[int] | None = None, **options) -> DataFrame:
    """file, row, inputs and outputs of all records, many tasks to a shard; of those that files and rows name, if they are given."""
    spark.dataSource.register(PackedRecords)
    named = {k: json.dumps(list(v)) for k, v in (("files", files), ("rows", rows)) if v is not None}
    return spark.read.format(FORMAT).options(path=path, inputs=inputs, outputs=outputs, **named, **options).load()


def stream(spark: SparkSession, path: str, inputs: int, outputs: int, **options) -> DataFrame:
    """The same records as a stream of bounded batches."""
    spark.dataSource.register(PackedRecords)
    return spark.readStream.format(FORMAT).options(path=path, inputs=inputs, outputs=outputs, **options).load()


def record(spark: SparkSession, path: str, inputs: int, outputs: int, file: str, row: int) -> DataFrame:
    """One record of one shard; only its bytes are read. A row beyond the shard's end gives none."""
    return scan(spark, path, inputs, outputs, [file], [row])


def lookup(wanted: DataFrame, path: str, inputs: int, outputs: int, count_bytes: bool = False) -> DataFrame:
    """The records of a table of places (file, row), each read by itself or with its wanted neighbours.

    Places are dealt by ranges of file and row, so that one shard's many places go to many tasks, and each record is read
    once however often it is asked for. Rows that a shard does not have are an error, null places are left out.
    """
    layout = Layout(path, inputs, outputs, count_bytes=count_bytes)
    check(inputs, outputs)
    base, prefix = layout.store()[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = batch.column(0), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(files.dictionary_encode().indices.to_numpy())) + 1).tolist(), len(rows)] if len(rows) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                file = files[a].as_py()
                if not file.startswith(prefix + base):
                    raise RecordError(f"{file} is not below {path}")
                yield from batches_of(layout, Ranges(file.removeprefix(prefix), runs_of(rows[a:b].tolist())))

    places = wanted.select(F.col("file").cast("string").alias("file"), F.col("row").cast("long").alias("row")).dropna().distinct()
    schema = RECORDS + (", bytes BIGINT" if count_bytes else "")
    return places.repartitionByRange("file", "row").sortWithinPartitions("file", "row").mapInArrow(run, schema)
