"""Sums of streams in a folder, merged by batch: a batch that runs again replaces what it wrote, so nothing counts twice.

Each batch's sums per key go to a folder of its own, batch=<id>. Every so often the sums of all batches so far are written to
upto=<id>, and the folders that it replaces are deleted. A folder counts once it is complete; a batch at or below the
last complete upto is in it already and is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_path

COMPACT_EVERY = 50


class SummedBatches:
    """Sums of the columns `names` per `keys` below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], names: list[str], compact_every: int = COMPACT_EVERY):
        if compact_every < 1:
            raise ValueError("compact_every is at least 1")
        self.spark, self.path, self.keys, self.names, self.every = spark, path.rstrip("/"), keys, names, compact_every
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.folder = self.hadoop.Path(self.path)
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> tuple[int | None, list[int]]:
        """The last complete upto, and the complete batches after it."""
        found: dict[str, list[int]] = {"upto": [], "batch": []}
        for f in self.files.listStatus(self.folder) if self.files.exists(self.folder) else ():
            kind = re.fullmatch(r"(upto|batch)=(\d+)", f.getPath().getName())
            if kind and self.files.exists(self.hadoop.Path(f.getPath(), "_SUCCESS")):
                found[kind[1]].append(int(kind[2]))
        upto = max(found["upto"], default=None)
        return upto, sorted(b for b in found["batch"] if upto is None or b > upto)

    def summed(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*(F.sum(n).alias(n) for n in self.names))

    def of(self, upto: int | None, batches: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/upto={upto}"] * (upto is not None) + [f"{self.path}/batch={b}" for b in batches]
        return self.summed(self.spark.read.parquet(*paths)) if paths else None

    def __call__(self, df: DataFrame, batch: int) -> None:
        """What foreachBatch calls."""
        upto, _ = self.folders()
        if upto is not None and batch <= upto:
            return
        self.summed(df).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        upto, batches = self.folders()
        done = [b for b in batches if b <= batch]
        if len(done) >= self.every:
            self.of(upto, done).write.mode("overwrite").parquet(f"{self.path}/upto={batch}")
            for name in [f"upto={upto}"] * (upto is not None) + [f"batch={b}" for b in done]:
                self.files.delete(self.hadoop.Path(self.folder, name), True)

    def total(self) -> DataFrame | None:
        """The sums of all complete batches; None before the first."""
        return self.of(*self.folders())


def for_each_batch(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str | None = None, **trigger) -> None:
    """Calls call(rows, batch id) for all that is available now, batch by batch; an error of the call ends the stream and is raised.

    A batch whose call did not end runs again with the same id and rows when the stream starts again from its checkpoint.
    """
    where = checkpoint or shared_path(stream.sparkSession, "checkpoint")
    writer = stream.writeStream.foreachBatch(call).option("checkpointLocation", where).outputMode("update")
    query = writer.trigger(**trigger).start() if trigger else writer.start()
    try:
        if trigger.get("availableNow"):
            query.awaitTermination()
        else:
            query.processAllAvailable()
    finally:
        query.stop()


def summed_stream(stream: DataFrame, keys: list[str], names: list[str], compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The sums of all that a stream has now, from a folder; no key reaches the driver."""
    sums = SummedBatches(stream.sparkSession, shared_path(stream.sparkSession, "sums"), keys, names, compact_every)
    for_each_batch(stream, sums)
    total = sums.total()
    return total if total is not None else stream.sparkSession.createDataFrame([], stream.select(*keys, *names).schema)
