"""Packed shards as a data source: splits, pushed filters, bytes read, streams and restarts."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphnet_spark.sources import packed, records


def write(folder, name, n, width=3, first=0):
    x = (np.arange(n * width, dtype="<f4") + first).reshape(n, width)
    os.makedirs(folder, exist_ok=True)
    x.tofile(f"{folder}/{name}.bin")
    return x


def rows(df):
    return sorted((os.path.basename(r["file"]), r["row"], *r["inputs"], *r["outputs"]) for r in df.collect())


@pytest.fixture
def shards(tmp_path):
    a, b, c = write(tmp_path / "s", "10", 1000), write(tmp_path / "s", "9", 37, first=5000), write(tmp_path / "s", "x", 3, first=9000)
    write(tmp_path / "s", "11", 0)
    (tmp_path / "s" / "note.txt").write_text("no shard")
    all_ = [(f"{n}.bin", k, *map(float, v)) for n, x in (("10", a), ("9", b), ("x", c)) for k, v in enumerate(x)]
    return f"{tmp_path}/s", sorted(all_)


def test_one_shard_is_read_by_many_tasks(spark, shards):
    path, want = shards
    df = packed.scan(spark, path, 2, 1, split_bytes=1200, read_bytes=100)
    assert rows(df) == want and rows(df) == rows(records.read(spark, path, 2, 1))
    parts = packed.PackedReader(packed.Layout(path, 2, 1, split_bytes=1200)).partitions()
    assert [len([p for p in parts if p.path.endswith(f"/{n}.bin")]) for n in ("9", "10", "11", "x")] == [1, 10, 0, 1]
    assert df.select(F.spark_partition_id()).distinct().count() == len(parts) == 12
    assert [os.path.basename(p) for p, _ in packed.Layout(path, 2, 1).shards()] == ["9.bin", "10.bin", "11.bin", "x.bin"]


def test_options_prune_shards_and_records(spark, shards):
    path, want = shards
    one = f"file:{path}/10.bin"
    for options, rule in (
        ({"rows": [36]}, lambda r: r[1] == 36), ({"files": [one], "rows": [999, 5, 6, 7, 7, 4000, -1]}, lambda r: r[0] == "10.bin" and r[1] in (5, 6, 7, 999)),
        ({"first_row": 991, "last_row": 995}, lambda r: 990 < r[1] <= 995), ({"first_row": 998}, lambda r: r[1] >= 998), ({"files": ["file:/none.bin"]}, lambda r: False),
        ({"rows": []}, lambda r: False), ({"rows": [1, 2, 3], "first_row": 2, "last_row": 2}, lambda r: r[1] == 2), ({"last_row": -1}, lambda r: False), ({}, lambda r: True),
    ):
        df = packed.scan(spark, path, 2, 1, count_bytes="true", **options)
        left = [r for r in want if rule(r)]
        assert rows(df) == left and (df.agg(F.sum("bytes")).head()[0] or 0) == 12 * len(left)


def test_filters_of_one_relation_do_not_mix(spark, shards):
    df = packed.scan(spark, shards[0], 2, 1)
    both = df.filter("row = 1").unionByName(df.filter("row = 900"))
    assert [r["row"] for r in both.orderBy("row").collect()] == [1, 1, 1, 900] and df.count() == 1040


def test_only_asked_bytes_are_read(shards, monkeypatch):
    path, _ = shards
    read, opened = [], []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            read.append((at, n))
            return self.f.read_at(n, at)

    class Files:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def open_input_file(self, p):
            opened.append(p)
            return Counted(self.files.open_input_file(p))

    store = packed.Layout.store
    monkeypatch.setattr(packed.Layout, "store", lambda self: (Files(store(self)[0]), *store(self)[1:]))
    reader = packed.PackedReader(packed.Layout(path, 2, 1, files=frozenset([f"file:{path}/10.bin"]), rows=(2, 700, 701, 950), first_row=1, last_row=900))
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.column(1).to_pylist() for b in batches] == [[2], [700, 701]]
    assert opened == [f"{path}/10.bin"] and read == [(24, 12), (8400, 24)]


def test_lookup_of_a_table_of_places(spark, shards):
    path, want = shards
    places = [(f"file:{path}/10.bin", k) for k in range(0, 1000, 7)] + [(f"file:{path}/9.bin", k) for k in (0, 1, 2, 36, 36)] + [(None, 1), (f"file:{path}/x.bin", None)]
    d = spark.createDataFrame(places, "file string, row long").repartition(3)
    got = packed.lookup(d, path, 2, 1, count_bytes=True)
    keys = {(os.path.basename(f), r) for f, r in places if f and r is not None}
    assert rows(got) == [r for r in want if r[:2] in keys]
    assert got.agg(F.sum("bytes")).head()[0] == 12 * len(keys)
    with pytest.raises(PySparkException, match="ends before record"):
        packed.lookup(spark.createDataFrame([(f"file:{path}/x.bin", 3)], "file string, row long"), path, 2, 1).collect()
    with pytest.raises(PySparkException, match="is not below"):
        packed.lookup(spark.createDataFrame([("file:/etc/x.bin", 3)], "file string, row long"), path, 2, 1).collect()
    assert rows(packed.record(spark, path, 2, 1, f"file:{path}/9.bin", 36)) == [r for r in want if r[:2] == ("9.bin", 36)]
    assert rows(packed.record(spark, path, 2, 1, f"file:{path}/9.bin", 37)) == []


def test_faults(spark, tmp_path, shards):
    write(tmp_path / "odd", "1", 5)
    with open(tmp_path / "odd" / "2.bin", "wb") as f:
        f.write(b"12345")
    with pytest.raises(PySparkException, match="not whole records"):
        packed.scan(spark, f"{tmp_path}/odd", 2, 1).collect()
    assert packed.scan(spark, f"{tmp_path}/odd", 2, 1, files=[f"file:{tmp_path}/odd/1.bin"]).count() == 5
    assert packed.scan(spark, f"{tmp_path}/none", 2, 1).count() == 0
    assert packed.scan(spark, f"{shards[0]}/9.bin", 2, 1).count() == 37
    for options in ({"inputs": 0, "outputs": 1}, {"inputs": 1, "outputs": 1, "read_bytes": 0}, {"inputs": 1, "outputs": 1, "batch_bytes": -5}):
        with pytest.raises(PySparkException, match="records need|positive"):
            packed.scan(spark, shards[0], **options).collect()


def started(df, out, check):
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()


def test_streams_are_bounded_and_restart_where_they_stopped(spark, tmp_path, shards):
    path, want = shards
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    source = lambda: packed.stream(spark, path, 2, 1, batch_bytes=3600, split_bytes=1200)
    query = started(source(), out, check)
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert sum(sizes) == len(want) and max(sizes) <= 300 and len(sizes) >= 4
    assert rows(spark.read.parquet(out)) == want
    more = write(path, "xy", 40, first=7000)
    query = started(source(), out, check)
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(out)) == sorted(want + [("xy.bin", k, *map(float, v)) for k, v in enumerate(more)])
    query = started(source(), out, check)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(out).count() == len(want) + 40


def test_a_planned_batch_that_did_not_commit_runs_again_unchanged(spark, tmp_path, shards):
    path, want = shards
    check = f"{tmp_path}/check"
    fail = {"at": 2}
    seen: dict[int, list] = {}

    def sink(df, batch):
        got = rows(df)
        if batch == fail["at"]:
            fail["at"] = -1
            raise ValueError("stopped on purpose")
        assert batch not in seen or seen[batch] == got
        seen[batch] = got

    def run():
        return packed.stream(spark, path, 2, 1, batch_bytes=2400).writeStream.foreachBatch(sink).option("checkpointLocation", check).start()

    query = run()
    with pytest.raises(PySparkException):
        query.processAllAvailable()
    query = run()
    query.processAllAvailable()
    query.stop()
    assert sorted(r for x in seen.values() for r in x) == want and max(map(len, seen.values())) <= 200


def test_offsets_in_order(shards):
    path, _ = shards
    s = packed.PackedStream(packed.Layout(path, 2, 1, batch_bytes=5000))
    at, total, steps = s.initialOffset(), 0, 0
    while (end := s.latestOffset()) != at:
        runs = [r for p in s.partitions(at, end) for r in p.runs]
        total, at, steps = total + sum(n for _, n in runs), end, steps + 1
        assert sum(n for _, n in runs) * 12 <= 5000
    assert total == 1040 and steps == 3 and s.partitions(at, at) == []
