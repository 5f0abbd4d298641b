"""Stream sinks that take a batch again without counting it twice, and accumulators with commands."""

import os
import random
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphnet_spark.streaming import lifecycle, sinks


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    sums = sinks.SummedBatches(spark, f"{tmp_path}/sums", ["k"], ["x", "n"], compact_every=3)
    assert sums.total() is None
    want: dict = {}
    for batch in range(8):
        rows = [(k % 3 if k % 4 else None, float(batch + k), 1) for k in range(10)]
        df = spark.createDataFrame(rows, "k long, x double, n long").repartition(2)
        for k, x, n in rows:
            a = want.setdefault(k, [0.0, 0])
            a[0], a[1] = a[0] + x, a[1] + n
        for _ in range(2):  # every batch twice
            sums(df, batch)
        if batch == 6:
            sums(spark.createDataFrame([(1, 999.0, 999)], "k long, x double, n long"), 1)  # long merged
        assert {r["k"]: [r["x"], r["n"]] for r in sums.total().collect()} == want
    assert sorted(f for f in os.listdir(tmp_path / "sums") if "=" in f) == ["batch=6", "batch=7", "upto=5"]


def test_incomplete_folders_do_not_count(spark, tmp_path):
    sums = sinks.SummedBatches(spark, f"{tmp_path}/sums", ["k"], ["x"], compact_every=2)
    df = spark.createDataFrame([(1, 2.0)], "k long, x double")
    for batch in range(3):
        sums(df, batch)
    for left in ("upto=9", "batch=7"):
        df.write.parquet(f"{tmp_path}/sums/{left}")
        os.remove(f"{tmp_path}/sums/{left}/_SUCCESS")
    assert sums.folders() == (1, [2]) and sums.total().head()["x"] == 6.0
    sums(df, 7)
    assert sums.total().head()["x"] == 8.0


def test_a_failed_call_runs_again_and_all_is_counted_once(spark, tmp_path):
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).select(F.lit(1).alias("k"), "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k int, id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sums = sinks.SummedBatches(spark, f"{tmp_path}/sums", ["k"], ["id"], compact_every=2)
    failed = []

    def call(df, batch):
        sums(df, batch)
        if batch == 3 and not failed:
            failed.append(batch)
            raise ValueError("after the write")

    with pytest.raises(PySparkException, match="after the write"):
        sinks.for_each_batch(stream(), call, f"{tmp_path}/check")
    sinks.for_each_batch(stream(), call, f"{tmp_path}/check")
    assert failed == [3] and sums.total().head()["id"] == sum(range(60))
    again = sinks.summed_stream(stream(), ["k"], ["id"])
    assert [tuple(r) for r in again.collect()] == [(1, sum(range(60)))]


class Model:
    """The accumulators of all nets, plainly."""

    def __init__(self):
        self.nets = {}

    def run(self, rows):
        out = []
        for net, seq, op, kind, i, synapses, neurons, sums in sorted(rows, key=lambda r: r[1]):
            n, held = self.nets.get(net, ({"synapse": 0, "neuron": 0}, {}))
            if op == "init":
                n, held = {"synapse": synapses, "neuron": neurons}, {}
            elif op == "reset":
                held = {}
            elif op == "free":
                n, held = {"synapse": 0, "neuron": 0}, {}
            elif op == "add" and 0 <= i < n[kind] and sums[0] > 0:
                held[kind, i] = [a + b for a, b in zip(held.get((kind, i), [0.0] * len(sums)), sums)]
            elif op == "read":
                out.append((net, seq, op, kind, i, tuple(held.get((kind, i), [0.0] * lifecycle.FIELDS[kind]))))
            elif op == "sizes":
                out += [(net, seq, op, k, n[k], None) for k in n]
            elif op == "read_all":
                out += [(net, seq, op, k, j, tuple(held.get((k, j), [0.0] * lifecycle.FIELDS[k]))) for k in n if kind in (None, k) for j in range(n[k])]
            self.nets[net] = (n, held)
        return out


def run(spark, tmp_path, name, files):
    lifecycle.use_state_store(spark)
    for rows in files:
        spark.createDataFrame(rows, lifecycle.COMMANDS).repartition(2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(lifecycle.COMMANDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    query = lifecycle.answers(stream, parts=3).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/{name}-out").collect()
    return sorted(((r["net"], r["seq"], r["op"], r["kind"], r["id"], None if r["sums"] is None else tuple(r["sums"])) for r in got), key=str)


def commands(r, seq, count):
    out = []
    for _ in range(count):
        seq += 1
        net, op = r.choice((1, 2)), r.choices(("add", "read", "read_all", "sizes", "reset", "init", "free"), (60, 15, 6, 4, 3, 3, 1))[0]
        kind = r.choice(("synapse", "neuron"))
        size = lifecycle.FIELDS[kind]
        if op in ("add", "read"):
            sums = [float(r.choice((0, 1, 1, 2))), *(float(r.randint(-8, 8)) for _ in range(size - 1))] if op == "add" else None
            out.append((net, seq, op, kind, r.randint(-1, 9), None, None, sums))
        else:
            out.append((net, seq, op, r.choice((kind, None)) if op == "read_all" else None, None, r.randint(0, 8) if op == "init" else None, r.randint(0, 4) if op == "init" else None, None))
    return out, seq


def test_commands_against_plain_accumulators(spark, tmp_path):
    r, seq, files = random.Random(3), 0, []
    for _ in range(4):
        rows, seq = commands(r, seq, 120)
        files.append(rows)
    files[0] = [(n, -n, "init", None, None, 7, 3, None) for n in (1, 2)] + files[0]
    model = Model()
    want = [x for rows in files for x in model.run(rows)]
    assert run(spark, tmp_path, "commands", files) == sorted(want, key=str) and len(want) > 100


def test_unknown_commands_are_errors(spark, tmp_path):
    for row, message in (((1, 1, "grow", None, None, None, None, None), "no such command"), ((1, 1, "read", None, 1, None, None, None), "without its kind"), ((1, 1, "add", "synapse", None, None, None, None), "without its kind")):
        with pytest.raises(PySparkException, match=message):
            lifecycle.dealt(spark.createDataFrame([row], lifecycle.COMMANDS), 2).collect()


def test_adds_are_summed_as_they_are_read():
    names = ["seq", "op", "id", "synapses", "neurons", "sums"]
    made = []

    def pieces():
        for k in range(200):
            rows = [(5 if i % 2 else 9, "add", float(i % 6), None, None, np.array([1.0, i]) if i % 10 else np.array([0.0, 9.0])) for i in range(1000)]
            made.append(weakref.ref(frame := pd.DataFrame([*rows, (k, "read", 3.0, None, None, None)], columns=names)))
            yield frame
            del frame
            assert sum(x() is not None for x in made) <= 2  # the piece that is read and none before it

    adds, others = lifecycle.gathered(pieces(), 2)
    want = {}
    for i in range(1000):
        if i % 10:
            n, total = want.get((5 if i % 2 else 9, i % 6), (0, 0))
            want[5 if i % 2 else 9, i % 6] = (n + 200, total + 200 * i)
    assert {(s, i): tuple(x) for s, i, x in zip(adds.seq.tolist(), adds.ids.tolist(), adds.sums.tolist())} == want
    assert others["seq"].tolist() == list(range(200)) and adds.seq.tolist() == sorted(adds.seq.tolist())
