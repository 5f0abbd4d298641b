"""Training accumulators as keyed state of a stream, driven by commands in the stream.

A command row is (net, seq, op, kind, id, synapses, neurons, sums). `init` makes a net's accumulators, as many zeros as its numbers of
synapses and neurons say; `add` adds sums to one of them (ignored beyond the size, or where the count is not above 0);
`read` gives one (zeros beyond the size), `read_all` all of a kind, `sizes` the two numbers; `reset` sets sums to 0 and keeps
sizes, `free` drops both. Commands of a net take effect in the order of seq, which must rise from batch to batch.

A net's accumulators are dealt over several keys by id, so that one net's rows go to many tasks. Of a batch's adds between two
other commands, a key sums each id's first and touches its state once. Adds of one seq and id are summed as they are read,
so that a key holds no row of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.accumulate import BIAS_SUMS, WEIGHT_SUMS

COMMANDS = "net LONG, seq LONG, op STRING, kind STRING, id LONG, synapses LONG, neurons LONG, sums ARRAY<DOUBLE>"
ANSWERS = "net LONG, seq LONG, op STRING, kind STRING, id LONG, sums ARRAY<DOUBLE>"
#: Sums of an accumulator of either kind; the first is the count.
FIELDS = {"synapse": len(WEIGHT_SUMS), "neuron": len(BIAS_SUMS)}
PARTS = 16
#: Adds that wait at least before they are summed with those before.
HELD = 1 << 14


class Adds(NamedTuple):
    """Adds in the order of seq: their ids and sums (adds, fields)."""

    seq: np.ndarray
    ids: np.ndarray
    sums: np.ndarray


def folded(seq: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> Adds:
    """Adds of the same seq and id as one."""
    if not len(seq):
        return Adds(seq, ids, sums)
    order = np.lexsort((ids, seq))
    seq, ids, sums = seq[order], ids[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (ids[1:] != ids[:-1])]))
    return Adds(seq[first], ids[first], np.add.reduceat(sums, first))


def gathered(rows: Iterator[pd.DataFrame], width: int) -> tuple[Adds, pd.DataFrame]:
    """The adds that count and the other commands of a key's rows, which are read piece by piece; adds of one seq and id are summed at once."""
    total, waiting, others = Adds(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width))), [], []
    size = 0

    def settle() -> Adds:
        return folded(*(np.concatenate(x) for x in zip(total, *waiting, strict=True)))

    for piece in rows:
        is_add = (piece["op"] == "add").to_numpy()
        others.append(piece[~is_add].drop(columns="sums"))
        own = piece[is_add]
        own = own[np.array([s is not None and len(s) == width and s[0] > 0 for s in own["sums"]], bool)]
        if len(own):
            waiting.append(folded(own["seq"].to_numpy(np.int64), own["id"].to_numpy(np.int64), np.stack(own["sums"].to_numpy()).astype(float)))
            size += len(waiting[-1].seq)
        if size > max(len(total.seq), HELD):
            total, waiting, size = settle(), [], 0
    return settle(), pd.concat(others).sort_values("seq", kind="stable")


class Accumulators(StatefulProcessor):
    """One key's share of a net's accumulators of one kind: its size, and the sums of the ids that were added to."""

    def __init__(self, parts: int):
        self.parts = parts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "n LONG")
        self.sums = handle.getMapState("sums", "id LONG", "sums ARRAY<DOUBLE>")

    def clear(self, also_size: bool) -> None:
        self.sums.clear()
        if also_size:
            self.size.clear()

    def add(self, ids: np.ndarray, sums: np.ndarray, n: int) -> None:
        for i, more in zip(ids.tolist(), sums, strict=True):
            if 0 <= i < n:
                old = np.array(self.sums.getValue((i,))[0]) if self.sums.containsKey((i,)) else 0
                self.sums.updateValue((i,), ((old + more).tolist(),))

    def held(self, i: int, n: int, width: int) -> list[float]:
        return list(self.sums.getValue((i,))[0]) if 0 <= i < n and self.sums.containsKey((i,)) else [0.0] * width

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        net, kind, part = key
        width, out = FIELDS[kind], []
        adds, others = gathered(rows, width)
        n = self.size.get()[0] if self.size.exists() else 0
        at = 0
        for command in [*others.to_dict("records"), None]:
            # the adds up to the command, each id's summed
            end = len(adds.seq) if command is None else int(np.searchsorted(adds.seq, command["seq"], "left"))
            if end > at:
                own = folded(np.zeros(end - at, np.int64), adds.ids[at:end], adds.sums[at:end])
                self.add(own.ids, own.sums, n)
                at = end
            if command is None:
                break
            op, seq = command["op"], int(command["seq"])
            if op == "init":
                self.clear(False)
                n = max(0, int(command["synapses" if kind == "synapse" else "neurons"]))
                self.size.update((n,))
            elif op == "reset":
                self.clear(False)
            elif op == "free":
                self.clear(True)
                n = 0
            elif op == "sizes":
                out.append((net, seq, op, kind, n, None))
            elif op == "read":
                out.append((net, seq, op, kind, int(command["id"]), self.held(int(command["id"]), n, width)))
            else:
                out += [(net, seq, op, kind, i, self.held(i, n, width)) for i in range(part, n, self.parts)]
        names = ["net", "seq", "op", "kind", "id", "sums"]
        for at in range(0, len(out), 10_000):
            yield pd.DataFrame(out[at : at + 10_000], columns=names)
        if not out:
            yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(names, ("int64", "int64", "object", "object", "int64", "object"), strict=True)})

    def close(self) -> None:
        pass


def dealt(commands: DataFrame, parts: int) -> DataFrame:
    """Commands with the keys that they concern: one for add and read, one of each kind for sizes, all of a net for the others."""
    kinds = F.array(*map(F.lit, FIELDS))
    one = F.array(F.struct(F.col("kind").alias("kind"), F.pmod("id", F.lit(parts)).cast("int").alias("part")))
    every = F.flatten(F.transform(kinds, lambda k: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(k.alias("kind"), p.alias("part")))))
    of_kind = F.filter(every, lambda x: F.col("kind").isNull() | (x["kind"] == F.col("kind")))
    sizes = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.lit(0).alias("part")))
    keys = F.when(F.col("op").isin("add", "read"), one).when(F.col("op") == "sizes", sizes).when(F.col("op") == "read_all", of_kind).when(F.col("op").isin("init", "reset", "free"), every)
    known = F.when(F.col("op").isin("add", "read") & (~F.coalesce(F.col("kind"), F.lit("")).isin(*FIELDS) | F.col("id").isNull()), F.raise_error(F.concat(F.lit("a command without its kind or id: "), F.col("op")))).otherwise(keys)
    checked = F.coalesce(known, F.raise_error(F.concat(F.lit("no such command: "), F.coalesce("op", F.lit("null")))))
    return commands.withColumn("k", F.explode(checked)).select("net", F.col("k.kind").alias("kind"), F.col("k.part").alias("part"), "seq", "op", "id", "synapses", "neurons", "sums")


def answers(commands: DataFrame, parts: int = PARTS) -> DataFrame:
    """The answers of a stream of commands: net, seq and op of the command, kind, id (for sizes, the number) and sums."""
    keyed = dealt(commands, parts).groupBy("net", "kind", "part")
    return keyed.transformWithStateInPandas(Accumulators(parts), ANSWERS, "append", "none")


def use_state_store(spark) -> None:
    """State of this kind needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
