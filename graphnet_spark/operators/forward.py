"""Forward passes: every neuron is an aggregate over its inbound edges.

Three plans with one meaning: relational (a join and an aggregate per level), arrays (higher-order functions, for layers
of plain neurons) and vectorised (numpy over record batches). Records are independent, so partitions are the
parallelism and only a graph of bounded size is handed to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectorized
from ..functions.activations import by_code, CODES, forward_sql, limit_sql
from ..plans.storage import stored
from .network import CONDITION, NEGATIVE, Network

#: Records that are evaluated at once.
RECORDS = 2048
#: Kinds of neurons whose value is an aggregate other than a sum.
AGGREGATES = ("MINIMUM", "MAXIMUM", "IF", "HYPOT", "HYPOTv2", "MEAN")


def condition_holds() -> Column:
    """Whether v of the conditions adds up to more than 0, in a groupBy over a neuron's edges.

    The sum of what rounding leaves has a sign that depends on the order of rows. Whole numbers of 2^-20, and of 2^-70 for the rest,
    add up exactly; only numbers that are too large for this are added as they are.
    """
    v = F.when((F.col("role") == CONDITION) & (F.col("code") == CODES["IF"]), F.col("v"))
    fixed = F.when(F.abs(v) < 1e12, v)
    coarse = F.rint(fixed * 2.0**20)
    fine = F.rint((fixed - coarse * 2.0**-20) * 2.0**70)
    whole = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")).cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(F.when(F.abs(v) >= 1e12, v)), F.lit(0.0)) + (whole(coarse) * 2.0**-20 + whole(fine) * 2.0**-70) > 0


def node_value() -> Column:
    """The value of a neuron from v = activation * weight, role, bias and code, in a groupBy over its edges."""
    v, bias = F.col("v"), F.first("bias")
    part = lambda test: F.coalesce(F.sum(F.when(test, v)), F.lit(0.0))
    total = F.coalesce(F.sum("v"), F.lit(0.0))
    code = F.first("code")
    plain = F.struct((bias + total).alias("x"), code.alias("code"))
    special = (
        F.when(code == CODES["MINIMUM"], F.coalesce(F.min("v"), F.lit(0.0)) + bias)
        .when(code == CODES["MAXIMUM"], F.coalesce(F.max("v"), F.lit(0.0)) + bias)
        .when(code == CODES["IF"], F.when(condition_holds(), part(~F.col("role").isin(CONDITION, NEGATIVE))).otherwise(part(F.col("role") == NEGATIVE)) + bias)
        .when(code == CODES["HYPOT"], F.sqrt(F.coalesce(F.sum(v * v), F.lit(0.0))) + bias)
        .when(code == CODES["HYPOTv2"], F.sqrt(F.coalesce(F.sum((F.col("bias") + v) * (F.col("bias") + v)), F.lit(0.0))))
        .when(code == CODES["MEAN"], F.coalesce(F.avg("v"), F.lit(0.0)) + bias)
    )
    return F.struct(plain.alias("plain"), special.alias("special"))


def aggregate_nodes(edges: DataFrame, keys: list[str], names: set[str] | None = None, trace: bool = False) -> DataFrame:
    """keys and value, from rows (keys, v, role, bias, code): v is null where a neuron has no edge. names: activations that occur.

    With trace, rows have ord, the edge's place among the neuron's, and hint and info are added: the sum before the activation
    (the value of an aggregate neuron), and the winning edge of MINIMUM and MAXIMUM, 1 or 0 for the branch of IF, else 0.
    """
    info = []
    if trace:
        info = [F.min(F.struct("v", "ord")).alias("_low"), F.min(F.struct((-F.col("v")).alias("v"), "ord")).alias("_high"), condition_holds().cast("int").alias("_yes")]
    g = edges.groupBy(*keys).agg(node_value().alias("n"), *info)
    g = g.select(*keys, "n.special", F.col("n.plain.x").alias("x"), F.col("n.plain.code").alias("code"), *(["_low", "_high", "_yes"] if trace else []))
    g = g.withColumn("raw", F.coalesce("special", F.expr(by_code("code", lambda name: forward_sql(name, "x"), names))))
    value = F.expr(by_code("code", lambda name: limit_sql(name, "raw"), names))
    if not trace:
        return g.select(*keys, value.alias("value"))
    g = g.withColumn("value", value)
    won = F.when(F.col("code") == CODES["MINIMUM"], F.col("_low.ord")).when(F.col("code") == CODES["MAXIMUM"], F.col("_high.ord")).when(F.col("code") == CODES["IF"], F.col("_yes"))
    return g.select(*keys, "value", F.when(F.col("special").isNull(), F.col("x")).otherwise(F.col("value")).alias("hint"), F.coalesce(won, F.lit(0)).alias("info"))


def relational(net: Network, records: DataFrame, key: str, inputs: str) -> DataFrame:
    """key, idx and value of every output."""
    return traced(net, records, key, inputs, trace=False).filter(F.col("idx") >= net.size - net.outputs)


def traced(net: Network, records: DataFrame, key: str, inputs: str, trace: bool = True) -> DataFrame:
    """key, idx and value of every node, with hint and info if traced (see aggregate_nodes; an input's hint is its value).

    One shuffle by record and neuron per level; the graph is broadcast. Levels but the last are written, so that none is worked
    out again by those above it.
    """
    neurons, synapses = net.tables(records.sparkSession)
    neurons = neurons.withColumn("code", F.element_at(F.create_map(*(F.lit(x) for name, k in CODES.items() for x in (name, k))), F.col("squash")))
    extra = [F.col("value").alias("hint"), F.lit(0).alias("info")] if trace else []
    known = records.select(key, F.posexplode(F.slice(F.col(inputs).cast("array<double>"), 1, net.inputs)).alias("idx", "value")).select(key, "idx", "value", *extra)
    levels, place = net.levels(), W.partitionBy("to_idx").orderBy("ord")
    synapses = synapses.withColumn("ord", (F.row_number().over(place) - 1).cast("int"))
    for depth, level in enumerate(levels, 1):
        names = {net.neurons[i - net.inputs].squash for i in level}
        here = neurons.filter(F.col("idx").isin(level))
        in_ = synapses.filter("from_idx < to_idx").join(here.filter("NOT constant"), F.col("to_idx") == F.col("idx")).select("from_idx", F.col("to_idx").alias("t"), "ord", "weight", "role", "bias", "code")
        rows = known.join(F.broadcast(in_), F.col("idx") == F.col("from_idx")).select(key, F.col("t").alias("idx"), (F.col("value") * F.col("weight")).alias("v"), "ord", "role", "bias", "code")
        fed = {b for a, b, _, _ in net.edges if a < b}
        alone = [i for i in level if i not in fed or net.neurons[i - net.inputs].constant]
        if alone:  # neurons without edges, and constants, have one row per record
            each = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(float(net.neurons[i - net.inputs].bias)).alias("bias"), F.lit(0 if net.neurons[i - net.inputs].constant else CODES[net.neurons[i - net.inputs].squash]).alias("code")) for i in alone))
            rows = rows.unionByName(records.select(key, F.explode(each).alias("e")).select(key, "e.idx", F.lit(None).cast("double").alias("v"), F.lit(0).alias("ord"), F.lit(0).alias("role"), "e.bias", "e.code"))
        found = aggregate_nodes(rows, [key, "idx"], names, trace)
        known = known.unionByName(found if depth == len(levels) else stored(found))
    return known


def arrays(net: Network, inputs: Column) -> Column:
    """Outputs as an array, one higher-order expression per level; for plain neurons whose edges come from the level before."""
    inbound, values = net.inbound(), inputs.cast("array<double>")
    before = list(range(net.inputs))
    for level in net.levels():
        place = {idx: k for k, idx in enumerate(before)}
        names = {net.neurons[i - net.inputs].squash for i in level}
        if len(names) > 1 or names & set(AGGREGATES):
            raise ValueError("the arrays plan takes layers of one plain activation")
        sums = []
        for i in level:
            weights = [0.0] * len(before)
            for source, weight, _ in inbound.get(i, ()):
                if source not in place:
                    raise ValueError("the arrays plan takes edges from the layer before only")
                weights[place[source]] += weight
            products = F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b)
            sums.append(F.aggregate(products, F.lit(float(net.neurons[i - net.inputs].bias)), lambda a, b: a + b))
        values, before = transformed(names.pop(), F.array(*sums)), level
    return values


def transformed(name: str, sums: Column) -> Column:
    return F.transform(sums, lambda v: _limited(name, v))


def _limited(name: str, v: Column) -> Column:
    simple = {"IDENTITY": lambda x: x, "TANH": F.tanh, "LOGISTIC": lambda x: 1 / (1 + F.exp(-x)), "RELU": lambda x: F.when(x > 0, x).otherwise(0.0)}
    if name not in simple:
        raise ValueError(f"the arrays plan has no {name}")
    low, high = vectorized.bounds(name)
    return F.least(F.greatest(simple[name](v), F.lit(low)), F.lit(high))


def prepared(net: Network) -> list[tuple]:
    """Groups of neurons of one level and kind: (activation, neurons, biases, edges of each), in evaluation order.

    Edges of a neuron are (sources, weights, roles); those from nodes that come later read 0 and are left out of sums.
    """
    inbound, out = net.inbound(), []
    for level in net.levels():
        groups: dict[str, list[int]] = {}
        for idx in level:
            n = net.neurons[idx - net.inputs]
            groups.setdefault("" if n.constant else n.squash, []).append(idx)
        for name, own in groups.items():
            edges = []
            for idx in own:
                e = inbound.get(idx, [])
                edges.append((np.array([x[0] for x in e], int), np.array([x[1] if x[0] < idx else 0.0 for x in e]), np.array([x[2] for x in e], int)))
            out.append((name, np.array(own), np.array([[float(net.neurons[i - net.inputs].bias)] for i in own]), edges))
    return out


def evaluate(net: Network, x: np.ndarray, plan: list[tuple] | None = None) -> np.ndarray:
    """Values of all nodes (records, nodes) for inputs (records, inputs); missing inputs are 0.

    Nodes are rows while they are worked out, so that a neuron reads and writes whole vectors, and the neurons of a level and
    kind are activated at once.
    """
    values = np.zeros((net.size, len(x)))
    width = min(net.inputs, x.shape[1])
    values[:width] = x[:, :width].T
    for name, own, bias, edges in plan or prepared(net):
        raw = np.zeros((len(own), len(x)))
        if name and name not in AGGREGATES:
            for k, (src, w, _) in enumerate(edges):
                if len(src):
                    np.dot(w, values[src], out=raw[k])
            raw += bias
            raw = vectorized.apply(name, raw)
        elif name:
            for k, (src, w, role) in enumerate(edges):
                raw[k] = aggregated(name, values[src] * w[:, None], role, bias[k, 0])
        else:
            raw += bias
        values[own] = vectorized.limit(name or "IDENTITY", raw)
    return values.T


def aggregated(name: str, v: np.ndarray, role: np.ndarray, bias: float) -> np.ndarray:
    """The value of an aggregate neuron from v (edges, records)."""
    if name == "HYPOTv2":
        return np.sqrt(((v + bias) ** 2).sum(0))
    if not len(v):
        return np.full(v.shape[1], bias)
    if name == "IF":
        yes, no = v[(role != CONDITION) & (role != NEGATIVE)].sum(0), v[role == NEGATIVE].sum(0)
        return np.where(v[role == CONDITION].sum(0) > 0, yes, no) + bias
    return {"MINIMUM": lambda: v.min(0), "MAXIMUM": lambda: v.max(0), "MEAN": lambda: v.mean(0), "HYPOT": lambda: np.sqrt((v * v).sum(0))}[name]() + bias


def vectorised(net: Network, records: DataFrame, inputs: str, output: str = "outputs") -> DataFrame:
    """records with an array column of outputs. Whole batches go through numpy; the graph travels with the task."""
    schema = records.withColumn(output, F.array().cast("array<double>")).schema
    at, names = records.columns.index(inputs), [*records.columns, output]
    width = net.outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = prepared(net)
        for batch in batches:
            lists = batch.column(at)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(sizes) and (sizes == sizes[0]).all():
                x = flat.reshape(len(sizes), -1)
            else:
                x = np.zeros((len(sizes), int(sizes.max(initial=0))))
                for r, row in enumerate(lists.to_pylist()):
                    x[r, : len(row or ())] = row or ()
            y = np.concatenate([evaluate(net, x[at_ : at_ + RECORDS], plan)[:, net.size - width :] for at_ in range(0, len(x), RECORDS)]) if len(x) else np.zeros((0, width))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=names)

    return records.mapInArrow(run, schema)


def trace_winners(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, low and high: which edge (ord) holds the least and the largest v, the first among equals."""
    return edges.groupBy(*keys).agg(F.min(F.struct("v", "ord"))["ord"].alias("low"), F.min(F.struct((-F.col("v")).alias("n"), "ord"))["ord"].alias("high"))
