"""Hand-computed networks, topologies, scans and splits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphnet_spark.functions import activations as A
from graphnet_spark.functions import sqlapi, vectorized
from graphnet_spark.operators import accumulate, backprop, distribution, forward, network, predictive, topology
from graphnet_spark.operators.network import Network, NetworkError, Neuron
from graphnet_spark.sources import codecs, records


def outputs(net, rows):
    return forward.evaluate(net, np.array(rows, float))[:, net.size - net.outputs :].tolist()


def test_constant_feeds_output():
    assert outputs(Network(1, 1, [Neuron(0.75, constant=True), Neuron()], [(1, 2, 2.0, 0)]), [[999]]) == [[1.5]]


def test_two_outputs():
    got = outputs(Network(2, 2, [Neuron(0.1), Neuron(-0.2, "LOGISTIC")], [(0, 2, 1, 0), (1, 3, 1, 0)]), [[0.5, 0]])
    assert got[0] == pytest.approx([0.6, 1 / (1 + math.exp(0.2))])


IF_NET = Network(2, 1, [Neuron(0, "IF"), Neuron()], [(0, 2, 1, 1), (1, 2, 1, 3), (1, 2, -1, 2), (2, 3, 1, 0)])


def test_if_node_in_both_plans(spark):
    assert outputs(IF_NET, [[1, 3], [-1, 3]]) == [[3], [-3]]
    d = spark.createDataFrame([(0, [1.0, 3.0]), (1, [-1.0, 3.0])], "k int, x array<double>")
    assert dict(forward.relational(IF_NET, d, "k", "x").select("k", "value").collect()) == {0: 3, 1: -3}


def test_relational_equals_vectorised(spark):
    kinds = ["TANH", "MINIMUM", "MAXIMUM", "HYPOT", "HYPOTv2", "MEAN", "IF", "GELU", "SOFTSIGN"]
    neurons = [Neuron(0.1 * k, s) for k, s in enumerate(kinds)] + [Neuron(0.5, constant=True), Neuron(0.1, "LOGISTIC")]
    edges = [(i, 3 + k, 0.3 * i - 0.2 * k + 0.05, i + 1) for k in range(len(kinds)) for i in range(3)] + [(i, 13, 0.1 * i - 0.6, 0) for i in range(3, 13)]
    net = Network(3, 1, neurons, edges)
    rows = [(k, [math.sin(k), math.cos(k), k / 7]) for k in range(20)]
    d = spark.createDataFrame(rows, "k int, x array<double>")
    a = dict(forward.relational(net, d, "k", "x").select("k", "value").collect())
    b = {r["k"]: r["outputs"][0] for r in forward.vectorised(net, d, "x").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-10) for k in a)


def test_every_activation_agrees_with_numpy(spark):
    xs = [-40.0, -3.2, -1.0, -1e-12, 0.0, 0.3, 1.0, 5.9, 20.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(A.squash(a.name).alias(a.name) for a in A.ACTIVATIONS), *(A.limit(a.name).alias(f"l_{a.name}") for a in A.ACTIVATIONS))
    for r in d.collect():
        for a in A.ACTIVATIONS:
            assert r[a.name] == pytest.approx(float(vectorized.apply(a.name, np.array([r["x"]]))[0]), rel=1e-9, abs=1e-12), a.name
            assert r[f"l_{a.name}"] == pytest.approx(float(vectorized.limit(a.name, np.array([r["x"]]))[0]), rel=1e-6)


def test_odd_numbers(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in d.select(A.limit("TANH")).collect()] == [0, 1, -1]
    assert [r[0] for r in d.select(A.validate("LOGISTIC")).collect()] == [False] * 3
    assert d.select(A.squash("RELU")).collect()[0][0] == 0


def test_error_and_range(spark):
    d = spark.createDataFrame([(0.5, 1.0, 2.0, -0.5)], "a double, t double, big double, low double")
    assert d.select(F.expr(A.error_sql("IDENTITY", "a", "t", "a"))).first()[0] == 0.5
    assert d.select(A.limit("LOGISTIC", "big")).first()[0] == 1 and not d.select(A.validate("LOGISTIC", "low")).first()[0]


def test_document_binding(spark):
    doc = '{"input":1,"output":1,"neurons":[{"type":"output","uuid":"o","bias":0.0,"squash":"%s"}],"synapses":[{"fromUUID":"%s","toUUID":"o","weight":1.0}]}'
    assert network.bind(network.parse_document(doc % ("ReLU", "input-0"))).neurons[0].squash == "RELU"
    for bad in (doc % ("NOPE", "input-0"), doc % ("RELU", "nobody"), doc.replace('"output":1', '"output":2') % ("RELU", "input-0")):
        with pytest.raises(NetworkError):
            network.bind(network.parse_document(bad))
    with pytest.raises(NetworkError):
        network.parse_document("{}")


def graph(spark, rows, n, ni, no=1, biases=None, squash=None):
    e = spark.createDataFrame([(0, k, a, b, r) for k, (a, b, r) in enumerate(rows)], "topology_id long, pos int, from_idx int, to_idx int, role int")
    s = spark.createDataFrame([(0, n, ni, no)], "topology_id long, n int, ni int, no int")
    v = spark.createDataFrame([(0, i, False, (squash or ["TANH"] * n)[i], (biases or [0.0] * n)[i]) for i in range(n)], "topology_id long, idx int, constant boolean, squash string, bias double")
    return e, s, v


@pytest.mark.parametrize(("rows", "want"), [([(0, 2), (1, 2), (2, 3)], (0, 0)), ([(2, 2)], (1, 0)), ([(0, 1), (3, 2)], (2, 1)), ([(1, 2), (0, 2)], (3, 1)), ([(0, 3), (0, 2)], (4, 1)), ([(0, 2), (0, 2)], (5, 1))])
def test_order_codes(spark, rows, want):
    e, _, _ = graph(spark, [(a, b, 0) for a, b in rows], 4, 2)
    r = topology.validate_order(e).first()
    assert (r["code"], r["pos"]) == want


@pytest.mark.parametrize(("rows", "n", "ni", "want"), [([(0, 2), (1, 2), (2, 3)], 4, 2, 0), ([(0, 2), (1, 3), (2, 3), (3, 2)], 4, 2, 1), ([(0, 2), (2, 2)], 3, 2, 1), ([(0, 3), (1, 4), (2, 5), (3, 4), (4, 5), (5, 3)], 7, 3, 1)])
def test_cycles(spark, rows, n, ni, want):
    e, s, _ = graph(spark, [(a, b, 0) for a, b in rows], n, ni)
    assert topology.cycles(e, s).first()["cyclic"] == want


def test_order_and_free_slots(spark):
    e, s, v = graph(spark, [(0, 2, 0), (1, 2, 0), (2, 3, 0)], 4, 2)
    assert [r["idx"] for r in topology.reverse_order(e, s).orderBy("place").collect()] == [3, 2]
    assert {(r["from_idx"], r["to_idx"]) for r in topology.free_slots(v, s, e).collect()} == {(0, 3), (1, 3)}


def test_structure(spark):
    e, s, v = graph(spark, [(0, 2, 0), (1, 2, 0), (2, 3, 0)], 4, 2, biases=[0.0, 0.0, 0.5, -0.3])
    assert topology.validate_structure(v, e, s).first()["code"] == 0
    e, s, v = graph(spark, [(0, 3, 1), (1, 3, 3), (2, 3, 2), (3, 4, 0)], 5, 3, squash=["TANH"] * 3 + ["IF", "TANH"])
    assert topology.validate_structure(v, e, s).first()["code"] == 0
    e, s, v = graph(spark, [(0, 3, 0), (1, 3, 3), (2, 3, 2), (3, 4, 0)], 5, 3, squash=["TANH"] * 3 + ["IF", "TANH"])
    assert tuple(topology.validate_structure(v, e, s).select("code", "idx").first()) == (7, 3)


@pytest.mark.parametrize(("values", "want"), [([1, -2, 3, -4, 0.5, -1.5], (12, 6, 4, 3)), ([7], (7, 1, 7, 0)), ([2, -2], (4, 2, 2, 2))])
def test_magnitudes(spark, values, want):
    d = spark.createDataFrame([(0, float(v)) for v in values], "k int, v double")
    assert tuple(accumulate.magnitude_stats(d, ["k"], "v").select("total", "count", "largest", "second").first()) == want


@pytest.mark.parametrize(("error", "act", "safe", "weight", "want"), [(10, [1, 2], [1, 1], [1, 1], [2, 8]), (10, [1, 1], [1, 0], [1, 1], [10, 0]), (12, [0, 0, 0], [1, 1, 1], [1, 2, 3], [12 / 14, 48 / 14, 108 / 14]), (9, [0, 0, 0], [1, 1, 1], [0, 0, 0], [3, 3, 3]), (float("inf"), [1, 1], [1, 1], [1, 1], [0, 0])])
def test_elastic_split(spark, error, act, safe, weight, want):
    d = spark.createDataFrame([(0, k, float(a), float(s), float(w), float(error)) for k, (a, s, w) in enumerate(zip(act, safe, weight, strict=True))], "neuron int, ord int, activation double, safe double, weight double, error double")
    got = [r["share"] for r in distribution.elastic_split(d, "neuron").orderBy("ord").collect()]
    assert got == pytest.approx(want)


def test_predictive(spark):
    net = Network(1, 1, [Neuron(0.5)], [(0, 1, 2.0, 0)])
    d = spark.createDataFrame([(0, [3.0])], "k int, x array<double>")
    r = predictive.infer(net, d, "k", "x", None, steps=0).first()
    assert r["predictions"] == [6.5] and r["errors"] == [0]
    g = spark.createDataFrame([("IDENTITY", 6.5, 0.5, 3.0)], "squash string, pre double, error double, source double")
    assert tuple(predictive.gradients(g, 0.01).select("bias_delta", "weight_delta").first()) == pytest.approx((0.005, 0.015))


def test_settling_lowers_energy(spark):
    net = Network(2, 1, [Neuron(0, "TANH"), Neuron()], [(0, 2, 0.5, 0), (1, 2, 0.3, 0), (2, 3, 1.0, 0)])
    d = spark.createDataFrame([(0, [0.5, -0.3], [0.9])], "k int, x array<double>, t array<double>")
    first, last = (predictive.infer(net, d, "k", "x", "t", steps=s).first() for s in (0, 50))
    assert 0 <= last["energy"] < first["energy"]


def test_backward_moves_towards_the_target(spark):
    net = Network(1, 1, [Neuron()], [(0, 1, 0.5, 0)])
    d = spark.createDataFrame([(k, [1.0], [2.0]) for k in range(3)], "id int, x array<double>, t array<double>")
    got = {(r["kind"], r["id"]): r for r in backprop.backward(net, d, "id", "x", "t").collect()}
    assert got["edge", 0]["count"] == 3 and got["edge", 0]["pos_act"] == 3 and got["edge", 0]["pos_adj"] == pytest.approx(6)
    assert got["neuron", 1]["pos_act"] == pytest.approx(4.5)


@pytest.mark.parametrize("normalise", [True, False])
def test_backward_scales_by_the_root_of_the_paths_and_asks_over_dead_weights(spark, normalise):
    net = Network(1, 2, [Neuron(0, "TANH"), Neuron(), Neuron()], [(0, 1, 1.0, 0), (1, 2, 0.5, 0), (1, 3, 0.0, 0)])
    d = spark.createDataFrame([(0, [0.5], [0.3, 0.01]), (1, [0.5], [float(np.tanh(0.5)) / 2, 0.0])], "id int, x array<double>, t array<double>")
    sums, outcomes = backprop.propagate(net, d, "id", "x", "t", normalise=normalise)
    got, h = {(r["id"], r["idx"]): r for r in outcomes.collect()}, np.tanh(0.5)
    want = h + ((0.3 / 0.5 - h) + (1 - h)) / (np.sqrt(2) if normalise else 1)
    assert got[0, 1]["target"] == pytest.approx(min(1, want)) and got[0, 1]["status"] == "standard"
    assert (1, 1) not in got and got[1, 2]["status"] == got[1, 3]["status"] == "no change"
    edges = {r["id"]: r["count"] for r in sums.filter("kind = 'edge'").groupBy("id").agg(F.sum("count").alias("count")).collect()}
    assert edges == {0: 1, 1: 1, 2: 1}


def test_backward_leaves_special_neurons_and_blocked_links_to_the_caller(spark):
    d = spark.createDataFrame([(0, [0.5, 0.2], [0.9])], "id int, x array<double>, t array<double>")
    sums, outcomes = backprop.propagate(Network(2, 1, [Neuron(0, "MAXIMUM")], [(0, 2, 1.0, 0), (1, 2, 1.0, 0)]), d, "id", "x", "t")
    assert [tuple(r) for r in outcomes.collect()] == [(0, 2, 0.9, "special")] and not sums.filter("kind = 'edge'").count()
    sums, outcomes = backprop.propagate(Network(1, 1, [Neuron()], [(0, 1, 1.0, 0), (1, 1, 9.0, 0)]), d, "id", "x", "t")
    assert [r["status"] for r in outcomes.collect()] == ["standard"]
    assert [(r["id"], r["pos_adj"]) for r in sums.filter("kind = 'edge'").collect()] == [(0, pytest.approx(0.9))]


def test_shards(spark, tmp_path):
    np.array([1, 10], "<f4").tofile(tmp_path / "0.bin")
    np.array([2, 20, 3, 30], "<f4").tofile(tmp_path / "10.bin")
    np.array([4, 40], "<f4").tofile(tmp_path / "2.bin")
    (tmp_path / "readme.txt").write_text("no")
    files = records.shards(spark, str(tmp_path))
    assert [r["number"] for r in records.in_order(files).select("number").collect()] == [0, 2, 10]
    assert sorted((r["inputs"][0], r["outputs"][0]) for r in records.read(spark, str(tmp_path), 1, 1).collect()) == [(1, 10), (2, 20), (3, 30), (4, 40)]
    assert records.count(spark, str(tmp_path), 1, 1).first()[0] == 4
    assert records.bad_shards(files, 12).count() == 2 + 1
    assert records.count(spark, str(tmp_path / "none"), 1, 1).first()[0] == 0
    with pytest.raises(records.RecordError):
        records.check(0, 1)
    with pytest.raises(Exception, match="whole records"):
        records.read(spark, str(tmp_path), 2, 1).collect()


def test_buffer_rule():
    assert records.buffer_bytes(8) == 2 << 20 and records.buffer_bytes(1 << 27) == 1 << 27


def test_packed_networks():
    net = Network(2, 1, [Neuron(0.25, "TANH"), Neuron(0.5, constant=True), Neuron(-1.5)], [(0, 2, 1.5, 0), (1, 2, -0.5, 2), (2, 4, 2.0, 0), (3, 4, 1.0, 0)])
    raw = codecs.network_to_bytes(net)
    assert codecs.network_from_bytes(raw, 1) == net
    for cut in (4, 20, len(raw) - 1):
        with pytest.raises(NetworkError):
            codecs.network_from_bytes(raw[:cut], 1)
    engine = codecs.struct.pack("<IIIIff", 1, 1, 2, 7, 0.5, 0.25) + np.array([(0.5, 0, 0, 1)], codecs.ENGINE_NEURON).tobytes() + np.array([(0, 2.0)], codecs.ENGINE_EDGE).tobytes()
    got, settings = codecs.engine_from_bytes(engine)
    assert got == Network(1, 1, [Neuron(0.5)], [(0, 1, 2.0, 0)]) and settings == {"steps": 7, "rate": 0.5, "threshold": 0.25}


def test_sql_functions(spark):
    assert "net_squash" in sqlapi.register(spark)
    r = spark.sql("SELECT net_squash(6, 0D) a, net_limit_range(6, 2D) b, net_validate_range(6, -0.5D) c, net_unsquash(23, 0.25D, 0D) d, net_range_high(2) e, net_squash(99, 3D) f").first()
    assert tuple(r) == (0.5, 1.0, False, 0.75, 6.0, 3.0)


def test_a_condition_of_rounding_errors_does_not_depend_on_the_order(spark):
    parts = (0.03400000000000001, -0.030000000000000006, -0.004000000000000001)
    orders = list(itertools.permutations(parts)) + [(1e13, -1e13), (1e13, -1e13, 1e-9), (float("inf"), 1.0)]
    rows = [(k, v, 1, 0.5) for k, values in enumerate(orders) for v in values] + [(k, 7.0, 0, 0.5) for k in range(len(orders))]
    d = spark.createDataFrame(rows, "neuron long, v double, role int, bias double").coalesce(1).withColumns({"code": F.lit(A.CODES["IF"]), "ord": F.lit(0)})
    got = {r["neuron"]: r["info"] for r in forward.aggregate_nodes(d, ["neuron"], trace=True).collect()}
    assert len({got[k] for k in range(6)}) == 1 and [got[6], got[7], got[8]] == [0, 1, 1]


def test_large_splits_are_dealt_over_more_tasks(spark, monkeypatch):
    d = spark.range(3000).select((F.col("id") % 97).alias("neuron"), F.col("id").alias("ord"), (F.col("id") % 7 / 7).alias("activation"), (F.col("id") % 5 - 2.0).alias("weight"), F.lit(1.0).alias("safe"), F.lit(0.5).alias("error"))
    error, safe = F.col("neuron") % 3 - 1.0, F.lit(0.5)
    splits = {"elastic": lambda: distribution.elastic_split(d, "neuron"), "fused": lambda: distribution.fused_split(d.drop("safe", "error"), "neuron", error, safe)}
    few = {k: sorted(map(tuple, f().collect())) for k, f in splits.items()}
    monkeypatch.setattr(distribution, "LINKS", 100)
    for k, f in splits.items():
        assert f().rdd.getNumPartitions() == 30 and sorted(map(tuple, f().collect())) == few[k]
