"""Many networks over many records against networks one by one."""

import random

import numpy as np

from graphnet_spark.functions.activations import ACTIVATIONS
from graphnet_spark.operators import forward, population
from graphnet_spark.operators.network import Network, Neuron


def random_net(r):
    ni, hidden, no = r.randint(1, 4), r.randint(0, 7), r.randint(1, 3)
    size = ni + hidden + no
    neurons = [Neuron(r.uniform(-1, 1), r.choice(ACTIVATIONS).name, k < hidden and r.random() < 0.1) for k in range(hidden + no)]
    edges = []
    for i in range(ni, size):
        for a in r.sample(range(i), min(i, r.randint(0, 5))):
            edges.append((a, i, r.uniform(-1.5, 1.5), r.choice((0, 0, 1, 2, 3))))
        if r.random() < 0.2:
            edges.append((r.randrange(i, size), i, 2.0, 0))  # reads what comes later
    return Network(ni, no, neurons, edges)


def tables(spark, nets):
    neurons = [(t, n.inputs + k, n.kind(n.inputs + k), float(x.bias), x.squash) for t, n in nets.items() for k, x in enumerate(n.neurons)]
    edges = [(t, k, a, b, float(w), role) for t, n in nets.items() for k, (a, b, w, role) in enumerate(n.edges)]
    shapes = [(t, n.inputs, n.outputs) for t, n in nets.items()]
    return spark.createDataFrame(neurons, "net_id long, idx int, kind string, bias double, squash string"), spark.createDataFrame(edges, "net_id long, ord int, from_idx int, to_idx int, weight double, role int"), spark.createDataFrame(shapes, "net_id long, ni int, no int")


def test_a_population_equals_its_networks(spark):
    r = random.Random(6)
    nets = {t: random_net(r) for t in range(150)}
    rows = [(r.randrange(155), k, [r.uniform(-2, 2) for _ in range(r.randint(0, 5))]) for k in range(900)]
    graphs = population.graph_rows(*tables(spark, nets))
    records = spark.createDataFrame(rows, "net_id long, key long, x array<double>")
    got = {x["key"]: x["outputs"] for x in population.scored(records, graphs, "x", salts=3).collect()}
    assert len(got) == sum(t in nets for t, _, _ in rows)
    for t, key, x in rows:
        if t in nets:
            want = forward.evaluate(nets[t], np.array([x], float).reshape(1, -1))[0, nets[t].size - nets[t].outputs :]
            assert np.allclose(got[key], want, rtol=1e-9, atol=1e-9, equal_nan=True), (t, key, got[key], want)


def test_levels(spark):
    net = Network(1, 1, [Neuron(), Neuron(), Neuron(constant=True), Neuron(), Neuron()], [(0, 1, 1.0, 0), (1, 2, 1.0, 0), (2, 3, 1.0, 0), (3, 4, 1.0, 0), (2, 4, 1.0, 0), (5, 2, 1.0, 0)])
    neurons, edges, _ = tables(spark, {7: net})
    got = {x["idx"]: x["level"] for x in population.neuron_levels(neurons, edges).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 3, 5: 1}


def test_one_graph_is_dealt_over_tasks(spark):
    net = Network(1, 1, [Neuron(0.5, "IDENTITY")], [(0, 1, 2.0, 0)])
    graphs = population.graph_rows(*tables(spark, {1: net}))
    records = spark.range(1000).selectExpr("1L AS net_id", "id", "array(CAST(id AS DOUBLE)) AS x")
    assert {tuple(x["outputs"]) for x in population.scored(records, graphs, "x").collect()} == {(2.0 * k + 0.5,) for k in range(1000)}
    assert population.scored(records.filter("id < 0"), graphs, "x").count() == 0
