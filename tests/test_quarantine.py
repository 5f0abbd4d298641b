"""Documents that cannot be bound: rows for each fault, or an error."""

import json

import pytest
from pyspark.sql import functions as F

from graphnet_spark.operators import network


def document(ni=2, no=1, squash="TANH", sources=("input-0", "input-1"), **more):
    neurons = [{"type": "hidden", "uuid": "h", "bias": 0.5, "squash": squash}, {"type": "output", "uuid": "o", "bias": 0.0}]
    synapses = [{"fromUUID": s, "toUUID": "h", "weight": 1.0} for s in sources] + [{"fromUUID": "h", "toUUID": "o", "weight": 2.0}]
    return {"input": ni, "output": no, "neurons": neurons, "synapses": synapses} | more


def table(spark, docs):
    d = spark.createDataFrame([(k, None if x is None else json.dumps(x)) for k, x in docs.items()], "net_id long, text string")
    return d.select("net_id", F.from_json("text", network.DOCUMENT).alias("doc"))


CASES = {
    1: (document(), []), 2: (document(no=2), [("output_count", None, "1")]), 3: (document(squash="WAVE"), [("unknown_activation", 0, "WAVE")]),
    4: (document(sources=("gone", "input-2", "h", "input-01")), [("unknown_source", 0, "gone"), ("unknown_source", 1, "input-2"), ("unknown_source", 3, "input-01")]),
    5: (document(no=0, squash="x", sources=("y",)), [("output_count", None, "1"), ("unknown_activation", 0, "x"), ("unknown_source", 0, "y")]),
    6: (None, [("malformed", None, None)]), 7: ({"input": 1, "output": 0, "neurons": []}, [("malformed", None, None)]), 8: (document(ni=70_000), [("too_many_nodes", None, "70002")]),
    9: (document(synapses=[{"fromUUID": "nobody", "toUUID": "nowhere", "weight": 1.0}, {"fromUUID": "nobody", "toUUID": "input-0", "weight": 1.0}]), []),
    10: (document(synapses=[{"fromUUID": "h", "weight": 1.0}]), [("malformed", None, None)]), 11: (document(no=0, neurons=[], synapses=[]), []),
}


def test_every_fault_is_told_and_the_rest_is_bound(spark):
    docs = table(spark, {k: d for k, (d, _) in CASES.items()})
    neurons, synapses, faults = network.bind_checked(docs)
    got = {}
    for r in faults.orderBy("place").collect():
        got.setdefault(r["net_id"], []).append((r["fault"], r["place"], r["name"]))
    key = lambda x: (network.FAULTS.index(x[0]), x[1] or 0)
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: v for k, (_, v) in CASES.items() if v}
    assert {r["net_id"] for r in neurons.select("net_id").distinct().collect()} == {1, 9}
    assert {(r["net_id"], r["from_idx"], r["to_idx"]) for r in synapses.collect()} == {(1, 0, 2), (1, 1, 2), (1, 2, 3)}


def test_faults_agree_with_binding_one_document(spark):
    for k, (doc, faults) in CASES.items():
        if doc is None or "malformed" in {f for f, _, _ in faults}:
            continue
        try:
            network.bind(doc)
            assert not faults, k
        except network.NetworkError:
            assert faults, k


def test_strict_binding_ends_with_the_first_fault(spark):
    neurons, synapses, _ = network.bind_checked(table(spark, {1: CASES[1][0]}), strict=True)
    assert neurons.count() == 2 and synapses.count() == 3
    for k, message in ((2, "net 2: output_count 1"), (3, "net 3: unknown_activation WAVE"), (4, "net 4: unknown_source gone"), (5, "net 5: output_count 1")):
        with pytest.raises(Exception, match=message):
            network.bind_checked(table(spark, {1: CASES[1][0], k: CASES[k][0]}), strict=True)[1].collect()
