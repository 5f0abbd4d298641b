"""Queries over whole tables, against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphnet_spark import catalog
from graphnet_spark.operators import topology
from graphnet_spark.sources import records


@pytest.fixture
def late_orders(spark, sf):
    """The folder of a lineitem table whose orders lie below and beyond 3000 and 2^31, and its edges by graph, in order."""
    r = random.Random(5)
    rows = [(k, n, r.randrange(10**6), r.randrange(10**6)) for k in (1, 7, 501, 2999, 3000, 4001, 5002, 5002 + 5 * 10**9, 777_007) for n in range(1, 8)]
    rows += [(123_400 + k, 1, r.randrange(10**6), r.randrange(10**6)) for k in range(90)]
    rows += [(900_009, n, 2, 4 + n) for n in range(1, 6)] + [(900_009, 6, 5, 7), (900_009, 7, 7, 5)]
    d = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")
    graphs = collections.defaultdict(list)
    for key, _, part, supp in sorted(rows):
        graphs[key % 500].append((part % 12, supp % 12))
    return sf(lineitem=d), dict(graphs)


def test_order_over_all_orders(spark, late_orders):
    path, graphs = late_orders
    want = {}
    for t, es in graphs.items():
        faults = []
        for k, (a, b) in enumerate(es):
            before = es[k - 1] if k else (-1, -1)
            faults.append(1 if a == b else 2 if a > b else 3 if a < before[0] else 4 if a == before[0] and b < before[1] else 5 if (a, b) == before else 0)
        want[t] = next(((c, k) for k, c in enumerate(faults) if c), (0, 0))
    assert {r["topology_id"]: (r["code"], r["pos"]) for r in catalog.topo_validate(spark, path).collect()} == want


def test_free_slots_over_all_orders(spark, late_orders):
    path, graphs = late_orders
    want = {(t, a, b) for t, es in graphs.items() for b in range(3, 12) for a in range(b) if b != 5 and (a, b) not in es}
    assert {tuple(r) for r in catalog.topo_free_slots(spark, path).collect()} == want


def test_cycles_over_all_orders(spark, late_orders):
    path, graphs = late_orders
    want = {}
    for t, es in graphs.items():
        m = np.zeros((12, 12), int)
        for a, b in es:
            m[a, b] = a >= 3 and b >= 3
        reach = m.copy()
        for _ in range(12):
            reach = np.minimum(1, reach + reach @ m)
        want[t] = int(np.trace(reach) > 0)
    assert dict(catalog.topo_cycles(spark, path).collect()) == want and set(want.values()) == {0, 1}


def test_reverse_order_over_all_orders(spark, late_orders):
    path, graphs = late_orders
    want = set()
    for t, es in graphs.items():
        last = {(a, b): pos for pos, (a, b) in enumerate(es) if a >= 3 and b >= 3 and a != b and (a < b or t % 2 == 0)}
        waiting = {i: sum(a == i for a, _ in last) for i in range(3, 12)}
        queue = [i for i in waiting if not waiting[i]]
        for i in queue:
            for a, _ in sorted((e for e in last if e[1] == i), key=last.get):
                waiting[a] -= 1
                if not waiting[a]:
                    queue.append(a)
        queue += [i for i in waiting if i not in queue]
        want |= {(t, place, i) for place, i in enumerate(queue)}
    assert {tuple(r) for r in catalog.topo_reverse_order(spark, path).collect()} == want


def test_levels_over_all_orders(spark, late_orders):
    path, graphs = late_orders
    want = set()
    for t, es in graphs.items():
        level = [0] * 12
        for b in range(3, 12):
            level[b] = 1 + max((level[a] for a in range(b) if (a, b) in es), default=0)
            want.add((t, b, level[b]))
    assert {tuple(r) for r in catalog.topo_levels(spark, path).collect()} == want


def test_repeated_edges_keep_the_order(spark):
    s = spark.createDataFrame([(0, 6, 1, 1)], "topology_id long, n int, ni int, no int")
    once = [(1, 5), (3, 5), (2, 5), (1, 4), (0, 1)]
    for es in (once, once * 40):
        e = spark.createDataFrame([(0, k, a, b) for k, (a, b) in enumerate(es)], "topology_id long, pos int, from_idx int, to_idx int")
        assert [r["idx"] for r in topology.reverse_order(e, s).orderBy("place").collect()] == [4, 5, 1, 3, 2]


def test_large_shards_are_written_in_bounded_files(spark, tmp_path):
    d = spark.range(5000).select((F.col("id") % 2).alias("shard"), (4999 - F.col("id")).alias("row"), F.array(F.col("id"), -F.col("id")).alias("i"), F.array(F.lit(0.5)).alias("o"))
    records.write(d, str(tmp_path / "s"), "i", "o", "shard", file_bytes=1200)
    files = records.in_order(records.shards(spark, str(tmp_path / "s"))).collect()
    assert all(0 < r["length"] <= 1200 and r["length"] % 12 == 0 for r in files) and len(files) >= 50
    got = np.concatenate([np.frombuffer(r["content"], "<f4").reshape(-1, 3) for r in files])
    want = [k for s in (0, 1) for k in range(4999, -1, -1) if k % 2 == s]
    assert got.tolist() == [[k, -k, 0.5] for k in want]
    assert not [p for p in (tmp_path / "s").iterdir() if p.suffix == ".part"]
    with pytest.raises(records.RecordError):
        records.write(d, str(tmp_path / "s"), "i", "o", "shard")


def test_rows_that_are_no_records(spark, tmp_path):
    for k, i in enumerate(("array(1.0)", "if(id = 3, array(1.0), array(1.0, 2.0))", "if(id = 3, NULL, array(1.0))")):
        d = spark.range(5).selectExpr(f"CAST({'-1' if not k else '0'} AS INT) AS shard", "id AS row", f"{i} AS i", "array(2.0) AS o")
        with pytest.raises(Exception, match="records"):
            records.write(d, str(tmp_path / str(k)), "i", "o", "shard")
        assert records.count(spark, str(tmp_path / str(k)), 1, 1).first()[0] == 0


def test_errors_over_slopes_of_zero_are_at_their_limit(spark, sf):
    """Where a smooth slope is 0 or too weak, the raw error over it is beyond any bound, on the side that SQL's quotient has."""
    d = spark.createDataFrame([(k, v) for k, v in enumerate([245.0] * 13 + [745.0] * 13 + [1300.0] * 13)], "event_id long, value double")
    for r in catalog.value_error(spark, sf(events=d)).collect():
        t = (r["event_id"] % 13 - 6) / 6
        want = 100.0 * ((t > 0) - (t < 0))
        if r["event_id"] < 13:
            assert (r["cosine"], r["cube"], r["stdinverse"]) == (-want + 0.0, want, want)
        else:
            assert r["tanh"] == (0.0 if t == 1 else -100.0)
