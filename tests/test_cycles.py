"""Cycles in many graphs at once, against depth-first search, and the rounds that long chains need."""

import random

from graphnet_spark.operators import topology

EDGES = "topology_id long, pos int, from_idx int, to_idx int, role int"


def has_cycle(es, n, ni):
    into = {k: [] for k in range(ni, n)}
    for a, b in es:
        if a >= ni and ni <= b < n and a < n:
            into[a].append(b)
    state = dict.fromkeys(into, 0)
    for root in into:
        stack = [(root, iter(into[root]))] if not state[root] else []
        state[root] = state[root] or 1
        while stack:
            node, rest = stack[-1]
            for b in rest:
                if state[b] == 1:
                    return 1
                if not state[b]:
                    state[b] = 1
                    stack.append((b, iter(into[b])))
                    break
            else:
                state[node] = 2
                stack.pop()
    return 0


def found(spark, graphs, rounds=None):
    e = spark.createDataFrame([(t, k, a, b, 0) for t, (es, _, _) in graphs.items() for k, (a, b) in enumerate(es)], EDGES)
    s = spark.createDataFrame([(t, n, ni, 1) for t, (_, n, ni) in graphs.items()], "topology_id long, n int, ni int, no int")
    return {r["topology_id"]: r["cyclic"] for r in topology.cycles(e, s, rounds).collect()}


def test_random_graphs_of_all_densities(spark):
    r, graphs = random.Random(4), {}
    for t in range(240):
        n, ni = r.randint(2, 14), r.randint(0, 2)
        m = r.randint(0, 3 * n)
        es = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        if t % 2:  # forward only, but for one edge at times
            es = [(min(a, b), max(a, b)) for a, b in es if a != b] + ([(n - 1, ni)] if t % 6 == 1 else [])
        graphs[t] = (es, n, ni)
    want = {t: has_cycle(*g) for t, g in graphs.items()}
    assert found(spark, graphs) == want and 40 < sum(want.values()) < 200


def test_long_chains_need_few_rounds(spark):
    r, n = random.Random(5), 4096
    names = list(range(1, n + 1))
    r.shuffle(names)
    chain = list(zip(names, names[1:], strict=False))
    ladder = [(a, b) for k in range(1, 600, 2) for a in (k, k + 1) for b in (k + 2, k + 3)]
    graphs = {1: (chain, n + 1, 1), 2: ([*chain, (names[-1], names[0])], n + 1, 1), 3: ([*chain, (names[3000], names[1000])], n + 1, 1), 4: (ladder, 700, 1), 5: ([*ladder, (599, 301)], 700, 1)}
    rounds: list[int] = []
    assert found(spark, graphs, rounds) == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}
    assert len(rounds) < 30


def test_graphs_without_edges(spark):
    assert found(spark, {1: ([], 3, 1), 2: ([(0, 1), (1, 1)], 3, 2), 3: ([(1, 1)], 3, 1)}) == {1: 0, 2: 0, 3: 1}
