"""SQL verbs over arrays against plain computations and the operators over tables."""

import math

import pytest

from graphnet_spark.functions import activations as A
from graphnet_spark.functions import sqlapi
from graphnet_spark.operators import distribution


@pytest.fixture
def sql(spark):
    sqlapi.register(spark)
    return lambda text: spark.sql(text).head()


def array(values):
    return f"array({', '.join(f'CAST({v!r} AS DOUBLE)' if math.isfinite(v) else f'''double('{v}')''' for v in values)})" if values else "CAST(array() AS ARRAY<DOUBLE>)"


def top(values):
    return (*sorted((abs(v) for v in values if v == v), reverse=True), 0.0, 0.0)[:2]


@pytest.mark.parametrize("weights, biases", [([], []), ([1.0], []), ([], [-2.0]), ([3.0, -3.0, 1.0], [0.5]), ([0.1, -7.0], [7.0, 2.0, -9.0]), ([1.0, float("nan")], [2.0])])
def test_scores_and_scans(sql, weights, biases):
    w, b = array(weights), array(biases)
    got = sql(f"SELECT c.* FROM (SELECT net_score_components({w}, {b}) AS c)")
    total = sum(map(abs, weights + biases))
    assert (math.isnan(total) and math.isnan(got["total"]) or abs(got["total"] - total) < 1e-12) and got["count"] == len(weights) + len(biases)
    assert (got["largest"], got["second"]) == top(weights + biases)
    for new in (0.0, -4.0, 20.0):
        for k in (-1, 0, 1, 5):
            left = lambda xs: [x for i, x in enumerate(xs) if i != k]
            got = sql(f"SELECT net_scan_max_weight({w}, {b}, {k}, CAST({new} AS DOUBLE)) AS w, net_scan_max_bias({w}, {b}, {k}, CAST({new} AS DOUBLE)) AS b")
            assert tuple(got["w"]) == top([*left(weights), *biases, new]) and tuple(got["b"]) == top([*weights, *left(biases), new])


def test_elastic_shares_equal_the_table_operator(spark, sql):
    nan = float("nan")
    cases = [(1.5, [1.0, 2.0, 0.5], [1.0, 0.5, 1.0], [0.1, 0.2, 0.3]), (-0.7, [0.0, 0.0], [1.0, 1.0], [3.0, -1.0]), (2.0, [0.0, 0.0, 0.0], [1.0] * 3, [0.0] * 3), (1.0, [nan, 2.0], [1.0, 2.0], [1.0, 1.0]), (nan, [1.0], [1.0], [1.0]), (0.3, [1.0] * 7, [1.0] * 7, [1.0] * 7)]
    for k, (e, a, s, w) in enumerate(cases):
        got = sql(f"SELECT net_elastic_distribution({'double(chr(78)||chr(97)||chr(78))' if e != e else f'CAST({e} AS DOUBLE)'}, {array(a)}, {array(s)}, {array(w)}) AS x")["x"]
        links = spark.createDataFrame([(k, i, *v, e) for i, v in enumerate(zip(a, s, w))], "n int, ord int, activation double, safe double, weight double, error double")
        want = [r["share"] for r in distribution.elastic_split(links, "n").orderBy("ord").collect()]
        assert all(abs(x - y) < 1e-12 for x, y in zip(got, want, strict=True)), (k, got, want)
        if e == e:
            assert abs(sum(got) - e) < 1e-12
    assert sql(f"SELECT net_elastic_distribution(1D, {array([])}, {array([])}, {array([])}) AS x")["x"] == []


def test_fused_distribution(sql):
    call = lambda t, codes, hints, acts, weights: sql(f"SELECT net_fused_error_distribution({A.CODES['TANH']}, 0.2D, CAST({t} AS DOUBLE), 0.2027325540540822D, array({', '.join(map(str, codes))}), {array(hints)}, {array(acts)}, {array(weights)}) AS x")["x"]
    tanh, relu = A.CODES["TANH"], A.CODES["RELU"]
    got = call(0.5, [tanh, relu], [0.5, -1.0], [0.4, 0.9], [1.0, float("inf")])
    error = 0.3 / (1 - math.tanh(0.2027325540540822) ** 2)
    assert abs(got[0] - error) < 1e-9 and got[1:3] == [1.0, 1.0]
    assert abs(got[3] - error * 0.16 / 0.97) < 1e-9 and abs(got[3] + got[4] - got[0]) < 1e-12
    assert call(0.2, [tanh, relu], [0.5, -1.0], [0.4, 0.9], [1.0, 1.0]) == [0.0, 1.0, 1.0, 0.0, 0.0]
    assert len(sql(f"SELECT net_fused_error_distribution(7, 0.2D, 0.5D, 0.2D, CAST(array() AS ARRAY<BIGINT>), {array([])}, {array([])}, {array([])}) AS x")["x"]) == 1


def test_batches_are_their_scalars(sql):
    xs, codes = [-3.0, -0.5, 0.0, 0.7, 4.0], list(range(5, 10))
    got = sql(f"SELECT net_derivative_batch(11, {array(xs)}) AS d, net_safe_zone_batch(array({', '.join(map(str, codes))}), {array(xs)}, 0.5D, {array(xs)}) AS s, net_calculate_error_batch(12, {array(xs)}, {array([0.1] * 5)}, {array(xs)}) AS e, array({', '.join(f'net_derivative(11, {x}D)' for x in xs)}) AS d1, array({', '.join(f'net_safe_zone({c}, {x}D, 0.5D, {x}D)' for c, x in zip(codes, xs))}) AS s1, array({', '.join(f'net_calculate_error(12, {x}D, 0.1D, {x}D)' for x in xs)}) AS e1")
    assert got["d"] == got["d1"] and got["s"] == got["s1"] and got["e"] == got["e1"]


def test_magnitudes_of_keys_with_nulls_ties_and_one_value(spark):
    from graphnet_spark.operators import accumulate

    rows = [(1, -3.0), (1, 3.0), (1, 1.0), (2, -5.0), (None, 2.0), (None, -7.0)] + [(3, 4.0)] * 500
    got = {r["k"]: tuple(r)[1:] for r in accumulate.magnitude_stats(spark.createDataFrame(rows, "k int, v double").repartition(3), ["k"], "v").collect()}
    assert got == {1: (7.0, 3, 3.0, 3.0), 2: (5.0, 1, 5.0, 0.0), None: (9.0, 2, 7.0, 2.0), 3: (2000.0, 500, 4.0, 4.0)}


def test_order_of_lists(spark):
    from graphnet_spark.operators import topology

    cases = [([0, 0, 1], [1, 2, 2], (0, 0)), ([], [], (0, 0)), ([1], [1, 2], (6, 0)), (None, [1], (6, 0)), ([2], [2], (1, 0)), ([0, 3], [1, 2], (2, 1)), ([1, 0], [2, 1], (3, 1)), ([0, 0], [3, 2], (4, 1)), ([0, 0, 0], [1, 2, 2], (5, 2)), ([0, 2, 1], [1, 3, 1], (1, 2))]
    d = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "topology_id long, from_list array<long>, to_list array<long>")
    assert {r["topology_id"]: (r["code"], r["pos"]) for r in topology.validate_lists(d).collect()} == {k: x for k, (_, _, x) in enumerate(cases)}
