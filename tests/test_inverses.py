"""Inverses by iteration: solutions from any hint, and the side that steps from the hint lead to."""

import math

import pytest
from pyspark.sql import functions as F

from graphnet_spark.functions import activations as A
from graphnet_spark.functions import sqlapi

HINTS = [None, float("nan"), float("inf"), -500.0, -30.0, -20.5, -12.0, -7.7, -5.0, -3.3, -2.0, -1.5, -1.3, -1.2, -1.0, -0.8, -0.7, -0.5, -0.1, 0.0, 0.1, 0.5, 0.9, 1.5, 2.2, 5.0, 9.9, 15.0, 40.0, 500.0]
LOWEST = {"Swish": -0.27846454, "Mish": -0.30884341, "GELU": -0.17004075}


def activation(name, x):
    if name == "BENT_IDENTITY":
        return (math.sqrt(x * x + 1) - 1) / 2 + x
    if name == "GELU":
        return x * (1 + math.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3))) / 2
    if x < -700:
        return 0.0
    return x / (1 + math.exp(-x)) if name == "Swish" else x * math.tanh(math.log1p(math.exp(x)) if x < 30 else x)


def targets(name):
    grid = [-0.3, -0.29, -0.27, -0.2, -0.17, -0.16, -0.1, -0.03, -1e-3, 1e-3, 0.01, 0.2, 0.499, 0.5, 0.7, 1.0, 3.131, 5.5, 9.5, 9.99]
    return [y for y in grid if y > LOWEST.get(name, -9)] + {"Swish": [12.0, 50.0, 1e4], "Mish": [12.0, 19.9], "GELU": [], "BENT_IDENTITY": [-0.5, -10.0, -400.0, 50.0, 1e6]}[name]


@pytest.mark.parametrize("name", A.ITERATED)
def test_every_hint_leads_to_a_solution(spark, name):
    rows = [(y, h) for y in targets(name) for h in HINTS]
    got = spark.createDataFrame(rows, "y double, h double").withColumn("x", A.iterated_inverse(name, "y", "h")).collect()
    for r in got:
        scale = max(1.0, abs(r["y"]))
        assert abs(activation(name, r["x"]) - r["y"]) < 1.0001e-6 * scale, r


def steps(name, y, hint):
    """Newton's steps with slopes from differences; whether they end on the falling side, or None if they find no solution."""
    x = hint if hint is not None and math.isfinite(hint) else (y / 2 if name == "Mish" else -1.0)
    x = max(-20.0, min(20.0, x)) if name == "Mish" else x
    turn = {"Mish": -1.19243, "GELU": -0.75246}[name]
    for _ in range(100):
        miss = activation(name, x) - y
        if abs(miss) < 1e-6:
            return x < turn
        slope = (activation(name, x + 1e-6) - activation(name, x - 1e-6)) / 2e-6
        if name == "Mish":
            slope = slope if abs(slope) > 1e-6 else math.copysign(1e-6, slope)
            x = max(-20.0, min(20.0, x - miss / slope))
        else:
            if abs(slope) < 1e-10 or abs(x - miss / slope) > 10:
                return None
            x -= miss / slope
    return None


@pytest.mark.parametrize("name", ["Mish", "GELU"])
def test_of_two_solutions_the_one_that_steps_lead_to(spark, name):
    rows = [(y, h) for y in targets(name) if y < 0 for h in HINTS]
    turn = {"Mish": -1.19243, "GELU": -0.75246}[name]
    known = 0
    for r in spark.createDataFrame(rows, "y double, h double").withColumn("x", A.iterated_inverse(name, "y", "h")).collect():
        side = steps(name, r["y"], r["h"])
        if side is not None:
            known += 1
            assert (r["x"] < turn) == side, r
    assert known > len(rows) / 2


def test_swish_goes_to_the_rising_side_unless_the_hint_is_a_solution(spark):
    rows = [(activation("Swish", x), h) for x in (-5.0, -3.0, -2.0, -1.4, -1.2, -0.5) for h in (*HINTS, x)]
    for r in spark.createDataFrame(rows, "y double, h double").withColumn("x", A.iterated_inverse("Swish", "y", "h")).collect():
        held = r["h"] is not None and math.isfinite(r["h"]) and abs(activation("Swish", r["h"]) - r["y"]) < 1e-6
        assert r["x"] == r["h"] if held else r["x"] >= -1.27847


def test_limits_and_values_without_a_solution(spark):
    cases = [
        ("Mish", 50.0, -3.0, 20.0), ("Mish", 20.0, None, 20.0), ("GELU", 50.0, 7.0, 7.0), ("GELU", 50.0, None, 0.0), ("GELU", 1e-11, 3.0, 3.0), ("GELU", 0.0, None, -10.0), ("GELU", 12.0, 12.0, 12.0),
        ("BENT_IDENTITY", 3.0, 2e10, 2e10), ("Swish", float("nan"), 4.0, 4.0), ("Mish", float("inf"), None, 0.0), ("GELU", float("-inf"), float("nan"), 0.0), ("Swish", -0.5, -30.0, -1.27846), ("Mish", -0.5, 3.0, -1.19243), ("GELU", -0.5, -3.0, -0.75246),
    ]
    for name, y, h, want in cases:
        got = spark.createDataFrame([(y, h)], "y double, h double").select(A.iterated_inverse(name, "y", "h")).head()[0]
        assert abs(got - want) < 1e-5, (name, y, h, got)


def test_the_session_function_finds_solutions(spark):
    sqlapi.register(spark)
    for name in A.ITERATED:
        xs = [0.3, 0.9, 2.0, 3.131, 7.0, 9.5]
        d = spark.createDataFrame([(activation(name, x), h) for x in xs for h in (-500.0, -30.0, -3.0, -0.9, 0.1, 3.0, 40.0, 500.0)], "y double, h double")
        for r in d.withColumn("x", F.expr(f"net_unsquash({A.CODES[name]}, y, h)")).collect():
            assert abs(activation(name, r["x"]) - r["y"]) < 1e-6, (name, r)


def test_errors_fall_back_to_the_inverse_where_slopes_vanish(spark):
    """Far on the falling side the slope is nearly 0, so the error is the way to the solution; Mish has no way back there."""
    d = spark.createDataFrame([(0.0, 0.5, -40.0)], "a double, t double, x double")
    got = d.select(*(F.expr(A.any_error_sql(n, "a", "t", "x")).alias(n) for n in ("Swish", "GELU", "Mish"))).head()
    assert abs(activation("Swish", -40 + got["Swish"]) - 0.5) < 1e-6 and abs(activation("GELU", -40 + got["GELU"]) - 0.5) < 1e-6 and got["Mish"] == 0


def test_a_hint_that_is_only_near_is_not_the_answer(spark):
    """A hint within 1e-6 of the solution's activation tells the side; the activation of the inverse is still what was inverted."""
    rows = [(name, activation(name, x) + d, x) for name in A.ITERATED for x in (-3.3, -0.9, 0.1) for d in (9e-7, -9e-7)]
    for name, y, h in rows:
        x = spark.createDataFrame([(y, h)], "y double, h double").select(A.iterated_inverse(name, "y", "h")).head()[0]
        assert abs(activation(name, x) - y) < 1e-12 and abs(x - h) < 1e-3, (name, y, h, x)


def test_inverses_without_limits_have_no_ends(spark):
    """Large values and values next to 0 have solutions, which hints far away do not take the place of."""
    rows = [(name, y, h) for name in A.ITERATED for y in (10.0002, 12.5, 20.0, 75.25, -1e-11, 0.0) for h in (None, -500.0, -30.0, -3.3, -0.9, 0.1, 2.2, 40.0, 500.0)]
    for name in A.ITERATED:
        d = spark.createDataFrame([r[1:] for r in rows if r[0] == name], "y double, h double")
        for r in d.withColumn("x", A.iterated_inverse(name, "y", "h", limited=False)).collect():
            assert abs(activation(name, r["x"]) - r["y"]) < 1e-9, (name, r)
