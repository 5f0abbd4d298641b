"""Activation functions with their ranges, derivatives, inverses, saturation factors and value-space errors.

Each is a SQL expression over columns, so Catalyst folds and compiles it with the rest of a query; no UDF is involved. All
work is in double precision. Expressions guard zero divisors, logarithms of non-positive numbers, NaN and infinities
themselves, since engines differ there. A code that is not known means IDENTITY.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest single-precision number, SELU and leaky constants, 2**53, ends of the softsign range.
BIG, ALPHA, LAMBDA, LEAK, TWO53, SOFT = "3.4028234663852886e38", "1.6732632e0", "1.050701e0", "1e-2", "9007199254740992e0", "9.899999499320984e-1"
PI = "3.141592653589793e0"
SIGMOID = "(1e0 / (1e0 + exp(-({x}))))"
NORMAL = "tanh(7.978845608028654e-1 * ({x} + 4.4715e-2 * {x} * {x} * {x}))"
SOFTPLUS = "(CASE WHEN {x} > 30e0 THEN {x} ELSE ln(1e0 + exp({x})) END)"


def finite(x: str) -> str:
    return f"(abs({x}) <= 1.7976931348623157e308)"


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


@dataclass(frozen=True)
class Activation:
    """forward and slope are over {x}; inverse over {y} and {h} (a hint); safe over {x}, {e} (error) and {w} (weight)."""

    name: str
    low: str
    high: str
    forward: str
    slope: str
    inverse: str
    safe: str
    error: str = "slope"
    aliases: tuple[str, ...] = ()


HINT = "(CASE WHEN " + finite("{h}") + " THEN {h} ELSE %s END)"
TINY = "((abs({w}) < 1e-3 AND {w} * {e} > 0e0) OR (abs({w}) > 1e3 AND {w} * {e} < 0e0))"


def window(low: float, high: float, fade: float) -> str:
    """1 inside unless a very small or large weight improves; 0 outside if the error leads further out; a linear fade between."""
    a, b, k = f"({low!r} * 1e0)", f"({high!r} * 1e0)", f"{fade!r}e0"
    return (
        f"CASE WHEN {{x}} >= {a} AND {{x}} <= {b} THEN CASE WHEN {TINY} THEN 0e0 ELSE 1e0 END "
        f"WHEN ({{x}} < {a} AND {{e}} < 0e0) OR ({{x}} > {b} AND {{e}} > 0e0) THEN 0e0 "
        f"WHEN {{x}} > {b} AND {{x}} <= {b} + {k} THEN 1e0 - ({{x}} - {b}) / {k} WHEN {{x}} < {a} AND {{x}} >= {a} - {k} THEN 1e0 - ({a} - {{x}}) / {k} ELSE 0e0 END"
    )


def recovering(safe: float, end: float, part: str, edge: float | None = None) -> str:
    """1 within ±safe; `part` beyond ±edge where the error leads back; a linear fade to ±end."""
    a, b, c = f"({safe!r} * 1e0)", f"({end!r} * 1e0)", f"({(safe if edge is None else edge)!r} * 1e0)"
    beyond = (">", "<") if edge is None else (">=", "<=")
    return (
        f"CASE WHEN abs({{x}}) <= {a} THEN 1e0 WHEN ({{x}} {beyond[0]} {c} AND {{e}} < 0e0) OR ({{x}} {beyond[1]} -{c} AND {{e}} > 0e0) THEN {part} "
        f"WHEN abs({{x}}) <= {b} THEN 1e0 - (abs({{x}}) - {a}) / ({b} - {a}) ELSE 0e0 END"
    )


def unbounded(name: str, forward: str, slope: str, inverse: str, safe: str, error: str = "slope", low: str = f"-{BIG}", high: str = BIG, aliases: tuple[str, ...] = ()) -> Activation:
    return Activation(name, low, high, forward, slope, inverse, safe, error, aliases)


NEWTON = ""  # inverses found by iteration have no closed form: see iterated_sql()
KEEP = HINT % "{y}"

ACTIVATIONS = (
    unbounded("IDENTITY", "{x}", "1e0", "{y}", "CASE WHEN abs({x}) > 1e6 AND abs({w}) < 1e-6 THEN 0e0 ELSE 1e0 END", "raw"),
    unbounded("RELU", "CASE WHEN isnan({x}) OR {x} <= 0e0 THEN 0e0 ELSE {x} END", "CASE WHEN {x} > 0e0 THEN 1e0 ELSE 0e0 END", "CASE WHEN {y} > 0e0 THEN {y} ELSE " + HINT % "0e0" + " END", "CASE WHEN {x} > 0e0 OR {e} > 0e0 THEN 1e0 ELSE 0e0 END", "active", "0e0", BIG, ("ReLU",)),
    unbounded("ReLU6", clamp("{x}", "0e0", "6e0"), "CASE WHEN {x} > 0e0 AND {x} < 6e0 THEN 1e0 ELSE 0e0 END", "CASE WHEN {y} > 0e0 AND {y} < 6e0 THEN {y} WHEN {y} = 6e0 AND " + finite("{h}") + " THEN greatest({h}, 6e0) WHEN {y} = 0e0 AND " + finite("{h}") + " THEN least({h}, 0e0) ELSE 0e0 END", "CASE WHEN ({x} > 0e0 AND {x} < 6e0) OR ({x} <= 0e0 AND {e} > 0e0) OR ({x} >= 6e0 AND {e} < 0e0) THEN 1e0 ELSE 0e0 END", "active", "0e0", "6e0"),
    unbounded("LeakyReLU", f"CASE WHEN {{x}} >= 0e0 THEN {{x}} ELSE {LEAK} * {{x}} END", f"CASE WHEN {{x}} >= 0e0 THEN 1e0 ELSE {LEAK} END", f"CASE WHEN {{y}} >= 0e0 THEN {{y}} ELSE {{y}} / {LEAK} END", window(-50, 50, 20), "inverse"),
    unbounded("SELU", f"CASE WHEN {{x}} > 0e0 THEN {LAMBDA} * {{x}} ELSE {LAMBDA} * {ALPHA} * (exp({{x}}) - 1e0) END", f"CASE WHEN {{x}} >= 0e0 THEN {LAMBDA} ELSE {LAMBDA} * {ALPHA} * exp({{x}}) END", f"CASE WHEN {{y}} >= 0e0 THEN {{y}} / {LAMBDA} WHEN {{y}} / {LAMBDA} / {ALPHA} + 1e0 > 0e0 THEN ln({{y}} / {LAMBDA} / {ALPHA} + 1e0) ELSE " + HINT % "-10e0" + " END", window(-10, 10, 10), low=f"-{ALPHA} * {LAMBDA}"),
    unbounded("ELU", "CASE WHEN {x} > 0e0 THEN {x} ELSE exp({x}) - 1e0 END", "CASE WHEN {x} > 0e0 THEN 1e0 ELSE exp({x}) END", "CASE WHEN {y} > 0e0 THEN {y} WHEN {y} + 1e0 > 0e0 THEN ln({y} + 1e0) ELSE " + HINT % "-20e0" + " END", window(-10, 10, 10), low="-1e0"),
    Activation("LOGISTIC", "0e0", "1e0", SIGMOID, f"({SIGMOID} * (1e0 - {SIGMOID}))", "ln(" + clamp("{y}", "1.1920929e-7", "9.999998807907104e-1") + " / (1e0 - " + clamp("{y}", "1.1920929e-7", "9.999998807907104e-1") + "))", recovering(6, 10, "2e-1"), "own"),
    Activation("TANH", "-1e0", "1e0", "tanh({x})", "(1e0 - tanh({x}) * tanh({x}))", "CASE WHEN abs({y}) >= 9.999999e-1 THEN " + HINT % "10e0 * sign({y})" + " ELSE 5e-1 * ln((1e0 + {y}) / (1e0 - {y})) END", recovering(2, 6, "2e-1")),
    Activation("HARD_TANH", "-1e0", "1e0", clamp("{x}", "-1e0", "1e0"), "CASE WHEN {x} > -1e0 AND {x} < 1e0 THEN 1e0 ELSE 0e0 END", "CASE WHEN " + finite("{h}") + " AND " + clamp("{h}", "-1e0", "1e0") + " = {y} THEN {h} ELSE {y} END", recovering(0.9, 1.2, "2e-1", 1.0), aliases=("CLIPPED",)),
    Activation("SOFTSIGN", f"-{SOFT}", SOFT, clamp("{x} / (1e0 + abs({x}))", f"-{SOFT}", SOFT), "1e0 / ((1e0 + abs({x})) * (1e0 + abs({x})))", "CASE WHEN 1e0 - abs({y}) <= 1e-8 THEN " + HINT % "0e0" + " ELSE {y} / (1e0 - abs({y})) END", window(-10, 10, 10)),
    Activation("Softplus", "1e-15", "1e2", f"CASE WHEN {{x}} >= 709e0 THEN 1e2 ELSE {SOFTPLUS} END", SIGMOID, "CASE WHEN {y} < 1e-10 THEN 0e0 WHEN {y} > 30e0 THEN {y} ELSE ln(exp({y}) - 1e0) END", window(-10, 20, 10)),
    unbounded("Swish", f"{{x}} * {SIGMOID}", f"({SIGMOID} * (1e0 + {{x}} * (1e0 - {SIGMOID})))", NEWTON, window(-10, 10, 10), "steep", "-2.78e-1"),
    unbounded("Mish", f"{{x}} * tanh({SOFTPLUS})", f"greatest(0e0, tanh({SOFTPLUS}) + {{x}} * {SIGMOID} * (1e0 - tanh({SOFTPLUS}) * tanh({SOFTPLUS})))", NEWTON, window(-10, 10, 10), "always", "-3.09e-1"),
    unbounded("GELU", f"5e-1 * {{x}} * (1e0 + {NORMAL})", f"(5e-1 * (1e0 + {NORMAL}) + 5e-1 * {{x}} * (1e0 - {NORMAL} * {NORMAL}) * 7.978845608028654e-1 * (1e0 + 1.34145e-1 * {{x}} * {{x}}))", NEWTON, window(-6, 6, 10), "steep", "-1.7e-1"),
    Activation("SINE", "-1e0", "1e0", "sin({x})", "cos({x})", NEWTON, f"CASE WHEN abs(cos({{x}})) < 1e-1 THEN CASE WHEN cos({{x}}) * {{e}} < 0e0 THEN 0e0 ELSE abs(cos({{x}})) / 1e-1 END WHEN {TINY} THEN 0e0 ELSE 1e0 END", "steep", ("SINUSOID",)),
    Activation("Cosine", "-1e0", "1e0", "cos({x})", "-sin({x})", NEWTON, f"CASE WHEN abs(sin({{x}})) > 1e-1 THEN CASE WHEN {TINY} THEN 0e0 ELSE 1e0 END WHEN abs(sin({{x}})) > 5e-2 THEN (abs(sin({{x}})) - 5e-2) / 5e-2 ELSE 0e0 END", "steep"),
    unbounded("TAN", clamp("tan({x})", "-1e3", "1e3"), "least(1e0 + tan({x}) * tan({x}), 1e3)", f"atan({{y}}) + (CASE WHEN {finite('{h}')} THEN sign({{h}} - atan({{y}})) * floor(abs({{h}} - atan({{y}})) / {PI} + 5e-1) * {PI} ELSE 0e0 END)", NEWTON, "below"),
    Activation("ArcTan", f"-{PI} / 2e0", f"{PI} / 2e0", "atan({x})", "1e0 / (1e0 + {x} * {x})", f"CASE WHEN {{y}} >= {PI} / 2e0 - 1e-5 THEN " + HINT % "1e6" + f" WHEN {{y}} <= 1e-5 - {PI} / 2e0 THEN " + HINT % "-1e6" + " ELSE tan({y}) END", "CASE WHEN abs({x}) > 4e0 THEN 0e0 ELSE " + recovering(2, 4, "3e-1") + " END"),
    Activation("GAUSSIAN", "0e0", "1e0", "exp(-({x} * {x}))", "-2e0 * {x} * exp(-({x} * {x}))", "(CASE WHEN " + finite("{h}") + " AND {h} < 0e0 THEN -1e0 ELSE 1e0 END) * sqrt(greatest(0e0, -ln(greatest({y}, 1e-10))))", window(-3, 3, 3), "steep"),
    unbounded("BENT_IDENTITY", "(sqrt({x} * {x} + 1e0) - 1e0) / 2e0 + {x}", "{x} / (2e0 * sqrt({x} * {x} + 1e0)) + 1e0", NEWTON, recovering(10, 20, "3e-1"), "steep"),
    Activation("BIPOLAR_SIGMOID", "-1e0", "1e0", f"2e0 * {SIGMOID} - 1e0", f"(1e0 - (2e0 * {SIGMOID} - 1e0) * (2e0 * {SIGMOID} - 1e0)) / 2e0", "CASE WHEN abs({y}) >= 1e0 - 1e-6 AND " + finite("{h}") + " THEN {h} ELSE -ln(2e0 / (" + clamp("{y}", "-9.99999999e-1", "9.99999999e-1") + " + 1e0) - 1e0) END", window(-4, 4, 4)),
    Activation("BIPOLAR", "-1e0", "1e0", "CASE WHEN {x} > 0e0 THEN 1e0 ELSE -1e0 END", "0e0", "CASE WHEN " + finite("{h}") + " AND (sign({h}) = sign({y}) OR (abs({h}) < 1e-10 AND {y} < 0e0)) THEN {h} WHEN {y} >= 0e0 THEN 1e0 ELSE -1e0 END", "0e0", "inverse"),
    Activation("STEP", "0e0", "1e0", "CASE WHEN {x} > 0e0 THEN 1e0 ELSE 0e0 END", "CASE WHEN abs({x}) < 1e-2 THEN 1e-2 ELSE 0e0 END", "CASE WHEN " + finite("{h}") + " AND (({y} = 1e0 AND {h} > 0e0) OR ({y} = 0e0 AND {h} <= 0e0)) THEN {h} ELSE {y} END", "CASE WHEN ({x} > 0e0) <> ({e} > 0e0) THEN 1e0 ELSE 2e-1 END", "inverse"),
    unbounded("COMPLEMENT", "1e0 - {x}", "-1e0", "1e0 - {y}", "1e0", "negated", aliases=("INVERSE",)),
    unbounded("ABSOLUTE", "abs({x})", "sign({x})", "CASE WHEN " + finite("{h}") + " AND {h} < 0e0 THEN -({y}) ELSE {y} END", "CASE WHEN abs({x}) > 1e3 AND abs({w}) < 1e-3 THEN 0e0 ELSE 1e0 END", "nearest", "0e0"),
    unbounded("SQUARE", "least({x} * {x}, 1e6)", "2e0 * {x}", "(CASE WHEN " + finite("{h}") + " AND {h} < 0e0 THEN -1e0 ELSE 1e0 END) * sqrt(greatest({y}, 0e0))", recovering(5, 10, "2e-1"), "capped", "0e0"),
    unbounded("Cube", clamp("{x} * {x} * {x}", "-1e6", "1e6"), "3e0 * {x} * {x}", "cbrt({y})", recovering(5, 10, "2e-1"), "steep"),
    unbounded("SQRT", "CASE WHEN {x} >= 0e0 THEN sqrt(greatest({x}, 0e0)) ELSE 0e0 END", "CASE WHEN {x} > 0e0 THEN 1e0 / (2e0 * sqrt(greatest({x}, 1e-300))) ELSE 0e0 END", "CASE WHEN " + finite("{h}") + " THEN CASE WHEN {y} <= 0e0 THEN {h} WHEN {h} < 0e0 THEN -({y} * {y}) ELSE {y} * {y} END ELSE {y} * {y} END", "CASE WHEN {x} < 0e0 AND {e} < 0e0 THEN 0e0 WHEN {x} >= 1e-2 AND {x} <= 10e0 THEN 1e0 WHEN {x} < 1e-2 AND {e} > 0e0 THEN 3e-1 WHEN {x} > 10e0 AND {x} <= 20e0 THEN 1e0 - ({x} - 10e0) / 10e0 ELSE 0e0 END", "capped", "0e0"),
    unbounded("StdInverse", "CASE WHEN abs({x}) < 1e-10 THEN CASE WHEN {x} < 0e0 THEN -1e10 ELSE 1e10 END ELSE 1e0 / {x} END", "-sign({x}) / ((1e0 + abs({x})) * (1e0 + abs({x})))", f"CASE WHEN abs({{y}}) < 1e-15 THEN (CASE WHEN {finite('{h}')} THEN {{h}} WHEN {{y}} > 0e0 THEN {BIG} ELSE -{BIG} END) ELSE 1e0 / {{y}} END", window(-10, 10, 10), "steep"),
    unbounded("Exponential", f"CASE WHEN {{x}} >= 36e0 THEN {TWO53} ELSE exp({{x}}) END", "CASE WHEN {x} > 10e0 THEN 50e0 WHEN exp({x}) < 1e-12 THEN 0e0 ELSE least(exp({x}), 50e0) END", "CASE WHEN {y} <= 0e0 THEN " + HINT % "-20e0" + " ELSE ln(greatest({y}, 1e-300)) END", window(-10, 30, 10), "ranged", "0e0"),
    unbounded("LogSigmoid", f"CASE WHEN {{x}} <= -709e0 THEN -{TWO53} ELSE -ln(1e0 + exp(-({{x}}))) END", "CASE WHEN {x} >= 709e0 THEN 1e-6 WHEN {x} <= -709e0 THEN 1e0 ELSE " + clamp("exp(-({x})) / (1e0 + exp(-({x})))", "1e-6", "1e0") + " END", "CASE WHEN {y} < -700e0 OR {y} >= 0e0 THEN " + HINT % "-10e0" + " ELSE ln(exp({y}) / greatest(1e0 - exp({y}), 1e-300)) END", window(-20, 20, 10), low=f"-{BIG}", high="0e0"),
    Activation("ISRU", "-1e0", "1e0", "{x} / sqrt(1e0 + {x} * {x})", "1e0 / ((1e0 + {x} * {x}) * sqrt(1e0 + {x} * {x}))", clamp("{y}", "-9.999999e-1", "9.999999e-1") + " / sqrt(1e0 - " + clamp("{y}", "-9.999999e-1", "9.999999e-1") + " * " + clamp("{y}", "-9.999999e-1", "9.999999e-1") + ")", window(-10, 10, 10)),
    unbounded("MINIMUM", "{x}", "0e0", KEEP, "0e0", "none"),
    unbounded("MAXIMUM", "{x}", "0e0", KEEP, "0e0", "none"),
    unbounded("IF", "{x}", "0e0", KEEP, "0e0", "none"),
    unbounded("HYPOT", "abs({x})", "0e0", KEEP, "0e0", "none"),
    unbounded("HYPOTv2", "abs({x})", "0e0", KEEP, "0e0", "none", "0e0"),
    unbounded("MEAN", "{x}", "0e0", KEEP, "0e0", "none"),
)
CODES = {a.name: k for k, a in enumerate(ACTIVATIONS)}
ALIASES = CODES | {alias: k for k, a in enumerate(ACTIVATIONS) for alias in a.aliases}
TAN_SAFE = (
    f"CASE WHEN abs(abs({{x}} % {PI}) - {PI} / 2e0) < 2e-1 AND (({{x}} % {PI} > {PI} / 2e0 AND {{e}} > 0e0) OR ({{x}} % {PI} < -{PI} / 2e0 AND {{e}} < 0e0)) THEN 0e0 "
    f"WHEN abs(abs({{x}} % {PI}) - {PI} / 2e0) >= 2e-1 AND {TINY} THEN 0e0 "
    f"WHEN abs(abs({{x}} % {PI}) - {PI} / 2e0) < 5e-1 THEN 1e0 - (5e-1 - abs(abs({{x}} % {PI}) - {PI} / 2e0)) * 2e0 ELSE 1e0 END"
)
#: Inverses without a closed form over SQL scalars.
ITERATED, PERIODIC = ("Swish", "Mish", "GELU", "BENT_IDENTITY"), ("SINE", "Cosine")


def _of(name: str) -> Activation:
    return ACTIVATIONS[ALIASES[name]]


def forward_sql(name: str, x: str) -> str:
    return f"({_of(name).forward.format(x=f'({x})')})"


def slope_sql(name: str, x: str) -> str:
    return f"({_of(name).slope.format(x=f'({x})')})"


def safe_sql(name: str, x: str, error: str, weight: str) -> str:
    rule = TAN_SAFE if name == "TAN" else _of(name).safe
    return f"(CASE WHEN NOT {finite(x)} THEN 0e0 ELSE {rule.format(x=f'({x})', e=f'({error})', w=f'({weight})')} END)"


def inverse_sql(name: str, y: str, hint: str) -> str:
    """The closed inverse; a y that is not finite gives the hint, or 0."""
    rule = _of(name).inverse
    if not rule:
        raise ValueError(f"{name} has no closed inverse")
    return f"(CASE WHEN NOT {finite(y)} THEN (CASE WHEN {finite(hint)} THEN {hint} ELSE 0e0 END) ELSE {rule.format(y=f'({y})', h=f'({hint})')} END)"


def limit_sql(name: str, v: str) -> str:
    """NaN becomes 0, everything else is brought into the output range."""
    a = _of(name)
    return f"(CASE WHEN isnan({v}) THEN 0e0 ELSE {clamp(v, a.low, a.high)} END)"


def error_sql(name: str, activation: str, target: str, value: str, inverse: str | None = None) -> str:
    """The error in value space: raw error over slope where the slope is strong, else the way to the inverse; within ±100.

    inverse stands for the inverse of the target where it has no closed form.
    """
    kind, raw, slope = _of(name).error, f"(({target}) - ({activation}))", slope_sql(name, value)
    if kind == "none":
        return "0e0"
    back = lambda: f"({inverse if inverse is not None else inverse_sql(name, target, value)} - ({value}))"
    if kind in ("raw", "negated"):
        out = raw if kind == "raw" else f"(-{raw})"
    elif kind == "inverse":
        out = back()
    elif kind == "active":
        out = f"(CASE WHEN {slope} > 0e0 THEN {raw} ELSE {back()} END)"
    elif kind == "nearest":
        out = f"(CASE WHEN abs(({value}) + ({target})) < abs(({value}) - ({target})) THEN -({target}) ELSE ({target}) END - ({value}))"
    elif kind == "always":
        out = f"(CASE WHEN {slope} = 0e0 THEN 0e0 ELSE {raw} / {slope} END)"
    else:
        if kind == "own":
            slope = f"(({activation}) * (1e0 - ({activation})))"
        strong = {"slope": f"{slope} > 1e-8", "own": f"{slope} > 1e-8", "below": f"abs({slope}) > 1e-8 AND {slope} < 1e3", "ranged": f"{slope} > 1e-8 AND {slope} < 1e8"}.get(kind, f"abs({slope}) > 1e-8")
        divisor = clamp(slope, "-5e1", "5e1") if kind == "capped" else slope
        out = f"(CASE WHEN {strong} THEN {raw} / (CASE WHEN {divisor} = 0e0 THEN 1e0 ELSE {divisor} END) ELSE {back()} END)"
    return f"(CASE WHEN abs({raw}) < 1e-6 OR NOT {finite(out)} THEN 0e0 ELSE {clamp(out, '-1e2', '1e2')} END)"


def by_code(code: str, of, names=None) -> str:
    """A dispatch over a column of codes; of(name) gives the expression of one function. names: those that can occur, if known."""
    cases = " ".join(f"WHEN {k} THEN {of(a.name)}" for k, a in enumerate(ACTIVATIONS) if names is None or a.name in names)
    return f"(CASE {code} {cases} ELSE {of('IDENTITY')} END)" if cases else f"({of('IDENTITY')})"


def squash(name: str, x: str = "x") -> Column:
    """The activation of a column or expression."""
    return F.expr(forward_sql(name, x))


def derivative(name: str, x: str = "x") -> Column:
    return F.expr(slope_sql(name, x))


def limit(name: str, v: str = "x") -> Column:
    return F.expr(limit_sql(name, v))


def validate(name: str, v: str = "x") -> Column:
    """Whether a value is finite and within the output range."""
    a = _of(name)
    return F.expr(f"({finite(v)} AND ({v}) >= {a.low} AND ({v}) <= {a.high})")


def safe_zone(name: str, x: str = "x", error: str = "error", weight: str = "weight") -> Column:
    return F.expr(safe_sql(name, x, error, weight))


#: Where functions without a closed inverse turn from falling to rising, and how far from 0 their inverses reach.
TURN = {"Swish": "-1.2784645427610738e0", "Mish": "-1.1924312145e0", "GELU": "-7.524614221e-1"}
REACH = {"Swish": "1e300", "Mish": "2e1", "GELU": "1e1"}
#: How far below 0 activations can be told from 0, for inverses without limits.
LOWER = {"Swish": "1e300", "Mish": "8e2", "GELU": "4e1"}
#: Fixed value: a hint whose activation is as near as this to y tells the side of the inverse, and steps from a hint end there.
TOLERANCE = "1e-6"
#: A hint whose activation is as near as this to y is the inverse itself.
EXACT = "1e-12"
#: Slopes whose sign counts: those for training leave negative ones out.
TRUE_SLOPE = {"Mish": f"(tanh({SOFTPLUS}) + {{x}} * {SIGMOID} * (1e0 - tanh({SOFTPLUS}) * tanh({SOFTPLUS})))"}


def bound(value: str, name: str, body: str) -> str:
    """body with a value that is computed once under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _miss(name: str, x: str, y: str) -> str:
    """How far f(x) is from y, and the slope there; 0 as a slope is null, so that quotients are."""
    a = _of(name)
    return f"named_struct('e', {a.forward.format(x=x)} - {y}, 'd', nullif({TRUE_SLOPE.get(a.name, a.slope).format(x=x)}, 0e0))"


def _stepped(name: str, y: str, start: str, rounds: int) -> str:
    """Where plain Newton steps from the start end: within the tolerance, at a flat place or at the limit."""
    if name == "Mish":  # steps stay within the reach, and flat places are stepped from
        move = "least(greatest(s.x - q.e / CASE WHEN abs(q.d) > 1e-6 THEN q.d WHEN q.d < 0e0 THEN -1e-6 ELSE 1e-6 END, -2e1), 2e1)"
        end = f"abs(q.e) < {TOLERANCE}"
    else:
        move = "s.x - q.e / q.d"
        end = f"abs(q.e) < {TOLERANCE} OR coalesce(abs(q.d), 0e0) < 1e-10 OR abs({move}) > 1e1"
    step = bound(_miss(name, "(s.x)", y), "q", f"CASE WHEN {end} THEN named_struct('x', s.x, 'done', true) ELSE named_struct('x', {move}, 'done', false) END")
    return f"aggregate(sequence(1, {rounds}), named_struct('x', {start}, 'done', false), (s, i) -> CASE WHEN s.done THEN s ELSE {step} END).x"


def _safeguarded(name: str, y: str, left: str, rounds: int, limited: bool = True) -> str:
    """The solution on one side of the turn: Newton steps that stay between bounds, which close in, or else halves."""
    turn, reach = TURN[name], REACH[name] if limited else "1e300"
    low, high = f"CASE WHEN w THEN -{REACH[name] if limited else LOWER[name]} ELSE {turn} END", f"CASE WHEN w THEN {turn} ELSE least(greatest({y}, 0e0) + 1e0, {reach}) END"
    more = "((q.e < 0e0) <> w)"  # the solution is above s.x
    a, b, n = f"CASE WHEN {more} THEN s.x ELSE s.a END", f"CASE WHEN {more} THEN s.b ELSE s.x END", "s.x - q.e / q.d"
    within = "p.n >= p.a AND p.n <= p.b"
    still = "abs(p.n - s.x) <= 2e-16 * abs(s.x)"  # Newton's step is too small to count
    moved = f"named_struct('a', p.a, 'b', p.b, 'x', CASE WHEN {within} THEN p.n ELSE (p.a + p.b) / 2e0 END, 'done', coalesce({within} AND {still}, false))"
    step = bound(_miss(name, "(s.x)", y), "q", bound(f"named_struct('a', {a}, 'b', {b}, 'n', {n})", "p", moved))
    zero = f"named_struct('a', {low}, 'b', {high}, 'x', CASE WHEN w THEN {turn} - 1e0 ELSE {high} END, 'done', false)"
    return bound(left, "w", f"aggregate(sequence(1, {rounds}), {zero}, (s, i) -> CASE WHEN s.done THEN s ELSE {step} END).x")


def iterated_sql(name: str, y: str, hint: str = "CAST(NULL AS DOUBLE)", rounds: int = 100, limited: bool = True) -> str:
    """The inverse of Swish, Mish, GELU or BENT_IDENTITY near a hint, if there is one.

    A hint whose activation is y is the answer; where it is within the tolerance of y, the solution on the hint's side is. Of two
    other solutions, that counts to which Newton steps from the hint lead (Swish: always the rising side); without a hint they start at y or y / 2, for GELU at 1 or -1. A y below the least
    activation gives the turn. Mish's inverses end at ±20; beyond 10, GELU's hint (or 0) takes the inverse's place, and for a y
    that is next to 0 its hint or -10. A y that is not finite gives the hint, or 0. Not limited, Mish's and GELU's inverses have no
    such ends: every y from the least activation on gives a solution.
    """
    name = _of(name).name
    h, v = "k.h", "k.y"
    forward = lambda x: _of(name).forward.format(x=f"({x})")
    known = finite(h)
    near, held = (f"{known} AND abs({forward(h)} - {v}) < {limit}" for limit in (TOLERANCE, EXACT))
    if name == "BENT_IDENTITY":
        c = f"(2e0 * {v} + 1e0)"
        out = f"CASE WHEN {held} OR ({known} AND abs({h}) >= 1e10) THEN {h} ELSE (2e0 * {c} - sqrt({c} * {c} + 3e0)) / 3e0 END"
    elif name == "Swish":
        left = f"CASE WHEN {near} AND {h} >= -2e1 THEN {h} < {TURN[name]} ELSE false END"
        out = f"CASE WHEN {held} AND {h} >= -2e1 THEN {h} ELSE {_safeguarded(name, v, left, rounds)} END"
    else:
        first = f"CASE WHEN {v} >= 0e0 THEN {v} ELSE {v} / 2e0 END" if name == "Mish" else f"CASE WHEN {v} < 5e-1 THEN -1e0 ELSE 1e0 END"
        start = f"CASE WHEN {known} THEN {h} ELSE {first} END"
        left = f"CASE WHEN {v} >= 0e0 THEN false ELSE {_stepped(name, v, start, rounds)} < {TURN[name]} END"
        root = _safeguarded(name, v, left, rounds, limited)
        if not limited:
            out = f"CASE WHEN {held} THEN {h} ELSE {root} END"
        elif name == "Mish":
            out = f"CASE WHEN {held} THEN {h} WHEN {v} >= {REACH[name]} THEN {REACH[name]} ELSE {root} END"
        else:
            out = f"CASE WHEN abs({v}) < 1e-10 THEN CASE WHEN {known} THEN {h} ELSE -1e1 END WHEN {held} THEN {h} WHEN {v} > {REACH[name]} THEN CASE WHEN {known} THEN {h} ELSE 0e0 END ELSE {root} END"
    limited = f"least(greatest(CAST({hint} AS DOUBLE), -2e1), 2e1)" if name == "Mish" and limited else f"CAST({hint} AS DOUBLE)"
    values = f"named_struct('y', CAST({y} AS DOUBLE), 'h', CASE WHEN {finite(f'CAST({hint} AS DOUBLE)')} THEN {limited} END)"
    return f"(CASE WHEN NOT coalesce({finite(y)}, false) THEN coalesce(CASE WHEN {finite(hint)} THEN CAST({hint} AS DOUBLE) END, 0e0) ELSE {bound(values, 'k', out)} END)"


def iterated_inverse(name: str, y: str = "y", hint: str = "CAST(NULL AS DOUBLE)", rounds: int = 100, limited: bool = True) -> Column:
    return F.expr(iterated_sql(name, y, hint, rounds, limited))


def periodic_sql(name: str, y: str, hint: str) -> str:
    """The solution of sin(x) = y or cos(x) = y that is nearest to the hint (or 0), the first one among equals."""
    h, v = f"(CASE WHEN {finite(hint)} THEN {hint} ELSE 0e0 END)", clamp(y, "-1e0", "1e0")
    turn = f"(sign({h}) * floor(abs({h}) / (2e0 * {PI}) + 5e-1))"
    first, second = (f"asin({v})", f"({PI} - asin({v}))") if name == "SINE" else (f"acos({v})", f"(-acos({v}))")
    all_ = ", ".join(f"{s} + ({turn} + {i}e0) * 2e0 * {PI}" for i in (0, -1, 1) for s in (first, second))
    return f"array_min(transform(array({all_}), (c, i) -> named_struct('d', abs(c - ({h})), 'i', i, 'c', c))).c"


def nearest_periodic(name: str, y: str, hint: str) -> Column:
    return F.expr(periodic_sql(name, y, hint))


def any_inverse_sql(name: str, y: str, hint: str) -> str:
    """The inverse of any activation: closed, periodic or by iteration."""
    if _of(name).inverse:
        return inverse_sql(name, y, hint)
    return periodic_sql(_of(name).name, y, hint) if _of(name).name in PERIODIC else iterated_sql(name, y, hint)


def any_error_sql(name: str, activation: str, target: str, value: str) -> str:
    """error_sql of any activation; the value is the hint of its inverse."""
    return error_sql(name, activation, target, value, None if _of(name).inverse else any_inverse_sql(name, target, value))


def dimension(spark: SparkSession) -> DataFrame:
    """code, name, low and high of every activation."""
    rows = ", ".join(f"({k}, '{a.name}', CAST({a.low} AS DOUBLE), CAST({a.high} AS DOUBLE))" for k, a in enumerate(ACTIVATIONS))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, name, low, high)")
