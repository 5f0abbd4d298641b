"""The verbs as SQL functions of a session: over scalars, and over the arrays of a neuron's links or a net's values."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import distribution
from . import activations as A

PREFIX = "net_"


def bodies() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, result type, body). Codes number the activations; one that is not known means IDENTITY."""
    bounds = lambda side: A.by_code("code", lambda n: f"CAST({getattr(A.ACTIVATIONS[A.CODES[n]], side)} AS DOUBLE)")
    valid = lambda n: f"({A.finite('x')} AND x >= {A.ACTIVATIONS[A.CODES[n]].low} AND x <= {A.ACTIVATIONS[A.CODES[n]].high})"
    return {
        "squash": ("code BIGINT, x DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.forward_sql(n, "x"))),
        "derivative": ("code BIGINT, x DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.slope_sql(n, "x"))),
        "unsquash": ("code BIGINT, y DOUBLE, hint DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.any_inverse_sql(n, "y", "hint"))),
        "safe_zone": ("code BIGINT, x DOUBLE, error DOUBLE, weight DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.safe_sql(n, "x", "error", "weight"))),
        "calculate_error": ("code BIGINT, activation DOUBLE, target DOUBLE, value DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.any_error_sql(n, "activation", "target", "value"))),
        "limit_range": ("code BIGINT, x DOUBLE", "DOUBLE", A.by_code("code", lambda n: A.limit_sql(n, "x"))),
        "validate_range": ("code BIGINT, x DOUBLE", "BOOLEAN", A.by_code("code", valid)),
        "range_low": ("code BIGINT", "DOUBLE", bounds("low")),
        "range_high": ("code BIGINT", "DOUBLE", bounds("high")),
    }


def shares(error: str, scores: str) -> str:
    """error split by an array of scores; what rounding leaves goes to the highest score, the first among equals."""
    total = lambda xs: f"aggregate({xs}, 0D, (a, b) -> a + b)"
    split = f"transform(v.s, b -> v.e * (b / {total('v.s')}))"
    best = "array_position(v.s, array_max(v.s))"
    with_rest = f"transform(r.x, (x, i) -> x + CASE WHEN i + 1 = {best} AND abs(v.e - {total('r.x')}) > {distribution.PLANK!r}D THEN v.e - {total('r.x')} ELSE 0D END)"
    return A.bound(f"named_struct('e', {error}, 's', {scores})", "v", A.bound(f"named_struct('x', {split})", "r", with_rest))


def elastic_shares(error: str, activations: str, safes: str, weights: str) -> str:
    """Shares of an error: by activation squared times the safe factor, else by weight squared, else equal ones."""
    plank, total = f"{distribution.PLANK!r}D", lambda xs: f"aggregate({xs}, 0D, (a, b) -> a + b)"
    scores = f"zip_with({activations}, {safes}, (a, f) -> CASE WHEN {A.finite('a')} AND {A.finite('f')} THEN a * a * least(greatest(f, 0D), 1D) ELSE 0D END)"
    heavy = f"transform({weights}, w -> CASE WHEN {A.finite('w')} THEN w * w ELSE 0D END)"
    split = f"CASE WHEN {total('t.s')} > {plank} THEN {shares('t.e', 't.s')} WHEN {total('t.h')} > {plank} THEN {shares('t.e', 't.h')} ELSE transform(t.s, x -> t.e / size(t.s)) END"
    return A.bound(f"named_struct('e', {error}, 's', {scores}, 'h', {heavy})", "t", f"CASE WHEN size(t.s) = 0 THEN t.s WHEN NOT {A.finite('t.e')} THEN transform(t.s, x -> 0D) ELSE {split} END")


def fused(error: str) -> str:
    """The error, the safe factor of each link and its share, in one array; an error of 0 has factors 1 and shares 0."""
    links = "transform(sequence(0, size(weights) - 1), i -> named_struct('c', upstream_codes[i], 'x', upstream_hints[i], 'w', CASE WHEN abs(weights[i]) <= 1.7976931348623157e308 THEN weights[i] ELSE 1D END))"
    factors = f"transform({links}, l -> {A.by_code('l.c', lambda n: A.safe_sql(n, 'l.x', '(q.e / size(weights))', 'l.w'))})"
    both = A.bound(f"named_struct('f', {factors})", "g", f"concat(array(q.e), g.f, {elastic_shares('q.e', 'activations', 'g.f', 'weights')})")
    nothing = "concat(array(q.e), transform(weights, w -> 1D), transform(weights, w -> 0D))"
    return A.bound(f"named_struct('e', {error})", "q", f"CASE WHEN size(weights) = 0 THEN array(q.e) WHEN q.e = 0D THEN {nothing} ELSE {both} END")


def top_two(magnitudes: str) -> str:
    """The two largest of an array of magnitudes, equal ones counted twice; 0 where there are none. NaN is never larger."""
    return A.bound(f"sort_array(filter({magnitudes}, x -> NOT isnan(x)), false)", "m", "named_struct('largest', coalesce(get(m, 0), 0D), 'second', coalesce(get(m, 1), 0D))")


def scan(own: str, other: str) -> str:
    """The two largest magnitudes once the value at a place (from 0) of the own array is replaced."""
    kept = f"filter({own}, (x, i) -> i <> exclude OR exclude IS NULL)"
    return top_two(f"transform(concat({kept}, {other}, array(new)), x -> abs(x))")


def table_bodies() -> dict[str, tuple[str, str, str]]:
    """Verbs over arrays: the links of a neuron, the weights and biases of a net."""
    ints, doubles, pair = "ARRAY<BIGINT>", "ARRAY<DOUBLE>", "STRUCT<largest: DOUBLE, second: DOUBLE>"
    both = "transform(concat(weights, biases), x -> abs(x))"
    components = A.bound(f"named_struct('m', {both})", "c", f"named_struct('total', aggregate(c.m, 0D, (a, b) -> a + b), 'count', CAST(size(c.m) AS BIGINT), 'largest', {top_two('c.m')}.largest, 'second', {top_two('c.m')}.second)")
    error = A.by_code("code", lambda n: A.any_error_sql(n, "activation", "target", "hint"))
    scans = f"weights {doubles}, biases {doubles}, exclude BIGINT, new DOUBLE"
    return {
        "elastic_distribution": (f"error DOUBLE, activations {doubles}, safe {doubles}, weights {doubles}", doubles, elastic_shares("error", "activations", "safe", "weights")),
        "fused_error_distribution": (f"code BIGINT, activation DOUBLE, target DOUBLE, hint DOUBLE, upstream_codes {ints}, upstream_hints {doubles}, activations {doubles}, weights {doubles}", doubles, fused(error)),
        "safe_zone_batch": (f"codes {ints}, xs {doubles}, error DOUBLE, weights {doubles}", doubles, f"transform(arrays_zip(codes, xs, weights), l -> {A.by_code('l.codes', lambda n: A.safe_sql(n, 'l.xs', 'error', 'l.weights'))})"),
        "derivative_batch": (f"code BIGINT, xs {doubles}", doubles, f"transform(xs, x -> {A.by_code('code', lambda n: A.slope_sql(n, 'x'))})"),
        "calculate_error_batch": (f"code BIGINT, activations {doubles}, targets {doubles}, vals {doubles}", doubles, f"transform(arrays_zip(activations, targets, vals), l -> {A.by_code('code', lambda n: A.any_error_sql(n, 'l.activations', 'l.targets', 'l.vals'))})"),
        "score_components": (f"weights {doubles}, biases {doubles}", "STRUCT<total: DOUBLE, count: BIGINT, largest: DOUBLE, second: DOUBLE>", components),
        "scan_max_weight": (scans, pair, scan("weights", "biases")),
        "scan_max_bias": (scans, pair, scan("biases", "weights")),
    }


def register(spark: SparkSession) -> list[str]:
    """Creates the functions for this session and returns their names."""
    for name, (parameters, result, body) in (own := bodies() | table_bodies()).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [PREFIX + name for name in own]
