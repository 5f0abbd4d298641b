"""Training accumulators: per-item deltas, their sums per edge or neuron, and final weights and biases.

Deltas are columns, sums are partial and final aggregates, and the final values are projections over the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.activations import finite

WEIGHT_SUMS = ("count", "pos_act", "neg_act", "count_pos", "count_neg", "pos_adj", "neg_adj")
BIAS_SUMS = ("count", "total_bias", "total_adjusted")


@dataclass(frozen=True)
class Limits:
    """plank: the smallest difference that counts; rate: learning rate; step and scale: limits of a change and of a value."""

    plank: float = 1e-7
    rate: float = 0.1
    step: float = 1.0
    scale: float = 100.0
    l1: float = 0.0
    l2: float = 0.0
    generations: float = 10.0


def weight_deltas(weight: str, target: str, activation: str, plank: float) -> list[Column]:
    """The seven sums' share of one item; all 0 where an input is not finite."""
    p = f"{plank!r}D"
    act = f"(CASE WHEN abs({activation}) < {p} THEN CASE WHEN {activation} < 0 THEN -{p} ELSE {p} END ELSE {activation} END)"
    value = f"(CASE WHEN abs({target}) > {p} THEN {target} ELSE {p} * sign({target}) END)"
    own = f"({value} / {act})"
    ok = f"({finite(weight)} AND {finite(target)} AND {finite(activation)})"
    pos, neg = f"({activation} > {p})", f"({activation} < -{p})"
    parts = ("1D", f"CASE WHEN {pos} THEN {activation} ELSE 0D END", f"CASE WHEN {neg} THEN -({activation}) ELSE 0D END", f"CASE WHEN {pos} THEN 1D ELSE 0D END", f"CASE WHEN {neg} THEN 1D ELSE 0D END", f"CASE WHEN {pos} THEN {own} * {activation} ELSE 0D END", f"CASE WHEN {neg} THEN {own} * {activation} ELSE 0D END")
    return [F.expr(f"CASE WHEN {ok} THEN {part} ELSE 0D END").alias(name) for name, part in zip(WEIGHT_SUMS, parts, strict=True)]


def bias_deltas(target: str, value: str, bias: str) -> list[Column]:
    total = f"({bias} + ({target} - {value}))"
    ok = f"({finite(target)} AND {finite(value)} AND {finite(bias)} AND {finite(total)})"
    return [F.expr(f"CASE WHEN {ok} THEN {part} ELSE 0D END").alias(name) for name, part in zip(BIAS_SUMS, ("1D", total, total), strict=True)]


def summed(items: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    return items.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))


def decayed(v: Column, lim: Limits) -> Column:
    if lim.l2 > 0:
        v = v * (1 - lim.rate * lim.l2)
    if lim.l1 > 0:
        cut = lim.rate * lim.l1
        v = F.when(F.abs(v) <= cut, F.lit(0.0)).otherwise(v - cut * F.signum(v))
    return v


def limited_weight(target: Column, current: Column, lim: Limits) -> Column:
    move = lim.rate * (target - current)
    moved = current + F.greatest(F.lit(-lim.step), F.least(F.lit(lim.step), move))
    near = F.abs(target - current) < lim.plank
    bounded = F.greatest(F.lit(-lim.scale), F.least(F.lit(lim.scale), moved))
    return decayed(F.when(F.abs(target) < lim.plank, F.lit(0.0)).when(near, current).otherwise(bounded), lim)


def limited_bias(target: Column, current: Column, lim: Limits) -> Column:
    """A bias already beyond the scale stays where it is rather than being drawn back."""
    move = lim.rate * (target - current)
    moved = current + F.greatest(F.lit(-lim.step), F.least(F.lit(lim.step), move))
    up = F.when(moved > current, F.greatest(current, F.lit(lim.scale))).otherwise(moved)
    down = F.when(moved < current, F.least(current, F.lit(-lim.scale))).otherwise(moved)
    bounded = F.when(F.abs(moved) < lim.scale, moved).when(moved > 0, up).otherwise(down)
    return decayed(F.when(F.abs(target) < lim.plank, F.lit(0.0)).when(F.abs(target - current) < 1e-9, current).otherwise(bounded), lim)


def final_weight(current: Column, lim: Limits) -> Column:
    """The new weight from the seven sums: both signs' averages by their counts, with inertia of at most twice the count."""
    c = {n: F.col(n) for n in WEIGHT_SUMS}
    pos = F.when(c["pos_act"] > lim.plank, c["pos_adj"] / F.when(c["pos_act"] > lim.plank, c["pos_act"])).otherwise(0.0)
    neg = F.when(c["neg_act"] > lim.plank, -c["neg_adj"] / F.when(c["neg_act"] > lim.plank, c["neg_act"])).otherwise(0.0)
    n = c["count_pos"] + c["count_neg"]
    inertia = F.least(lim.generations + c["count"] - n, n * 2)
    mean = (pos * c["count_pos"] + neg * c["count_neg"] + current * inertia) / F.when(n > 0, n + inertia)
    idle = (c["count"] <= 0) | ((c["pos_act"] <= lim.plank) & (c["neg_act"] <= lim.plank)) | (n <= 0)
    return F.when(idle, current).otherwise(limited_weight(mean, current, lim))


def final_bias(current: Column, lim: Limits, no_change: Column | None = None) -> Column:
    count = F.col("count")
    inertia = F.least(F.lit(lim.generations), count * 2)
    mean = (F.col("total_adjusted") + current * inertia) / F.when(count > 0, count + inertia)
    idle = (count <= 0) if no_change is None else (count <= 0) | no_change
    return F.when(idle, current).otherwise(limited_bias(mean, current, lim))


def magnitude_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """total, count, largest and second of |value| per key; equal values count twice, and an empty or single group has second 0.

    Tasks shuffle their sums and their two largest of each key only: a combinable aggregate, and a rank that the group limit cuts
    before the shuffle. A value's places are never gathered, so a key that holds most rows is no different.
    """
    v = values.select(*keys, F.abs(F.col(value)).alias("v"))
    none = F.lit(None)
    sums = v.groupBy(*keys).agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("count")).withColumns({"v": none.cast("double"), "place": none.cast("int")})
    ranked = v.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v")))).filter("place <= 2")
    top = ranked.select(*keys, none.cast("double").alias("total"), none.cast("long").alias("count"), F.col("v").cast("double").alias("v"), "place")
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("v")))
    both = sums.unionByName(top).groupBy(*keys)
    return both.agg(F.max("total").alias("total"), F.max("count").alias("count"), at(1).alias("largest"), F.coalesce(at(2), F.lit(0.0)).alias("second"))
