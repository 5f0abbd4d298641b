"""Losses of outputs against targets: a column per record, added up by ordinary aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-15


def _sum(targets: Column, outputs: Column, each) -> Column:
    return F.aggregate(F.zip_with(targets, outputs, each), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))


def _mean(targets: Column, outputs: Column, each) -> Column:
    return F.when(F.size(targets) > 0, _sum(targets, outputs, each) / F.size(targets)).otherwise(0.0)


def mse(t: Column, o: Column) -> Column:
    return _mean(t, o, lambda a, b: (a - b) * (a - b))


def mae(t: Column, o: Column) -> Column:
    return _mean(t, o, lambda a, b: F.abs(a - b))


def cross_entropy(t: Column, o: Column) -> Column:
    def each(a: Column, b: Column) -> Column:
        b = F.least(F.greatest(b, F.lit(EPS)), F.lit(1 - EPS))
        return -(a * F.ln(b) + (1 - a) * F.ln(1 - b))

    return _mean(t, o, each)


def mape(t: Column, o: Column) -> Column:
    """Targets below a tiny positive number, negative ones too, count as that number."""
    return _mean(t, o, lambda a, b: F.abs((b - F.greatest(a, F.lit(EPS))) / F.greatest(a, F.lit(EPS))))


def log_difference(t: Column, o: Column) -> Column:
    """A signed difference of logarithms, neither squared nor averaged."""
    return _sum(t, o, lambda a, b: F.ln(F.greatest(a, F.lit(EPS))) - F.ln(F.greatest(b, F.lit(EPS))))


def hinge(t: Column, o: Column) -> Column:
    """Not averaged over outputs."""
    return _sum(t, o, lambda a, b: F.greatest(F.lit(0.0), 1 - a * b))


def categorical(t: Column, o: Column) -> Column:
    """1 if the first largest target and the first largest output are at different places."""
    return (F.array_position(t, F.array_max(t)) != F.array_position(o, F.array_max(o))).cast("double")


LOSSES = {"mse": mse, "mae": mae, "xent": cross_entropy, "mape": mape, "logdiff": log_difference, "hinge": hinge, "categorical": categorical}
