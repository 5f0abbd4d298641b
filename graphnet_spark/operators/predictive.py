"""Predictive coding: settling latents under clamped inputs and targets, and local gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectorized
from ..functions.activations import ALIASES, slope_sql
from .network import Network

SETTLED = "latents ARRAY<DOUBLE>, predictions ARRAY<DOUBLE>, errors ARRAY<DOUBLE>, energy DOUBLE, steps INT, converged BOOLEAN"


def settle(net: Network, x: np.ndarray, targets: np.ndarray | None, steps: int, rate: float, threshold: float) -> dict[str, np.ndarray]:
    """Latents after at most `steps` steps for each record. Errors stand still within a step; latents change one after another."""
    ni, n, inbound = net.inputs, net.size, net.inbound()
    hidden = [i for i in range(ni, n - net.outputs) if not net.neurons[i - ni].constant]
    latents = np.zeros((len(x), n))
    latents[:, :ni] = x[:, :ni]

    def drive(i: int) -> np.ndarray:
        return net.neurons[i - ni].bias + sum((latents[:, a] * w for a, w, _ in inbound.get(i, ())), np.zeros(len(x)))

    def predict() -> np.ndarray:
        return np.stack([vectorized.apply(net.neurons[i - ni].squash, drive(i)) for i in range(ni, n)], 1)

    for i in range(ni, n):
        latents[:, i] = vectorized.apply(net.neurons[i - ni].squash, drive(i))
    if targets is not None:
        latents[:, n - net.outputs :] = targets
    outward: dict[int, list[tuple[int, float]]] = {}
    for a, b, w, _ in net.edges:
        outward.setdefault(a, []).append((b, w))
    predictions = predict()
    errors = latents[:, ni:] - predictions
    energy = 0.5 * (errors**2).sum(1)
    used, done = np.zeros(len(x), int), np.zeros(len(x), bool)
    for _ in range(steps):
        live = ~done
        used[live] += 1
        done |= energy <= threshold
        live = ~done
        if not live.any():
            break
        for i in hidden:
            pull = -errors[:, i - ni]
            for b, w in outward.get(i, ()):
                pull = pull + errors[:, b - ni] * vectorized.slope(net.neurons[b - ni].squash, drive(b)) * w
            latents[:, i] = np.where(live, latents[:, i] + rate * pull, latents[:, i])
        predictions = np.where(live[:, None], predict(), predictions)
        errors = np.where(live[:, None], latents[:, ni:] - predictions, errors)
        energy = 0.5 * (errors**2).sum(1)
    return {"latents": latents, "predictions": predictions, "errors": errors, "energy": energy, "steps": used, "converged": energy <= threshold}


def infer(net: Network, records: DataFrame, key: str, inputs: str, targets: str | None, steps: int = 20, rate: float = 0.1, threshold: float = 1e-4) -> DataFrame:
    """key and the settled state of every record."""
    given = records.select(key, F.col(inputs).cast("array<double>").alias("x"), (F.col(targets) if targets else F.lit(None)).cast("array<double>").alias("t"))
    schema = f"{key} {records.schema[key].dataType.simpleString()}, {SETTLED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), float)
            t = np.array(batch.column(2).to_pylist(), float) if targets else None
            out = settle(net, x, t, steps, rate, threshold)
            cols = [pa.array(list(out[c]), pa.list_(pa.float64())) for c in ("latents", "predictions", "errors")]
            cols += [pa.array(out["energy"]), pa.array(out["steps"].astype(np.int32)), pa.array(out["converged"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[key, "latents", "predictions", "errors", "energy", "steps", "converged"])

    return given.mapInArrow(run, schema)


def gradients(connections: DataFrame, rate: float) -> DataFrame:
    """connections with bias_delta and weight_delta: rate * slope * error, and that times the source's latent.

    connections has squash (one name for all rows of a call is not needed), pre (pre-activation), error and source.
    """
    slope_ = F.expr("CASE squash " + " ".join(f"WHEN '{n}' THEN {slope_sql(n, 'pre')}" for n in ALIASES) + " ELSE 0e0 END")
    d = connections.withColumn("bias_delta", rate * slope_ * F.col("error"))
    return d.withColumn("weight_delta", F.col("bias_delta") * F.col("source"))
