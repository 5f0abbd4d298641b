"""Packed networks: little-endian headers and records of neurons and edges, as rows of a binary column or file."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.activations import ACTIVATIONS
from ..operators.network import Network, NetworkError, Neuron

#: Fixed formats: neurons and edges of a network, and of a predictive engine.
NEURON = np.dtype([("bias", "<f8"), ("squash", "u1"), ("constant", "u1"), ("edges", "<u2")])
EDGE = np.dtype([("source", "<u2"), ("role", "u1"), ("pad", "u1"), ("weight", "<f8")])
ENGINE_NEURON = np.dtype([("bias", "<f4"), ("squash", "u1"), ("hidden", "u1"), ("edges", "<u2")])
ENGINE_EDGE = np.dtype([("source", "<u2"), ("weight", "<f4")])


def name_of(code: int) -> str:
    return ACTIVATIONS[code].name if code < len(ACTIVATIONS) else "IDENTITY"


def _parts(raw: bytes, at: int, n: int, neuron: np.dtype, edge: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) < at + n * neuron.itemsize:
        raise NetworkError("truncated neurons")
    neurons = np.frombuffer(raw, neuron, n, at)
    at, total = at + n * neuron.itemsize, int(neurons["edges"].sum())
    if len(raw) < at + total * edge.itemsize:
        raise NetworkError("truncated edges")
    return neurons, np.frombuffer(raw, edge, total, at)


def network_from_bytes(raw: bytes, outputs: int) -> Network:
    """A header of the node count and the input count, then neurons, then their edges in neuron order."""
    if len(raw) < 8:
        raise NetworkError("truncated header")
    size, inputs = struct.unpack_from("<II", raw)
    neurons, edges = _parts(raw, 8, size - inputs, NEURON, EDGE)
    targets = np.repeat(np.arange(inputs, size), neurons["edges"])
    links = [(int(e["source"]), int(t), float(e["weight"]), int(e["role"]) if e["role"] < 4 else 0) for e, t in zip(edges, targets, strict=True)]
    return Network(inputs, outputs, [Neuron(float(n["bias"]), name_of(n["squash"]), bool(n["constant"])) for n in neurons], links)


def network_to_bytes(net: Network) -> bytes:
    codes = {a.name: k for k, a in enumerate(ACTIVATIONS)}
    inbound = net.inbound()
    neurons = np.array([(n.bias, codes[n.squash], n.constant, len(inbound.get(net.inputs + k, ()))) for k, n in enumerate(net.neurons)], NEURON)
    edges = np.array([(a, role, 0, w) for i in range(net.inputs, net.size) for a, w, role in inbound.get(i, ())], EDGE)
    return struct.pack("<II", net.size, net.inputs) + neurons.tobytes() + edges.tobytes()


def engine_from_bytes(raw: bytes) -> tuple[Network, dict[str, float]]:
    """A predictive engine: the network, and its steps, rate and threshold."""
    if len(raw) < 24:
        raise NetworkError("truncated header")
    inputs, outputs, size, steps, rate, threshold = struct.unpack_from("<IIIIff", raw)
    neurons, edges = _parts(raw, 24, size - inputs, ENGINE_NEURON, ENGINE_EDGE)
    targets = np.repeat(np.arange(inputs, size), neurons["edges"])
    links = [(int(e["source"]), int(t), float(e["weight"]), 0) for e, t in zip(edges, targets, strict=True)]
    net = Network(inputs, outputs, [Neuron(float(n["bias"]), name_of(n["squash"])) for n in neurons], links)
    return net, {"steps": steps, "rate": rate, "threshold": threshold}
