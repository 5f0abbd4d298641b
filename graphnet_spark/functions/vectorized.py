"""The activations over numpy arrays, for plans that evaluate whole record batches at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .activations import ACTIVATIONS, ALIASES

_sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
_soft = lambda x: np.where(x > 30, x, np.log1p(np.exp(np.minimum(x, 30))))
_norm = lambda x: np.tanh(0.7978845608028654 * (x + 0.044715 * x**3))
_far = lambda x: np.where(x >= 36, 9007199254740992.0, np.exp(np.minimum(x, 36)))
_inv = lambda x: np.where(np.abs(x) < 1e-10, np.where(x < 0, -1e10, 1e10), 1 / np.where(x == 0, 1, x))
_exp = lambda x: np.exp(np.minimum(x, 700))
SOFT = 0.9899999499320984
FORWARD = {
    "IDENTITY": lambda x: x,
    "RELU": lambda x: np.where(x > 0, x, 0.0),
    "ReLU6": lambda x: np.clip(x, 0, 6),
    "LeakyReLU": lambda x: np.where(x >= 0, x, 0.01 * x),
    "SELU": lambda x: 1.050701 * np.where(x > 0, x, 1.6732632 * (_exp(np.minimum(x, 0)) - 1)),
    "ELU": lambda x: np.where(x > 0, x, _exp(np.minimum(x, 0)) - 1),
    "LOGISTIC": _sig,
    "TANH": np.tanh,
    "HARD_TANH": lambda x: np.clip(x, -1, 1),
    "SOFTSIGN": lambda x: np.clip(x / (1 + np.abs(x)), -SOFT, SOFT),
    "Softplus": lambda x: np.where(x >= 709, 100.0, _soft(x)),
    "Swish": lambda x: x * _sig(x),
    "Mish": lambda x: x * np.tanh(_soft(x)),
    "GELU": lambda x: 0.5 * x * (1 + _norm(x)),
    "SINE": np.sin,
    "Cosine": np.cos,
    "TAN": lambda x: np.clip(np.tan(x), -1000, 1000),
    "ArcTan": np.arctan,
    "GAUSSIAN": lambda x: np.exp(-(x * x)),
    "BENT_IDENTITY": lambda x: (np.sqrt(x * x + 1) - 1) / 2 + x,
    "BIPOLAR_SIGMOID": lambda x: 2 * _sig(x) - 1,
    "BIPOLAR": lambda x: np.where(x > 0, 1.0, -1.0),
    "STEP": lambda x: np.where(x > 0, 1.0, 0.0),
    "COMPLEMENT": lambda x: 1 - x,
    "ABSOLUTE": np.abs,
    "SQUARE": lambda x: np.minimum(x * x, 1e6),
    "Cube": lambda x: np.clip(x**3, -1e6, 1e6),
    "SQRT": lambda x: np.sqrt(np.maximum(x, 0)),
    "StdInverse": _inv,
    "Exponential": _far,
    "LogSigmoid": lambda x: np.where(x <= -709, -(2.0**53), -_soft(-x)),
    "ISRU": lambda x: x / np.sqrt(1 + x * x),
    "HYPOT": np.abs,
    "HYPOTv2": np.abs,
}

_one = lambda x: np.ones_like(x)
_none = lambda x: np.zeros_like(x)
_between = lambda x, low, high: np.where((x > low) & (x < high), 1.0, 0.0)
SLOPE = {
    "IDENTITY": _one,
    "RELU": lambda x: np.where(x > 0, 1.0, 0.0),
    "ReLU6": lambda x: _between(x, 0, 6),
    "LeakyReLU": lambda x: np.where(x >= 0, 1.0, 0.01),
    "SELU": lambda x: 1.050701 * np.where(x >= 0, 1.0, 1.6732632 * _exp(np.minimum(x, 0))),
    "ELU": lambda x: np.where(x > 0, 1.0, _exp(np.minimum(x, 0))),
    "LOGISTIC": lambda x: _sig(x) * (1 - _sig(x)),
    "TANH": lambda x: 1 - np.tanh(x) ** 2,
    "HARD_TANH": lambda x: _between(x, -1, 1),
    "SOFTSIGN": lambda x: (1 + np.abs(x)) ** -2.0,
    "Softplus": _sig,
    "Swish": lambda x: _sig(x) * (1 + x * (1 - _sig(x))),
    "Mish": lambda x: np.maximum(0, np.tanh(_soft(x)) + x * _sig(x) * (1 - np.tanh(_soft(x)) ** 2)),
    "GELU": lambda x: 0.5 * (1 + _norm(x)) + 0.5 * x * (1 - _norm(x) ** 2) * 0.7978845608028654 * (1 + 0.134145 * x * x),
    "SINE": np.cos,
    "Cosine": lambda x: -np.sin(x),
    "TAN": lambda x: np.minimum(1 + np.tan(x) ** 2, 1000),
    "ArcTan": lambda x: 1 / (1 + x * x),
    "GAUSSIAN": lambda x: -2 * x * np.exp(-(x * x)),
    "BENT_IDENTITY": lambda x: x / (2 * np.sqrt(x * x + 1)) + 1,
    "BIPOLAR_SIGMOID": lambda x: (1 - (2 * _sig(x) - 1) ** 2) / 2,
    "STEP": lambda x: np.where(np.abs(x) < 0.01, 0.01, 0.0),
    "COMPLEMENT": lambda x: -np.ones_like(x),
    "ABSOLUTE": np.sign,
    "SQUARE": lambda x: 2 * x,
    "Cube": lambda x: 3 * x * x,
    "SQRT": lambda x: np.where(x > 0, 1 / (2 * np.sqrt(np.maximum(x, 1e-300))), 0.0),
    "StdInverse": lambda x: -np.sign(x) / (1 + np.abs(x)) ** 2,
    "Exponential": lambda x: np.minimum(np.where(x > 10, 50.0, _exp(np.minimum(x, 10))), 50),
    "LogSigmoid": lambda x: np.clip(1 - _sig(x), 1e-6, 1),
    "ISRU": lambda x: (1 + x * x) ** -1.5,
}


def slope(name: str, x: np.ndarray) -> np.ndarray:
    """The derivative; 0 for the kinds that have none."""
    return SLOPE.get(ACTIVATIONS[ALIASES[name]].name, _none)(x)


@lru_cache
def bounds(name: str) -> tuple[float, float]:
    a = ACTIVATIONS[ALIASES[name]]
    value = lambda text: float(np.prod([float(p) for p in text.split(" / ")[0].split(" * ")])) / (float(text.split(" / ")[1]) if " / " in text else 1.0)
    return value(a.low), value(a.high)


def apply(name: str, x: np.ndarray) -> np.ndarray:
    """The activation without its range; aggregate kinds pass a plain value through."""
    return FORWARD.get(ACTIVATIONS[ALIASES[name]].name, lambda v: v)(x)


def limit(name: str, x: np.ndarray) -> np.ndarray:
    low, high = bounds(name)
    if not np.isfinite(x.sum()):  # one pass tells that there is no NaN
        x = np.where(np.isnan(x), 0.0, x)
    return np.clip(x, low, high)
