"""Activations as functions of the input with gradients from the output, and as layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.errors import InvalidParameter
from quillmill.nn.layer import F32, Layer, width

# fixed values: SELU's alpha and scale
SELU_ALPHA, SELU_SCALE = 1.6732632, 1.050701


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e)).astype(width(x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Activation:
    """A named activation; slope of leaky_relu, alpha of elu."""

    def __init__(self, name: str = "linear", slope: float = 0.3, alpha: float = 1.0):
        for k, v in (("slope", slope), ("alpha", alpha)):
            if not 0 < v < float("inf"):
                raise InvalidParameter(f"{k} must be positive")
        self.name, self.slope, self.alpha = name, slope, alpha
        if name not in _FORWARD:
            raise InvalidParameter(f"no activation {name}")

    @classmethod
    def of(cls, x: str | Activation | None) -> Activation:
        return x if isinstance(x, Activation) else cls(x or "linear")

    def forward(self, z: np.ndarray) -> np.ndarray:
        return _FORWARD[self.name](self, z).astype(width(z), copy=False)

    def backward(self, y: np.ndarray, g: np.ndarray) -> np.ndarray:
        """From the activated output."""
        if self.name == "softmax":
            return y * (g - (g * y).sum(-1, keepdims=True))
        return (g * _SLOPE[self.name](self, y)).astype(F32, copy=False)

    def column(self, x: Column) -> Column:
        """The same on a column of numbers."""
        return _COLUMN[self.name](self, x)


_FORWARD: dict[str, Callable] = {
    "linear": lambda s, z: z,
    "relu": lambda s, z: np.where(z <= 0, F32(0), z),
    "sigmoid": lambda s, z: _sigmoid(z),
    "tanh": lambda s, z: np.tanh(z),
    "softmax": lambda s, z: _softmax(z),
    "leaky_relu": lambda s, z: np.where(z >= 0, z, width(z)(s.slope) * z),
    "elu": lambda s, z: np.where(z > 0, z, width(z)(s.alpha) * np.expm1(np.minimum(z, 0))),
    "selu": lambda s, z: width(z)(SELU_SCALE) * np.where(z > 0, z, width(z)(SELU_ALPHA) * np.expm1(np.minimum(z, 0))),
    "softplus": lambda s, z: np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))),
    "softsign": lambda s, z: z / (1 + np.abs(z)),
    "hard_sigmoid": lambda s, z: np.clip(z + 3, 0, 6) / 6,
    "exponential": lambda s, z: np.exp(z),
}
_SLOPE: dict[str, Callable] = {
    "linear": lambda s, y: 1.0,
    "relu": lambda s, y: (y > 0).astype(F32),
    "sigmoid": lambda s, y: y * (1 - y),
    "tanh": lambda s, y: 1 - y * y,
    "leaky_relu": lambda s, y: np.where(y >= 0, F32(1), F32(s.slope)),
    "elu": lambda s, y: np.where(y > 0, F32(1), y + F32(s.alpha)),
    "selu": lambda s, y: np.where(y > 0, F32(SELU_SCALE), y + F32(SELU_SCALE * SELU_ALPHA)),
    "softplus": lambda s, y: -np.expm1(-y),
    "softsign": lambda s, y: (1 - np.abs(y)) ** 2,
    "hard_sigmoid": lambda s, y: np.where((y > 0) & (y < 1), F32(1 / 6), F32(0)),
    "exponential": lambda s, y: y,
}
_COLUMN: dict[str, Callable] = {
    "linear": lambda s, x: x,
    "relu": lambda s, x: F.when(x <= 0, 0.0).otherwise(x),
    "sigmoid": lambda s, x: 1 / (1 + F.exp(-x)),
    "tanh": lambda s, x: F.tanh(x),
    "leaky_relu": lambda s, x: F.when(x >= 0, x).otherwise(x * s.slope),
    "elu": lambda s, x: F.when(x > 0, x).otherwise(F.expm1(x) * s.alpha),
    "selu": lambda s, x: F.when(x > 0, x).otherwise(F.expm1(x) * SELU_ALPHA) * SELU_SCALE,
    "softplus": lambda s, x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    "softsign": lambda s, x: x / (1 + F.abs(x)),
    "hard_sigmoid": lambda s, x: F.greatest(F.lit(0.0), F.least(F.lit(6.0), x + 3)) / 6,
    "exponential": lambda s, x: F.exp(x),
}


class ActivationLayer(Layer):
    def __init__(self, activation: str | Activation):
        super().__init__()
        self.activation = Activation.of(activation)

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        y = self.activation.forward(x)
        if training:
            self._kept = y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        return self.activation.backward(self._back(), g)


def _layer(name: str, activation: str):
    def init(self):
        ActivationLayer.__init__(self, activation)

    return type(name, (ActivationLayer,), {"__init__": init, "__module__": __name__})


Linear = _layer("Linear", "linear")
ReLU = _layer("ReLU", "relu")
Sigmoid = _layer("Sigmoid", "sigmoid")
Tanh = _layer("Tanh", "tanh")
Softmax = _layer("Softmax", "softmax")
SELU = _layer("SELU", "selu")
Softplus = _layer("Softplus", "softplus")
Softsign = _layer("Softsign", "softsign")
HardSigmoid = _layer("HardSigmoid", "hard_sigmoid")
Exponential = _layer("Exponential", "exponential")


class LeakyReLU(ActivationLayer):
    def __init__(self, negative_slope: float = 0.3):
        super().__init__(Activation("leaky_relu", slope=negative_slope))


class ELU(ActivationLayer):
    def __init__(self, alpha: float = 1.0):
        super().__init__(Activation("elu", alpha=alpha))


class PReLU(Layer):
    """A learned slope per position of the input; shared_axes (from 1) have one slope."""

    def __init__(self, input_shape: tuple[int, ...], alpha: float = 0.25, shared_axes: tuple[int, ...] = ()):
        super().__init__()
        shape = tuple(1 if i + 1 in shared_axes else n for i, n in enumerate(input_shape))
        self.params = {"alpha": np.full(shape, alpha, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if training:
            self._kept = x
        return np.where(x > 0, x, self.params["alpha"] * x).astype(width(x), copy=False)

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, a = self._back(), self.params["alpha"]
        da = (g * np.where(x < 0, x, F32(0))).sum(0)
        axes = tuple(i for i, n in enumerate(a.shape) if n == 1 and da.shape[i] != 1)
        self.grads = {"alpha": da.sum(axes, keepdims=True) if axes else da}
        return g * np.where(x > 0, F32(1), np.where(x < 0, a, F32(0)))


__all__ = ["ELU", "SELU", "Activation", "ActivationLayer", "Exponential", "HardSigmoid", "LeakyReLU", "Linear", "PReLU", "ReLU", "Sigmoid", "Softmax", "Softplus", "Softsign", "Tanh"]
