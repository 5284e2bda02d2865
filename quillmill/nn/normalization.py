"""Normalisation layers: a group of axes is centred and scaled, then a learned scale and shift."""

from __future__ import annotations

import numpy as np

from quillmill.errors import InvalidParameter
from quillmill.nn.layer import F32, Layer, width


def _normalize(x: np.ndarray, axes: tuple[int, ...], eps: float):
    mean = x.mean(axes, keepdims=True, dtype=np.float64).astype(width(x))
    var = x.var(axes, keepdims=True, dtype=np.float64).astype(width(x))
    inv = 1 / np.sqrt(var + width(x)(eps))
    return (x - mean) * inv, inv, mean, var


def _normalize_back(g: np.ndarray, xhat: np.ndarray, inv: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return inv * (g - g.mean(axes, keepdims=True) - xhat * (g * xhat).mean(axes, keepdims=True))


def _positive(eps: float) -> float:
    if not eps > 0:
        raise InvalidParameter("epsilon must be positive")
    return eps


class BatchNormalization(Layer):
    """Per channel over batch and space; predict uses running statistics."""

    def __init__(self, input_shape: tuple[int, ...], momentum: float = 0.99, epsilon: float = 1e-3):
        super().__init__()
        if not 0 <= momentum <= 1:
            raise InvalidParameter("momentum must be 0 to 1")
        c = input_shape[-1]
        self.momentum, self.epsilon = F32(momentum), _positive(epsilon)
        self.params = {"gamma": np.ones(c, F32), "beta": np.zeros(c, F32)}
        self.running_mean, self.running_var = np.zeros(c, F32), np.ones(c, F32)

    def state(self) -> dict[str, np.ndarray]:
        return self.params | {"running_mean": self.running_mean, "running_var": self.running_var}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if not training:
            return ((x - self.running_mean) / np.sqrt(self.running_var + width(x)(self.epsilon)) * self.params["gamma"] + self.params["beta"]).astype(width(x))
        axes = tuple(range(x.ndim - 1))
        xhat, inv, mean, var = _normalize(x, axes, self.epsilon)
        m = self.momentum
        self.running_mean = m * self.running_mean + (1 - m) * mean.ravel()
        self.running_var = m * self.running_var + (1 - m) * var.ravel()
        self._kept = xhat, inv, axes
        return xhat * self.params["gamma"] + self.params["beta"]

    def backward(self, g: np.ndarray) -> np.ndarray:
        xhat, inv, axes = self._back()
        self.grads = {"gamma": (g * xhat).sum(axes), "beta": g.sum(axes)}
        return _normalize_back(g * self.params["gamma"], xhat, inv, axes)


class LayerNormalization(Layer):
    """Per sample over the last axis, one axis, or several (axes count from 1)."""

    def __init__(self, input_shape: tuple[int, ...], epsilon: float = 1e-3, axis: int | tuple[int, ...] | None = None):
        super().__init__()
        self.epsilon = _positive(epsilon)
        d = len(input_shape)
        self.axes = (d,) if axis is None else (axis,) if isinstance(axis, int) else tuple(axis)
        if not self.axes or any(not 1 <= a <= d for a in self.axes):
            raise InvalidParameter("an axis doesn't exist")
        shape = tuple(n if i + 1 in self.axes else 1 for i, n in enumerate(input_shape))
        self.params = {"gamma": np.ones(shape, F32), "beta": np.zeros(shape, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        xhat, inv, _, _ = _normalize(x, self.axes, self.epsilon)
        if training:
            self._kept = xhat, inv
        return xhat * self.params["gamma"] + self.params["beta"]

    def backward(self, g: np.ndarray) -> np.ndarray:
        xhat, inv = self._back()
        rest = tuple(i for i in range(g.ndim) if i == 0 or i not in self.axes)
        total = lambda v: v.sum(rest, keepdims=True)[0]
        self.grads = {"gamma": total(g * xhat), "beta": total(g)}
        return _normalize_back(g * self.params["gamma"], xhat, inv, self.axes)


class GroupNormalization(Layer):
    """Per sample and group of neighbouring channels."""

    def __init__(self, input_shape: tuple[int, ...], num_groups: int, epsilon: float = 1e-3):
        super().__init__()
        c = input_shape[-1]
        if num_groups < 1 or c % num_groups:
            raise InvalidParameter("the groups must divide the channels")
        self.groups, self.epsilon = num_groups, _positive(epsilon)
        self.params = {"gamma": np.ones(c, F32), "beta": np.zeros(c, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        split = x.reshape(len(x), -1, self.groups, x.shape[-1] // self.groups)
        xhat, inv, _, _ = _normalize(split, (1, 3), self.epsilon)
        if training:
            self._kept = xhat, inv
        return xhat.reshape(x.shape) * self.params["gamma"] + self.params["beta"]

    def backward(self, g: np.ndarray) -> np.ndarray:
        xhat, inv = self._back()
        axes = tuple(range(g.ndim - 1))
        self.grads = {"gamma": (g * xhat.reshape(g.shape)).sum(axes), "beta": g.sum(axes)}
        return _normalize_back((g * self.params["gamma"]).reshape(xhat.shape), xhat, inv, (1, 3)).reshape(g.shape)


class InstanceNormalization(GroupNormalization):
    """Per sample and channel."""

    def __init__(self, input_shape: tuple[int, ...], epsilon: float = 1e-3):
        super().__init__(input_shape, input_shape[-1], epsilon)


class UnitNormalization(Layer):
    """Length 1 over the axes (the last if none is named; they count from 1), scale at most 1e12."""

    def __init__(self, axis: int | tuple[int, ...] | None = None):
        super().__init__()
        self.axis = axis

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        axes = (x.ndim - 1,) if self.axis is None else (self.axis,) if isinstance(self.axis, int) else tuple(self.axis)
        square = (x * x).sum(axes, keepdims=True)
        scale = np.minimum(1 / np.sqrt(np.maximum(square, 1e-38)), width(x)(1e12)).astype(width(x))
        if training:
            self._kept = x, scale, axes
        return x * scale

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, scale, axes = self._back()
        free = scale < 1e12
        y = x * scale
        return scale * (g - np.where(free, y * (g * y).sum(axes, keepdims=True), F32(0)))


__all__ = ["BatchNormalization", "GroupNormalization", "InstanceNormalization", "LayerNormalization", "UnitNormalization"]
