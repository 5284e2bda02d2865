"""Windowed and global pooling, channels last."""

from __future__ import annotations

from itertools import product

import numpy as np

from quillmill.nn.convolution import _tuple, borders
from quillmill.nn.layer import F32, Layer, width


def _stack(x: np.ndarray, pool, strides, padding: str, fill: float):
    """Values of every window: (places, batch, out..., channels)."""
    pads, out = borders(x.shape[1:-1], pool, strides, padding)
    padded = np.pad(x, [(0, 0), *pads, (0, 0)], constant_values=fill)
    at = [(slice(None), *(slice(a, a + s * (m - 1) + 1, s) for a, s, m in zip(p, strides, out, strict=True))) for p in product(*map(range, pool))]
    return np.stack([padded[s] for s in at]), at, pads, padded.shape


def windowed_pool_forward(x, pool, strides, kind: str, padding: str = "valid"):
    """Output, and for max the place in the window of the first greatest (NaN wins). Of zeros of either sign the output is the last, as SQL's."""
    if kind == "max":
        v = _stack(x, pool, strides, padding, -np.inf)[0]
        first = np.where(np.isnan(v).any(0), np.isnan(v).argmax(0), v.argmax(0))
        y = np.take_along_axis(v, first[None], 0)[0]
        zero = y == 0
        if zero.any():
            y[zero] = np.take_along_axis(v, len(v) - 1 - v[::-1].argmax(0)[None], 0)[0][zero]
        return y.astype(width(x)), first
    v = _stack(x, pool, strides, padding, 0.0)[0]
    n = _stack(np.ones_like(x[:1, ..., :1]), pool, strides, padding, 0.0)[0].sum(0)
    return (v.sum(0) / n).astype(width(x)), None


def windowed_pool_backward(g, shape, pool, strides, kind: str, argmax=None, padding: str = "valid"):
    _, at, pads, padded = _stack(np.zeros(shape, F32), pool, strides, padding, 0.0)
    dx = np.zeros(padded, F32)
    if kind != "max":
        g = g / _stack(np.ones((1, *shape[1:-1], 1), F32), pool, strides, padding, 0.0)[0].sum(0)
    for i, s in enumerate(at):
        dx[s] += np.where(argmax == i, g, F32(0)) if kind == "max" else g
    return dx[(slice(None), *(slice(a, a + n) for (a, _), n in zip(pads, shape[1:-1], strict=True)))]


class _Pool(Layer):
    dims, kind = 1, "max"

    def __init__(self, pool_size, input_shape: tuple[int, ...] | None = None, strides=None, padding: str = "valid"):
        super().__init__()
        self.pool = _tuple(pool_size, self.dims)
        self.strides, self.padding = _tuple(strides or self.pool, self.dims), padding
        if input_shape is not None:
            borders(tuple(input_shape)[: self.dims], self.pool, self.strides, padding)

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        y, first = windowed_pool_forward(x, self.pool, self.strides, self.kind, self.padding)
        if training:
            self._kept = x.shape, first
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        shape, first = self._back()
        return windowed_pool_backward(g, shape, self.pool, self.strides, self.kind, first, self.padding)


def global_pool_forward(x, kind: str):
    flat = x.reshape(len(x), -1, x.shape[-1])
    if kind == "max":
        first = np.where(np.isnan(flat).any(1), np.isnan(flat).argmax(1), flat.argmax(1))
        return np.take_along_axis(flat, first[:, None], 1)[:, 0], first
    return flat.mean(1, dtype=width(x)), None


def global_pool_backward(g, shape, kind: str, argmax=None):
    n = int(np.prod(shape[1:-1]))
    if kind == "max":
        out = np.zeros((shape[0], n, shape[-1]), F32)
        np.put_along_axis(out, argmax[:, None], g[:, None], 1)
    else:
        out = np.repeat(g[:, None] / F32(n), n, 1)
    return out.reshape(shape)


class _GlobalPool(Layer):
    kind = "max"

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        y, first = global_pool_forward(x, self.kind)
        if training:
            self._kept = x.shape, first
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        shape, first = self._back()
        return global_pool_backward(g, shape, self.kind, first)


def _made(base: type, name: str, **more) -> type:
    return type(name, (base,), more | {"__module__": __name__})


MaxPooling1D, MaxPooling2D, MaxPooling3D = (_made(_Pool, f"MaxPooling{d}D", dims=d, kind="max") for d in (1, 2, 3))
AveragePooling1D, AveragePooling2D, AveragePooling3D = (_made(_Pool, f"AveragePooling{d}D", dims=d, kind="average") for d in (1, 2, 3))
GlobalMaxPooling1D, GlobalMaxPooling2D, GlobalMaxPooling3D = (_made(_GlobalPool, f"GlobalMaxPooling{d}D", kind="max") for d in (1, 2, 3))
GlobalAveragePooling1D, GlobalAveragePooling2D, GlobalAveragePooling3D = (_made(_GlobalPool, f"GlobalAveragePooling{d}D", kind="average") for d in (1, 2, 3))
__all__ = [n for n in globals() if "Pooling" in n or n.startswith(("windowed_", "global_"))]
