"""Convolutions of one to three axes, channels last: a sum over kernel places of strided slices times a matrix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

from quillmill.errors import InvalidParameter, ShapeMismatch
from quillmill.nn.activations import Activation
from quillmill.nn.layer import F32, Layer, glorot, make_rng, width


def _tuple(v, d: int) -> tuple[int, ...]:
    out = (v,) * d if isinstance(v, int) else tuple(v)
    if len(out) != d or min(out) < 1:
        raise InvalidParameter("sizes and strides must be positive, one for each axis")
    return out


def borders(sizes, kernel, strides, padding: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Padding (before, after) and output size of each axis."""
    if padding not in ("valid", "same"):
        raise InvalidParameter(f"no padding {padding}")
    pads, out = [], []
    for n, k, s in zip(sizes, kernel, strides, strict=True):
        if padding == "valid":
            if n < k:
                raise ShapeMismatch(f"at least {k}", n)
            pads.append((0, 0))
            out.append((n - k) // s + 1)
        else:
            m = -(-n // s)
            need = max(0, (m - 1) * s + k - n)
            pads.append((need // 2, need - need // 2))
            out.append(m)
    return pads, out


def places(kernel, strides, out) -> Iterator[tuple[tuple[int, ...], tuple[slice, ...]]]:
    """Each kernel place with the slice of a padded input that it meets."""
    for at in product(*map(range, kernel)):
        yield at, (slice(None), *(slice(a, a + s * (m - 1) + 1, s) for a, s, m in zip(at, strides, out, strict=True)))


def conv_forward(x, w, b, strides, padding):
    """w: kernel sizes, channels in, filters."""
    d = x.ndim - 2
    pads, out = borders(x.shape[1:-1], w.shape[:d], strides, padding)
    padded = np.pad(x, [(0, 0), *pads, (0, 0)])
    y = np.zeros((len(x), *out, w.shape[-1]), width(x))
    for at, sl in places(w.shape[:d], strides, out):
        y += padded[sl] @ w[at]
    return y + b if b is not None else y


def conv_backward(g, x, w, strides, padding):
    """Gradients of input, weight and bias."""
    d = x.ndim - 2
    pads, out = borders(x.shape[1:-1], w.shape[:d], strides, padding)
    padded = np.pad(x, [(0, 0), *pads, (0, 0)])
    dx, dw = np.zeros_like(padded), np.zeros_like(w)
    flat = g.reshape(-1, g.shape[-1])
    for at, sl in places(w.shape[:d], strides, out):
        dw[at] = padded[sl].reshape(-1, w.shape[-2]).T @ flat
        dx[sl] += g @ w[at].T
    inside = (slice(None), *(slice(a, a + n) for (a, _), n in zip(pads, x.shape[1:-1], strict=True)))
    return dx[inside], dw, flat.sum(0)


class _Conv(Layer):
    dims = 1
    decays = ("weight",)

    def __init__(self, filters: int, kernel_size, input_shape: tuple[int, ...], strides=1, activation: str | Activation | None = None, padding: str = "valid", random_state: int | None = None):
        super().__init__()
        self.kernel, self.strides = _tuple(kernel_size, self.dims), _tuple(strides, self.dims)
        self.input_shape, self.padding, self.activation = tuple(input_shape), padding, Activation.of(activation)
        if filters < 1 or len(self.input_shape) != self.dims + 1:
            raise InvalidParameter("filters must be positive and input_shape have the axes and channels")
        cin, area = self.input_shape[-1], int(np.prod(self.kernel))
        self.params = {"weight": self._initial(make_rng(random_state), filters, cin, area), "bias": np.zeros(filters, F32)}
        self._check_padding()

    def _check_padding(self) -> None:
        borders(self.input_shape[:-1], self.kernel, self.strides, self.padding)

    def _initial(self, rng, filters, cin, area):
        return glorot(rng, (*self.kernel, cin, filters), area * cin, area * filters)

    def _shape(self, x: np.ndarray) -> None:
        if x.ndim != self.dims + 2 or x.shape[-1] != self.input_shape[-1]:
            raise ShapeMismatch(("batch", *self.input_shape), x.shape)

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        self._shape(x)
        y = self.activation.forward(conv_forward(x, self.params["weight"], self.params["bias"], self.strides, self.padding))
        if training:
            self._kept = x, y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, y = self._back()
        dx, dw, db = conv_backward(self.activation.backward(y, g), x, self.params["weight"], self.strides, self.padding)
        self.grads = {"weight": dw, "bias": db}
        return dx


def transpose_geometry(sizes, kernel, strides, padding: str) -> tuple[list[int], list[int], list[int]]:
    """Size of the full scatter, first kept place and kept size of each axis."""
    full = [max((n - 1) * s + k, n * s) for n, k, s in zip(sizes, kernel, strides, strict=True)]
    if padding == "valid":
        return full, [0] * len(full), [n * s + max(k - s, 0) for n, k, s in zip(sizes, kernel, strides, strict=True)]
    return full, [max(k - s, 0) // 2 for k, s in zip(kernel, strides, strict=True)], [n * s for n, s in zip(sizes, strides, strict=True)]


def conv_transpose_forward(x, w, b, strides, padding):
    """w: kernel sizes, filters, channels in."""
    d = x.ndim - 2
    full, first, size = transpose_geometry(x.shape[1:-1], w.shape[:d], strides, padding)
    y = np.zeros((len(x), *full, w.shape[-2]), width(x))
    for at, sl in places(w.shape[:d], strides, x.shape[1:-1]):
        y[sl] += x @ w[at].T
    return y[(slice(None), *(slice(a, a + n) for a, n in zip(first, size, strict=True)))] + b


def conv_transpose_backward(g, x, w, strides, padding):
    d = x.ndim - 2
    full, first, size = transpose_geometry(x.shape[1:-1], w.shape[:d], strides, padding)
    whole = np.zeros((len(x), *full, w.shape[-2]), F32)
    whole[(slice(None), *(slice(a, a + n) for a, n in zip(first, size, strict=True)))] = g
    dx, dw = np.zeros_like(x), np.zeros_like(w)
    flat = x.reshape(-1, x.shape[-1])
    for at, sl in places(w.shape[:d], strides, x.shape[1:-1]):
        dx += whole[sl] @ w[at]
        dw[at] = whole[sl].reshape(-1, w.shape[-2]).T @ flat
    return dx, dw, g.reshape(-1, g.shape[-1]).sum(0)


class _ConvTranspose(_Conv):
    def _check_padding(self) -> None:
        if self.padding not in ("valid", "same"):
            raise InvalidParameter(f"no padding {self.padding}")

    def _initial(self, rng, filters, cin, area):
        return glorot(rng, (*self.kernel, filters, cin), area * cin, area * filters)

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        self._shape(x)
        y = self.activation.forward(conv_transpose_forward(x, self.params["weight"], self.params["bias"], self.strides, self.padding))
        if training:
            self._kept = x, y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, y = self._back()
        dx, dw, db = conv_transpose_backward(self.activation.backward(y, g), x, self.params["weight"], self.strides, self.padding)
        self.grads = {"weight": dw, "bias": db}
        return dx


def depthwise_forward(x, w, b, strides, padding):
    """w: kernel sizes, channels, multiplier; output channel c * multiplier + m."""
    d = x.ndim - 2
    pads, out = borders(x.shape[1:-1], w.shape[:d], strides, padding)
    padded = np.pad(x, [(0, 0), *pads, (0, 0)])
    y = np.zeros((len(x), *out, *w.shape[-2:]), width(x))
    for at, sl in places(w.shape[:d], strides, out):
        y += padded[sl][..., None] * w[at]
    y = y.reshape(len(x), *out, -1)
    return y + b if b is not None else y


def depthwise_backward(g, x, w, strides, padding):
    d = x.ndim - 2
    pads, out = borders(x.shape[1:-1], w.shape[:d], strides, padding)
    padded = np.pad(x, [(0, 0), *pads, (0, 0)])
    dx, dw = np.zeros_like(padded), np.zeros_like(w)
    db = g.reshape(-1, g.shape[-1]).sum(0)
    g = g.reshape(*g.shape[:-1], *w.shape[-2:])
    axes = tuple(range(d + 1))
    for at, sl in places(w.shape[:d], strides, out):
        dw[at] = (padded[sl][..., None] * g).sum(axes)
        dx[sl] += (g * w[at]).sum(-1)
    inside = (slice(None), *(slice(a, a + n) for (a, _), n in zip(pads, x.shape[1:-1], strict=True)))
    return dx[inside], dw, db


class _Depthwise(Layer):
    dims = 1
    decays = ("weight",)

    def __init__(self, kernel_size, input_shape: tuple[int, ...], strides=1, activation: str | Activation | None = None, padding: str = "valid", depth_multiplier: int = 1, random_state: int | None = None):
        super().__init__()
        self.kernel, self.strides, self.padding, self.activation = _tuple(kernel_size, self.dims), _tuple(strides, self.dims), padding, Activation.of(activation)
        if depth_multiplier < 1 or len(input_shape) != self.dims + 1:
            raise InvalidParameter("depth_multiplier must be positive and input_shape have the axes and channels")
        borders(input_shape[:-1], self.kernel, self.strides, padding)
        c, area = input_shape[-1], int(np.prod(self.kernel))
        self.params = {"weight": glorot(make_rng(random_state), (*self.kernel, c, depth_multiplier), area * c, area * depth_multiplier), "bias": np.zeros(c * depth_multiplier, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        y = self.activation.forward(depthwise_forward(x, self.params["weight"], self.params["bias"], self.strides, self.padding))
        if training:
            self._kept = x, y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, y = self._back()
        dx, dw, db = depthwise_backward(self.activation.backward(y, g), x, self.params["weight"], self.strides, self.padding)
        self.grads = {"weight": dw, "bias": db}
        return dx


class _Separable(Layer):
    """Depthwise, then a matrix over channels; bias and activation come last."""

    dims = 1
    decays = ("depthwise", "pointwise")

    def __init__(self, filters: int, kernel_size, input_shape: tuple[int, ...], strides=1, depth_multiplier: int = 1, activation: str | Activation | None = None, padding: str = "valid", random_state: int | None = None):
        super().__init__()
        self.kernel, self.strides, self.padding, self.activation = _tuple(kernel_size, self.dims), _tuple(strides, self.dims), padding, Activation.of(activation)
        if filters < 1 or depth_multiplier < 1 or len(input_shape) != self.dims + 1:
            raise InvalidParameter("filters and depth_multiplier must be positive and input_shape have the axes and channels")
        borders(input_shape[:-1], self.kernel, self.strides, padding)
        rng, c, area = make_rng(random_state), input_shape[-1], int(np.prod(self.kernel))
        self.params = {"depthwise": glorot(rng, (*self.kernel, c, depth_multiplier), area * c, area * depth_multiplier), "pointwise": glorot(rng, (c * depth_multiplier, filters), c * depth_multiplier, filters), "bias": np.zeros(filters, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        mid = depthwise_forward(x, self.params["depthwise"], None, self.strides, self.padding)
        y = self.activation.forward(mid @ self.params["pointwise"] + self.params["bias"])
        if training:
            self._kept = x, mid, y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, mid, y = self._back()
        g = self.activation.backward(y, g)
        flat = g.reshape(-1, g.shape[-1])
        dx, dw, _ = depthwise_backward(g @ self.params["pointwise"].T, x, self.params["depthwise"], self.strides, self.padding)
        self.grads = {"depthwise": dw, "pointwise": mid.reshape(-1, mid.shape[-1]).T @ flat, "bias": flat.sum(0)}
        return dx


def _named(base: type, name: str, dims: int) -> type:
    return type(name, (base,), {"dims": dims, "__module__": __name__})


Conv1D, Conv2D, Conv3D = (_named(_Conv, f"Conv{d}D", d) for d in (1, 2, 3))
Conv1DTranspose, Conv2DTranspose, Conv3DTranspose = (_named(_ConvTranspose, f"Conv{d}DTranspose", d) for d in (1, 2, 3))
DepthwiseConv1D, DepthwiseConv2D = (_named(_Depthwise, f"DepthwiseConv{d}D", d) for d in (1, 2))
SeparableConv1D, SeparableConv2D = (_named(_Separable, f"SeparableConv{d}D", d) for d in (1, 2))
__all__ = ["Conv1D", "Conv1DTranspose", "Conv2D", "Conv2DTranspose", "Conv3D", "Conv3DTranspose", "DepthwiseConv1D", "DepthwiseConv2D", "SeparableConv1D", "SeparableConv2D", "conv_backward", "conv_forward", "conv_transpose_backward", "conv_transpose_forward", "depthwise_backward", "depthwise_forward"]
