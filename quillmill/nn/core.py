"""Dense, embedding and shape layers, borders and upsampling, dropout and noise."""

from __future__ import annotations

import numpy as np

from quillmill.errors import InvalidInput, InvalidParameter, ShapeMismatch
from quillmill.nn.activations import Activation
from quillmill.nn.layer import F32, Layer, glorot, make_rng, width


class Dense(Layer):
    decays = ("weight",)

    def __init__(self, input_dim: int, units: int, activation: str | Activation | None = None, random_state: int | None = None):
        super().__init__()
        if input_dim < 1 or units < 1:
            raise InvalidParameter("dimensions must be positive")
        self.activation = Activation.of(activation)
        self.params = {"weight": glorot(make_rng(random_state), (input_dim, units), input_dim, units), "bias": np.zeros(units, F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if x.ndim != 2 or x.shape[1] != len(self.params["weight"]):
            raise ShapeMismatch(("batch", len(self.params["weight"])), x.shape)
        y = self.activation.forward(x @ self.params["weight"] + self.params["bias"])
        if training:
            self._kept = x, y
        return y

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, y = self._back()
        g = self.activation.backward(y, g)
        self.grads = {"weight": x.T @ g, "bias": g.sum(0)}
        return g @ self.params["weight"].T


class Embedding(Layer):
    decays = ("weight",)

    def __init__(self, input_dim: int, output_dim: int, random_state: int | None = None):
        super().__init__()
        if input_dim < 1 or output_dim < 1:
            raise InvalidParameter("dimensions must be positive")
        self.params = {"weight": make_rng(random_state).uniform(-0.05, 0.05, (input_dim, output_dim)).astype(F32)}

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if np.isnan(x).any() or (x < 0).any() or (x >= len(self.params["weight"])).any():
            raise InvalidInput("an index is out of range")
        at = x.astype(np.int64)
        if training:
            self._kept = at
        return self.params["weight"][at]

    def backward(self, g: np.ndarray) -> np.ndarray:
        at = self._back()
        out = np.zeros_like(self.params["weight"])
        np.add.at(out, at, g)
        self.grads = {"weight": out}
        return np.zeros(at.shape, F32)


class _Shape(Layer):
    """A layer that only moves values: _there maps the input, _home a gradient of its shape."""

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if training:
            self._kept = x.shape
        return self._there(x)

    def backward(self, g: np.ndarray) -> np.ndarray:
        return self._home(g, self._back())


class Identity(_Shape):
    def _there(self, x):
        return x

    def _home(self, g, shape):
        return g


class Flatten(_Shape):
    def __init__(self, input_shape: tuple[int, ...] | None = None):
        super().__init__()

    def _there(self, x):
        return x.reshape(len(x), -1)

    def _home(self, g, shape):
        return g.reshape(shape)


class Reshape(_Shape):
    def __init__(self, target_shape: tuple[int, ...]):
        super().__init__()
        if list(target_shape).count(-1) > 1:
            raise InvalidParameter("one dimension may be -1")
        self.target = tuple(target_shape)

    def _there(self, x):
        return x.reshape(len(x), *self.target)

    def _home(self, g, shape):
        return g.reshape(shape)


class Permute(_Shape):
    """dims count from 1; the batch stays."""

    def __init__(self, dims: tuple[int, ...]):
        super().__init__()
        if sorted(dims) != list(range(1, len(dims) + 1)):
            raise InvalidParameter("dims must name each axis once, from 1")
        self.dims = (0, *dims)

    def _there(self, x):
        return x.transpose(self.dims)

    def _home(self, g, shape):
        return g.transpose(np.argsort(self.dims))


class RepeatVector(_Shape):
    def __init__(self, n: int):
        super().__init__()
        if n < 1:
            raise InvalidParameter("n must be positive")
        self.n = n

    def _there(self, x):
        return np.repeat(x[:, None, :], self.n, 1)

    def _home(self, g, shape):
        return g.sum(1)


def _border(b, dims: int) -> list[tuple[int, int]]:
    """n, one n per axis, or (before, after) per axis."""
    if isinstance(b, int):
        return [(b, b)] * dims
    if dims == 1 and len(b) == 2 and all(isinstance(v, int) for v in b):
        return [tuple(b)]
    out = [(v, v) if isinstance(v, int) else tuple(v) for v in b]
    if len(out) != dims or any(v < 0 for p in out for v in p):
        raise InvalidParameter("a border doesn't fit the axes")
    return out


class _ZeroPadding(_Shape):
    dims = 1

    def __init__(self, padding=1):
        super().__init__()
        self.border = _border(padding, self.dims)

    def _there(self, x):
        return np.pad(x, [(0, 0), *self.border, (0, 0)])

    def _home(self, g, shape):
        return g[(slice(None), *(slice(a, a + n) for (a, _), n in zip(self.border, shape[1:-1], strict=True)))]


class _Cropping(_Shape):
    dims = 1

    def __init__(self, cropping=1):
        super().__init__()
        self.border = _border(cropping, self.dims)

    def _there(self, x):
        if any(a + z >= n for (a, z), n in zip(self.border, x.shape[1:-1], strict=True)):
            raise InvalidInput("nothing is left")
        return x[(slice(None), *(slice(a, n - z) for (a, z), n in zip(self.border, x.shape[1:-1], strict=True)))]

    def _home(self, g, shape):
        return np.pad(g, [(0, 0), *self.border, (0, 0)])


def _named(base: type, name: str, dims: int) -> type:
    return type(name, (base,), {"dims": dims, "__module__": __name__})


ZeroPadding1D, ZeroPadding2D, ZeroPadding3D = (_named(_ZeroPadding, f"ZeroPadding{d}D", d) for d in (1, 2, 3))
Cropping1D, Cropping2D, Cropping3D = (_named(_Cropping, f"Cropping{d}D", d) for d in (1, 2, 3))


def _cubic(x: np.ndarray) -> np.ndarray:
    a, x = -0.5, np.abs(x)
    return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))


def resize_matrix(n: int, factor: int, how: str) -> np.ndarray:
    """Weights of n inputs in n * factor outputs: half-pixel centres, weights that add up to 1 at the edges too."""
    if how == "nearest":
        return np.repeat(np.eye(n), factor, 0).astype(F32)
    kernels = {"bilinear": (1, lambda x: np.maximum(0, 1 - np.abs(x))), "bicubic": (2, _cubic), "lanczos3": (3, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)), "lanczos5": (5, lambda x: np.where(np.abs(x) < 5, np.sinc(x) * np.sinc(x / 5), 0))}
    if how not in kernels:
        raise InvalidParameter(f"no interpolation {how}")
    at = (np.arange(n * factor) + 0.5) / factor - 0.5
    w = kernels[how][1](at[:, None] - np.arange(n)[None, :])
    return (w / w.sum(1, keepdims=True)).astype(F32)


class _UpSampling(_Shape):
    dims = 1

    def __init__(self, size=2, interpolation: str = "nearest"):
        super().__init__()
        self.size = (size,) * self.dims if isinstance(size, int) else tuple(size)
        if len(self.size) != self.dims or min(self.size) < 1 or self.dims != 2 and interpolation != "nearest":
            raise InvalidParameter("size or interpolation doesn't fit")
        self.interpolation = interpolation
        resize_matrix(2, 1, interpolation)

    def _apply(self, x, shape, back):
        for axis, f in enumerate(self.size, 1):
            m = resize_matrix(shape[axis], f, self.interpolation)
            x = np.moveaxis(np.tensordot(m.T if back else m, x, (1, axis)), 0, axis)
        return np.ascontiguousarray(x, width(x))

    def _there(self, x):
        return self._apply(x, x.shape, False)

    def _home(self, g, shape):
        return self._apply(g, shape, True)


UpSampling1D, UpSampling2D, UpSampling3D = (_named(_UpSampling, f"UpSampling{d}D", d) for d in (1, 2, 3))


class Dropout(Layer):
    """Values go with probability rate, the rest grow by 1 / (1 - rate); predict changes nothing."""

    def __init__(self, rate: float, input_shape: tuple[int, ...] | None = None, random_state: int | None = None):
        super().__init__()
        if not 0 <= rate <= 1:
            raise InvalidParameter("rate must be 0 to 1")
        self.rate, self.rng = rate, make_rng(random_state)

    def _mask(self, shape: tuple[int, ...]) -> tuple[int, ...]:
        return shape

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if not training:
            return x
        keep = self.rng.random(self._mask(x.shape), dtype=F32) >= self.rate
        self._kept = keep * F32(0 if self.rate == 1 else 1 / (1 - self.rate))
        return x * self._kept

    def backward(self, g: np.ndarray) -> np.ndarray:
        return g * self._back()


class _SpatialDropout(Dropout):
    """Whole channels go."""

    def _mask(self, shape):
        return (shape[0], *[1] * (len(shape) - 2), shape[-1])


SpatialDropout1D, SpatialDropout2D, SpatialDropout3D = (type(f"SpatialDropout{d}D", (_SpatialDropout,), {"__module__": __name__}) for d in (1, 2, 3))


class GaussianDropout(Dropout):
    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if not training or self.rate == 0:
            self._kept = F32(1)
            return x
        if self.rate == 1:
            raise InvalidParameter("rate must be under 1")
        self._kept = self.rng.normal(1, np.sqrt(self.rate / (1 - self.rate)), x.shape).astype(F32)
        return x * self._kept


class GaussianNoise(_Shape):
    def __init__(self, stddev: float, input_shape: tuple[int, ...] | None = None, random_state: int | None = None):
        super().__init__()
        if stddev < 0:
            raise InvalidParameter("stddev must not be negative")
        self.stddev, self.rng = stddev, make_rng(random_state)

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        if not training:
            return x
        self._kept = x.shape
        return x + self.rng.normal(0, self.stddev, x.shape).astype(F32)

    def _home(self, g, shape):
        return g


__all__ = [n for n, v in globals().items() if isinstance(v, type) and issubclass(v, Layer) and n[0] != "_" and n != "Layer"]
