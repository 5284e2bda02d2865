"""What a layer is."""

from __future__ import annotations

import numpy as np

from quillmill.errors import ForwardPassNotRun, ShapeMismatch
from quillmill.random import make_rng

F32 = np.float32


def width(x: np.ndarray) -> type:
    """64 bits for what is of 64, else 32."""
    return np.float64 if x.dtype == np.float64 else F32


class Layer:
    """forward keeps what backward needs; backward returns the gradient of the input and fills grads. decays: parameters that weight decay applies to."""

    decays: tuple[str, ...] = ()
    #: of weights, and of what predict works in
    dtype = F32

    def __init__(self):
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}
        self._kept = None

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        raise NotImplementedError

    def backward(self, g: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(np.asarray(x, self.dtype), False)

    def state(self) -> dict[str, np.ndarray]:
        """All that is saved; running statistics are added by layers that have them."""
        return dict(self.params)

    def set_weights(self, **weights: np.ndarray) -> Layer:
        have = self.state()
        for k, v in weights.items():
            v = np.asarray(v, self.dtype)
            if k not in have or have[k].shape != v.shape:
                raise ShapeMismatch(k in have and have[k].shape, v.shape)
            (self.params if k in self.params else self.__dict__)[k] = v
        return self

    def double(self) -> Layer:
        """Weights and predictions in 64 bits from here on; training stays in 32."""
        self.dtype = np.float64
        return self.set_weights(**self.state())

    def param_count(self) -> int:
        return sum(v.size for v in self.params.values())

    def _back(self):
        if self._kept is None:
            raise ForwardPassNotRun(f"{type(self).__name__}: forward comes before backward")
        return self._kept


def glorot(rng: np.random.Generator, shape: tuple[int, ...], fan_in: int, fan_out: int) -> np.ndarray:
    r = np.sqrt(6 / (fan_in + fan_out))
    return rng.uniform(-r, r, shape).astype(F32)


def orthogonal(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(max(rows, cols), min(rows, cols))))
    q = q * np.sign(np.diag(r))
    return (q if rows >= cols else q.T).astype(F32)


__all__ = ["F32", "Layer", "glorot", "make_rng", "orthogonal", "width"]
