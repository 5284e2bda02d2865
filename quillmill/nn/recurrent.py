"""Recurrent layers over (batch, time, features); they return the last state."""

from __future__ import annotations

import numpy as np

from quillmill.errors import InvalidParameter, ShapeMismatch
from quillmill.nn.activations import Activation, _sigmoid
from quillmill.nn.layer import F32, Layer, glorot, make_rng, orthogonal, width


class _Recurrent(Layer):
    """Gates lie side by side in the columns of kernel, recurrent and bias, in the order of `gates`."""

    gates: tuple[str, ...] = ("h",)
    decays = ("kernel", "recurrent")

    def __init__(self, input_dim: int, units: int, activation: str | Activation | None = "tanh", random_state: int | None = None):
        super().__init__()
        if input_dim < 1 or units < 1:
            raise InvalidParameter("dimensions must be positive")
        rng, self.units, self.activation = make_rng(random_state), units, Activation.of(activation)
        k = len(self.gates)
        self.params = {
            "kernel": np.concatenate([glorot(rng, (input_dim, units), input_dim, units) for _ in range(k)], 1),
            "recurrent": np.concatenate([orthogonal(rng, units, units) for _ in range(k)], 1),
            "bias": np.zeros(k * units, F32),
        }

    def set_gate_weights(self, gate: str, kernel: np.ndarray, recurrent: np.ndarray, bias: np.ndarray) -> _Recurrent:
        at = slice(self.gates.index(gate) * self.units, (self.gates.index(gate) + 1) * self.units)
        self.params["kernel"][:, at], self.params["recurrent"][:, at], self.params["bias"][at] = kernel, recurrent, bias
        return self

    def _start(self, x: np.ndarray) -> np.ndarray:
        if x.ndim != 3 or x.shape[2] != len(self.params["kernel"]):
            raise ShapeMismatch(("batch", "time", len(self.params["kernel"])), x.shape)
        return x @ self.params["kernel"] + self.params["bias"]

    def _finish(self, x: np.ndarray, dz: np.ndarray, du: np.ndarray) -> np.ndarray:
        """dz: gradients of all gates' inputs over time."""
        self.grads = {"kernel": np.einsum("btf,btu->fu", x, dz), "recurrent": du, "bias": dz.sum((0, 1))}
        return dz @ self.params["kernel"].T


class SimpleRNN(_Recurrent):
    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        z = self._start(x)
        h = [np.zeros((len(x), self.units), width(x))]
        for t in range(x.shape[1]):
            h.append(self.activation.forward(z[:, t] + h[-1] @ self.params["recurrent"]))
        if training:
            self._kept = x, h
        return h[-1]

    def backward(self, g: np.ndarray) -> np.ndarray:
        x, h = self._back()
        u = self.params["recurrent"]
        dz, du = np.zeros((*x.shape[:2], self.units), F32), np.zeros_like(u)
        for t in reversed(range(x.shape[1])):
            dz[:, t] = self.activation.backward(h[t + 1], g)
            du += h[t].T @ dz[:, t]
            g = dz[:, t] @ u.T
        return self._finish(x, dz, du)


class LSTM(_Recurrent):
    gates = ("i", "f", "g", "o")

    def __init__(self, input_dim: int, units: int, activation: str | Activation | None = "tanh", random_state: int | None = None):
        super().__init__(input_dim, units, activation, random_state)
        self.params["bias"][units : 2 * units] = 1

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        z, n = self._start(x), self.units
        h = c = np.zeros((len(x), n), width(x))
        kept = []
        for t in range(x.shape[1]):
            a = z[:, t] + h @ self.params["recurrent"]
            i, f, g, o = _sigmoid(a[:, :n]), _sigmoid(a[:, n : 2 * n]), self.activation.forward(a[:, 2 * n : 3 * n]), _sigmoid(a[:, 3 * n :])
            new = f * c + i * g
            y = self.activation.forward(new)
            kept.append((h, c, i, f, g, o, y))
            c, h = new, o * y
        if training:
            self._kept = x, kept
        return h

    def backward(self, grad: np.ndarray) -> np.ndarray:
        x, kept = self._back()
        u = self.params["recurrent"]
        dz, du = np.zeros((*x.shape[:2], 4 * self.units), F32), np.zeros_like(u)
        dh, dc = grad, np.zeros_like(grad)
        for t in reversed(range(x.shape[1])):
            h, c, i, f, g, o, y = kept[t]
            dc = dc + self.activation.backward(y, dh * o)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), self.activation.backward(g, dc * i), dh * y * o * (1 - o)], 1)
            du += h.T @ dz[:, t]
            dh, dc = dz[:, t] @ u.T, dc * f
        return self._finish(x, dz, du)


class GRU(_Recurrent):
    """The candidate sees the state after the reset gate."""

    gates = ("z", "r", "h")

    def forward(self, x: np.ndarray, training: bool = True) -> np.ndarray:
        a, n, u = self._start(x), self.units, self.params["recurrent"]
        h, kept = np.zeros((len(x), n), width(x)), []
        for t in range(x.shape[1]):
            gates = _sigmoid(a[:, t, : 2 * n] + h @ u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            cand = self.activation.forward(a[:, t, 2 * n :] + (r * h) @ u[:, 2 * n :])
            kept.append((h, z, r, cand))
            h = z * h + (1 - z) * cand
        if training:
            self._kept = x, kept
        return h

    def backward(self, grad: np.ndarray) -> np.ndarray:
        x, kept = self._back()
        n, u = self.units, self.params["recurrent"]
        dz, du, dh = np.zeros((*x.shape[:2], 3 * n), F32), np.zeros_like(u), grad
        for t in reversed(range(x.shape[1])):
            h, z, r, cand = kept[t]
            dc = self.activation.backward(cand, dh * (1 - z))
            drh = dc @ u[:, 2 * n :].T
            gates = np.concatenate([dh * (h - cand) * z * (1 - z), drh * h * r * (1 - r)], 1)
            dz[:, t] = np.concatenate([gates, dc], 1)
            du[:, : 2 * n] += h.T @ gates
            du[:, 2 * n :] += (r * h).T @ dc
            dh = dh * z + drh * r + gates @ u[:, : 2 * n].T
        return self._finish(x, dz, du)


__all__ = ["GRU", "LSTM", "SimpleRNN"]
