"""Losses: compute_loss gives a number, compute_grad the gradient of the predictions."""

from __future__ import annotations

import numpy as np

from quillmill.errors import InvalidInput, ShapeMismatch
from quillmill.nn.layer import F32

CLIP = 1e-7


class Loss:
    def compute_loss(self, y: np.ndarray, p: np.ndarray) -> float:
        raise NotImplementedError

    def compute_grad(self, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _same(self, y: np.ndarray, p: np.ndarray) -> None:
        if y.shape != p.shape:
            raise ShapeMismatch(y.shape, p.shape)


class MeanSquaredError(Loss):
    def compute_loss(self, y, p):
        self._same(y, p)
        return float(((p - y) ** 2).mean())

    def compute_grad(self, y, p):
        self._same(y, p)
        return (2 * (p - y) / p.size).astype(F32)


class MeanAbsoluteError(Loss):
    def compute_loss(self, y, p):
        self._same(y, p)
        return float(np.abs(p - y).mean())

    def compute_grad(self, y, p):
        self._same(y, p)
        return (np.sign(p - y) / p.size).astype(F32)


class BinaryCrossEntropy(Loss):
    def compute_loss(self, y, p):
        self._same(y, p)
        q = np.clip(p, CLIP, 1 - CLIP)
        return float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())

    def compute_grad(self, y, p):
        self._same(y, p)
        q = np.clip(p, CLIP, 1 - CLIP)
        return ((q - y) / (q * (1 - q)) / p.size).astype(F32)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


class CategoricalCrossEntropy(Loss):
    """Mean over prediction sites; probabilities are scaled to add up to 1, then clipped."""

    def __init__(self, from_logits: bool = False):
        self.from_logits = from_logits

    def compute_loss(self, y, p):
        self._same(y, p)
        sites = p.size // p.shape[-1]
        if self.from_logits:
            return float(-(y * _log_softmax(p)).sum() / sites)
        q = np.clip(p / p.sum(-1, keepdims=True), CLIP, 1 - CLIP)
        return float(-(y * np.log(q)).sum() / sites)

    def compute_grad(self, y, p):
        self._same(y, p)
        sites = p.size // p.shape[-1]
        if self.from_logits:
            return ((np.exp(_log_softmax(p)) * y.sum(-1, keepdims=True) - y) / sites).astype(F32)
        total = p.sum(-1, keepdims=True)
        q = p / total
        inside = (q > CLIP) & (q < 1 - CLIP)
        d = np.where(inside, -y / np.clip(q, CLIP, 1 - CLIP), 0)  # by the scaled probability
        return ((d - (d * q).sum(-1, keepdims=True)) / total / sites).astype(F32)


class SparseCategoricalCrossEntropy(Loss):
    """Labels of shape (batch, 1), rounded."""

    def __init__(self, from_logits: bool = False):
        self.inner = CategoricalCrossEntropy(from_logits)

    def _onehot(self, y, p):
        at = np.rint(np.asarray(y).reshape(-1)).astype(np.int64)
        if p.ndim != 2 or len(at) != len(p):
            raise ShapeMismatch((len(at), "classes"), p.shape)
        if (at < 0).any() or (at >= p.shape[1]).any():
            raise InvalidInput("a label is out of range")
        return np.eye(p.shape[1], dtype=F32)[at]

    def compute_loss(self, y, p):
        return self.inner.compute_loss(self._onehot(y, p), p)

    def compute_grad(self, y, p):
        return self.inner.compute_grad(self._onehot(y, p), p)


__all__ = ["BinaryCrossEntropy", "CategoricalCrossEntropy", "Loss", "MeanAbsoluteError", "MeanSquaredError", "SparseCategoricalCrossEntropy"]
