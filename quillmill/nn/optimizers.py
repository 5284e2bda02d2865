"""Optimizers: update a layer's parameters in place from its gradients."""

from __future__ import annotations

import numpy as np

from quillmill.errors import InvalidParameter
from quillmill.nn.layer import F32, Layer


class Optimizer:
    """slots hold what is remembered of each parameter; clipnorm limits the norm of all gradients together."""

    def __init__(self, learning_rate: float, weight_decay: float = 0.0, global_clipnorm: float | None = None):
        if not 0 < learning_rate < float("inf") or weight_decay < 0:
            raise InvalidParameter("learning_rate must be positive, weight_decay not negative")
        self.learning_rate, self.weight_decay, self.slots, self.step_count = learning_rate, weight_decay, {}, 0
        self.clipnorm = None
        if global_clipnorm is not None:
            self.with_global_clipnorm(global_clipnorm)

    def with_global_clipnorm(self, norm: float) -> Optimizer:
        if not norm > 0:
            raise InvalidParameter("the norm must be positive")
        self.clipnorm = norm
        return self

    def apply(self, layers: list[Layer]) -> None:
        self.step_count += 1
        scale = 1.0
        if self.clipnorm is not None:
            norm = global_grad_norm(layers)
            scale = min(1.0, self.clipnorm / norm) if norm > 0 else 1.0
        for i, layer in enumerate(layers):
            for k, g in layer.grads.items():
                p = layer.params[k]
                slot = self.slots.setdefault((i, k), {})
                self._update(p, (g * F32(scale)).astype(F32), slot, self.weight_decay if k in layer.decays else 0.0)

    def _update(self, p: np.ndarray, g: np.ndarray, slot: dict, decay: float) -> None:
        raise NotImplementedError


def global_grad_norm(layers: list[Layer]) -> float:
    return float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for x in layers for g in x.grads.values())))


class SGD(Optimizer):
    """v = m v + g; nesterov looks ahead by g + m v; decay is apart from the gradient."""

    def __init__(self, learning_rate: float = 0.01, momentum: float = 0.0, nesterov: bool = False, weight_decay: float = 0.0, **more):
        super().__init__(learning_rate, weight_decay, **more)
        if not 0 <= momentum < 1:
            raise InvalidParameter("momentum must be 0 up to 1")
        self.momentum, self.nesterov = momentum, nesterov

    def _update(self, p, g, slot, decay):
        if decay:
            p *= F32(1 - self.learning_rate * decay)
        if self.momentum:
            v = slot["v"] = F32(self.momentum) * slot.get("v", np.zeros_like(p)) + g
            g = g + F32(self.momentum) * v if self.nesterov else v
        p -= F32(self.learning_rate) * g


class Adam(Optimizer):
    """Bias-corrected; decay is part of the gradient."""

    apart = False

    def __init__(self, learning_rate: float = 0.001, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-7, weight_decay: float = 0.0, **more):
        super().__init__(learning_rate, weight_decay, **more)
        if not 0 <= beta1 < 1 or not 0 <= beta2 < 1 or not epsilon > 0:
            raise InvalidParameter("betas must be 0 up to 1, epsilon positive")
        self.beta1, self.beta2, self.epsilon = beta1, beta2, epsilon

    def _update(self, p, g, slot, decay):
        if decay and self.apart:
            p *= F32(1 - self.learning_rate * decay)
        elif decay:
            g = g + F32(decay) * p
        m = slot["m"] = F32(self.beta1) * slot.get("m", np.zeros_like(p)) + F32(1 - self.beta1) * g
        v = slot["v"] = F32(self.beta2) * slot.get("v", np.zeros_like(p)) + F32(1 - self.beta2) * g * g
        mh, vh = m / F32(1 - self.beta1**self.step_count), v / F32(1 - self.beta2**self.step_count)
        p -= F32(self.learning_rate) * mh / (np.sqrt(vh) + F32(self.epsilon))


class AdamW(Adam):
    """Adam with decay apart from the gradient."""

    apart = True

    def __init__(self, learning_rate: float = 0.001, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-7, weight_decay: float = 0.004, **more):
        super().__init__(learning_rate, beta1, beta2, epsilon, weight_decay, **more)


class RMSprop(Optimizer):
    def __init__(self, learning_rate: float = 0.001, rho: float = 0.9, epsilon: float = 1e-7, weight_decay: float = 0.0, **more):
        super().__init__(learning_rate, weight_decay, **more)
        if not 0 <= rho < 1 or not epsilon > 0:
            raise InvalidParameter("rho must be 0 up to 1, epsilon positive")
        self.rho, self.epsilon = rho, epsilon

    def _update(self, p, g, slot, decay):
        if decay:
            p *= F32(1 - self.learning_rate * decay)
        c = slot["c"] = F32(self.rho) * slot.get("c", np.zeros_like(p)) + F32(1 - self.rho) * g * g
        p -= F32(self.learning_rate) * g / np.sqrt(c + F32(self.epsilon))


class AdaGrad(Optimizer):
    def __init__(self, learning_rate: float = 0.001, epsilon: float = 1e-7, weight_decay: float = 0.0, **more):
        super().__init__(learning_rate, weight_decay, **more)
        if not epsilon > 0:
            raise InvalidParameter("epsilon must be positive")
        self.epsilon = epsilon

    def _update(self, p, g, slot, decay):
        if decay:
            p *= F32(1 - self.learning_rate * decay)
        a = slot["a"] = slot.get("a", np.zeros_like(p)) + g * g
        p -= F32(self.learning_rate) * g / np.sqrt(a + F32(self.epsilon))


__all__ = ["SGD", "AdaGrad", "Adam", "AdamW", "Optimizer", "RMSprop", "global_grad_norm"]
