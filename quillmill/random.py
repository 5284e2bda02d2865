"""Seeds: a local seed before the global stream before entropy."""

from __future__ import annotations

import threading

import numpy as np

_global = threading.local()


def set_global_seed(seed: int) -> None:
    _global.stream = np.random.SeedSequence(seed)


def clear_global_seed() -> None:
    _global.stream = None


def make_rng(random_state: int | None = None) -> np.random.Generator:
    if random_state is not None:
        return np.random.default_rng(random_state)
    stream = getattr(_global, "stream", None)
    return np.random.default_rng(stream.spawn(1)[0] if stream is not None else None)
