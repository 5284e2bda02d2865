"""Names (64-bit hashes) of byte strings, and the minimizer intervals of fixed-length windows, over many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

from quillmill.llm.textvec import _BYTES, _powers, mix


class Names:
    """Hashes of any substring of a buffer from prefix sums."""

    def __init__(self, buf: np.ndarray):
        self.p, self.q = _powers(len(buf) + 1)
        with np.errstate(over="ignore"):
            self.c = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTES[buf] * self.p[: len(buf)], out=self.c[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.c[end] - self.c[start]) * self.q[start] + (end - start).astype(np.uint64))

    def fixed(self, n: int) -> np.ndarray:
        """Of every substring of n bytes."""
        m = len(self.c) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.c[n:] - self.c[:m]) * self.q[:m] + np.uint64(n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from minima within blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def intervals(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Maximal runs of windows (of `length` bytes within a row) that have the same least gram.

    Gives row, first and last window start, place of the gram, the gram's name, and the Names.
    """
    names = Names(buf)
    none = np.zeros(0, np.int64)
    n = len(buf) - length + 1
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64), names
    h = names.fixed(gram)
    keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # buffers are under 16 MiB a step
    at = (sliding_min(keyed, length - gram + 1)[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    starts, ends = off[:-1], off[1:] - length + 1
    long = ends > starts
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long], -1)
    ok = np.cumsum(mark)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[long]] = True
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~ok[1:]
    first, last = np.flatnonzero(new & ok), np.flatnonzero(stop & ok)
    row = np.searchsorted(off, first, "right") - 1
    return row, first, last, at[first], mix(h[at[first]]), names  # mixed anew: least hashes all lie near 0
