"""Kernel support vectors: sequential minimal optimisation on the driver (which keeps a bounded part of the kernel matrix), decisions in the tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.base import Predictor, check_counts, collect_matrix, finite_checks, map_rows
from quillmill.errors import InvalidInput, InvalidParameter, NotConverged
from quillmill.functions.kernels import Kernel
from quillmill.random import make_rng


class KernelRows:
    """Rows of a kernel matrix, computed when asked for; the last ones stay, up to `most` bytes."""

    def __init__(self, kernel: Kernel, x: np.ndarray, most: int = 64 << 20):
        self.kernel, self.x, self.kept, self.room = kernel, x, {}, max(2, most // (8 * len(x)))

    def __getitem__(self, i: int) -> np.ndarray:
        row = self.kept.pop(i, None)
        if row is None:
            row = self.kernel.matrix(self.x[i : i + 1], self.x)[0]
            if len(self.kept) >= self.room:
                self.kept.pop(next(iter(self.kept)))
        self.kept[i] = row
        return row

    def diagonal(self) -> np.ndarray:
        if self.kernel.kind == "rbf":
            return np.ones(len(self.x))
        return np.array([self.kernel.compute(v, v) for v in self.x])


def smo(k: np.ndarray | KernelRows, y: np.ndarray, c: float | np.ndarray, tol: float, max_iter: int, rng: np.random.Generator, eps: float = 1e-8) -> tuple[np.ndarray, float, int]:
    """Multipliers and bias of the dual problem. Each step takes the point that breaks its condition most, and as its partner the one that gains most by second order."""
    n = len(y)
    c = np.broadcast_to(c, n)  # of each point
    alpha, g = np.zeros(n), -np.ones(n)  # g: gradient of the dual
    diag = k.diagonal()
    steps = 0
    for steps in range(1, max_iter * n + 1):
        up = ((y > 0) & (alpha < c - eps)) | ((y < 0) & (alpha > eps))
        down = ((y > 0) & (alpha > eps)) | ((y < 0) & (alpha < c - eps))
        v = -y * g
        if not up.any() or not down.any():
            break
        i = int(np.flatnonzero(up)[np.argmax(v[up])])
        gap = v[i] - v[down].min()
        if gap < tol:
            break
        d = v[i] - v
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        gain = np.where(down & (d > 0), d * d / curve, -1)
        j = int(np.argmax(gain))
        step = d[j] / curve[j]
        # along y_i, -y_j, within the box
        step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c[j] - alpha[j])
        if step <= 0:
            break
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        g += y * step * (k[i] - k[j])
    free = (alpha > eps) & (alpha < c - eps)
    v = -y * g
    if free.any():
        b = float(v[free].mean())
    else:
        up = ((y > 0) & (alpha < c - eps)) | ((y < 0) & (alpha > eps))
        down = ((y > 0) & (alpha > eps)) | ((y < 0) & (alpha < c - eps))
        b = float((v[up].max(initial=-np.inf) + v[down].min(initial=np.inf)) / 2) if up.any() and down.any() else 0.0
    return alpha, b, steps


class SVC(Predictor):
    def __init__(self, kernel: Kernel = Kernel("rbf", 0.1), c: float = 1.0, tol: float = 1e-3, max_iter: int = 1000, random_state: int | None = None):
        if not c > 0 or not tol > 0 or max_iter < 1:
            raise InvalidParameter("c, tol and max_iter must be positive")
        self.kernel, self.c, self.tol, self.max_iter, self.random_state, self.features = kernel, c, tol, max_iter, random_state, None

    def fit(self, df: DataFrame, features: Sequence[str], label: str, max_rows: int = 2000) -> SVC:
        """Equal rows of a label are one, whose multiplier may be as many times c. max_rows: of a kernel matrix that the driver holds whole; of more, it computes the rows that a step needs."""
        r = df.agg(*finite_checks([*features, label]), F.sum(F.when(F.col(label).isin(0, 1), 0).otherwise(1)).alias("_odd"), F.min(label).alias("_lo"), F.max(label).alias("_hi")).first()
        check_counts(r, features)
        if r["_odd"] or r["_lo"] == r["_hi"]:
            raise InvalidInput("both labels 0 and 1 are needed, and no other")
        self.kernel = self.kernel.resolved_on(df, features)
        m = collect_matrix(df.groupBy(*features, label).agg(F.count("*").alias("_w")), [*features, label, "_w"])
        m = m[np.lexsort(m[:, :-1].T)]
        x, y = m[:, :-2], np.where(m[:, -2] > 0, 1.0, -1.0)
        k = self.kernel.matrix(x, x) if len(x) <= max_rows else KernelRows(self.kernel, x)
        alpha, self.bias, self.n_iter = smo(k, y, self.c * m[:, -1], self.tol, self.max_iter, make_rng(self.random_state))
        sv = alpha > 1e-8
        if not sv.any():
            raise NotConverged("no support vectors")
        self.alphas, self.support_vectors, self.support_labels = alpha[sv], x[sv], y[sv]
        self.features = list(features)
        return self

    def decision_function(self, df: DataFrame, out: str = "decision") -> DataFrame:
        self._check(df)
        kernel, w, sv, b = self.kernel, self.alphas * self.support_labels, self.support_vectors, self.bias
        return map_rows(df, self.features, {out: "double"}, lambda x: [kernel.matrix(x, sv) @ w + b])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.decision_function(df, "_decision").withColumn(out, (F.col("_decision") >= 0).cast("double")).drop("_decision")
