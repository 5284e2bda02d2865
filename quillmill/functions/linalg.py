"""Dense linear algebra on matrices that fit the driver (Gram matrices, centroids), and products of frames with small matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.base import check_counts, dot, finite_checks, partition_sums
from quillmill.errors import NotConverged
from quillmill.random import make_rng


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means, and centred cross products: two passes, so that nothing cancels."""
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)], *finite_checks(columns)).first()
    n = check_counts(r, columns)
    mean = np.array([r[f"m_{i}"] for i in range(len(columns))])
    d = len(columns)
    cross = partition_sums(df, columns, lambda x: (x - mean).T @ (x - mean), d * d).reshape(d, d)
    return n, mean, (cross + cross.T) / 2


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors."""
    return np.linalg.eigh(a)


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(a, full_matrices=False)


def pseudo_inverse(a: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    return np.linalg.pinv(a, rcond=tol)


def solve(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Least squares of least norm."""
    return np.linalg.lstsq(a, b, rcond=tol)[0]


def qr_q(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a)[0]


def top_eigenpairs_power_iteration(a: np.ndarray, k: int, seed: int = 0, max_iter: int = 1000, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest by absolute value, one after another; each is taken out of the matrix."""
    rng, left, values, vectors = make_rng(seed), a.astype(float).copy(), [], []
    for _ in range(k):
        v = rng.normal(size=len(a))
        v /= np.linalg.norm(v)
        for _ in range(max_iter):
            w = left @ v
            if (size := np.linalg.norm(w)) < 1e-300:
                break
            w /= size
            if min(np.linalg.norm(w - v), np.linalg.norm(w + v)) < tol:
                v = w
                break
            v = w
        value = float(v @ left @ v)
        left -= value * np.outer(v, v)
        values.append(value)
        vectors.append(v)
    return np.array(values), np.array(vectors)


def top_eigenpairs_lanczos(a: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest, from a Krylov space that is kept orthogonal."""
    n = len(a)
    m = min(n, max(2 * k + 20, 40))
    q = np.zeros((m, n))
    v = make_rng(seed).normal(size=n)
    alpha, beta = np.zeros(m), np.zeros(m)
    v /= np.linalg.norm(v)
    for j in range(m):
        q[j] = v
        w = a @ v
        alpha[j] = w @ v
        w -= q[: j + 1].T @ (q[: j + 1] @ w)
        w -= q[: j + 1].T @ (q[: j + 1] @ w)
        beta[j] = np.linalg.norm(w)
        if beta[j] < 1e-12:
            w = make_rng(seed + j + 1).normal(size=n)
            w -= q[: j + 1].T @ (q[: j + 1] @ w)
            if np.linalg.norm(w) < 1e-10:
                m = j + 1
                break
            beta[j] = 0.0
        v = w / np.linalg.norm(w)
    values, vectors = np.linalg.eigh(np.diag(alpha[:m]) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
    if m < k:
        raise NotConverged(f"only {m} pairs were found")
    order = np.argsort(-values)[:k]
    return values[order], vectors[:, order].T @ q[:m]


def lsqr_solve(a: np.ndarray, b: np.ndarray, max_iter: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Conjugate gradients on the normal equations."""
    x, r = np.zeros(a.shape[1]), b.astype(float).copy()
    s = a.T @ r
    p, size = s.copy(), float(s @ s)
    first = size
    for _ in range(max_iter):
        if size <= tol * tol * max(first, 1e-300):
            break
        q = a @ p
        step = size / float(q @ q)
        x += step * p
        r -= step * q
        s = a.T @ r
        size, old = float(s @ s), size
        p = s + size / old * p
    return x


def matvec(df: DataFrame, columns: Sequence[str], x: Sequence[float], out: str = "product") -> DataFrame:
    return df.withColumn(out, dot(columns, x))


def matmul(df: DataFrame, columns: Sequence[str], b: np.ndarray, prefix: str = "p") -> DataFrame:
    """df with the columns of (its matrix times b) added."""
    return df.select("*", *[dot(columns, b[:, j]).alias(f"{prefix}{j}") for j in range(b.shape[1])])
