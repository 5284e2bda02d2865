"""PCA from one pass of cross products; kernel PCA and t-SNE of sets whose rows fit the driver (their square need not: it is computed in tasks)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.base import Transformer, by_rows, check_counts, collect_matrix, dot, finite_checks, map_rows
from quillmill.errors import InvalidInput, InvalidParameter, NotConverged
from quillmill.functions.distance import Metric
from quillmill.functions.kernels import Kernel
from quillmill.functions.linalg import moments, qr_q, top_eigenpairs_lanczos, top_eigenpairs_power_iteration
from quillmill.operators.neighbors import Boxes, nearest
from quillmill.random import make_rng


def largest_positive(v: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes the entry of greatest size positive."""
    big = np.abs(v).argmax(1)
    sign = np.sign(v[np.arange(len(v)), big])
    return v * np.where(sign == 0, 1, sign)[:, None]


class PCA(Transformer):
    """solver: full, randomized or power, all on the covariance matrix, which is all that leaves the tasks."""

    def __init__(self, n_components: int = 2, solver: str = "full", random_state: int = 0):
        if n_components < 1 or solver not in ("full", "randomized", "power"):
            raise InvalidParameter("n_components must be positive, solver full, randomized or power")
        self.n_components, self.solver, self.random_state, self.features = n_components, solver, random_state, None

    def fit(self, df: DataFrame, features: Sequence[str]) -> PCA:
        n, self.mean, cross = moments(df, features)
        if n < 2 or self.n_components > min(n, len(features)):
            raise InvalidInput("n_components must be at most the rows and columns; two rows are needed")
        cov = cross / (n - 1)
        if self.solver == "full":
            w, v = np.linalg.eigh(cov)
            w, v = w[::-1][: self.n_components], v.T[::-1][: self.n_components]
        elif self.solver == "power":
            w, v = top_eigenpairs_power_iteration(cov, self.n_components, self.random_state)
        else:
            width = min(len(features), self.n_components + 5)
            q = qr_q(cov @ make_rng(self.random_state).normal(size=(len(features), width)))
            for _ in range(4):
                q = qr_q(cov @ q)
            w, u = np.linalg.eigh(q.T @ cov @ q)
            w, v = w[::-1][: self.n_components], (q @ u).T[::-1][: self.n_components]
        self.n_samples, self.explained_variance = n, np.maximum(w, 0)
        total = float(np.trace(cov))
        self.explained_variance_ratio = self.explained_variance / total if total > 0 else np.zeros(len(w))
        self.singular_values = np.sqrt(self.explained_variance * (n - 1))
        self.components, self.features = largest_positive(v), list(features)
        return self

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        self._check(df)
        shift = self.components @ self.mean
        return df.select("*", *[dot(self.features, v, -s).alias(f"{prefix}{i}") for i, (v, s) in enumerate(zip(self.components, shift, strict=True))])

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """The features' columns from those of transform."""
        self._check()
        names = [f"{prefix}{i}" for i in range(len(self.components))]
        return df.withColumns({c: dot(names, self.components[:, j], self.mean[j]) for j, c in enumerate(self.features)})


class KernelPCA(Transformer):
    """solver: dense, lanczos or power on the centred kernel matrix. Equal rows are one with a weight; with more than max_rows different ones
    the matrix is never held: block Krylov spaces from products with it, computed in tasks, until the pairs asked for have settled."""

    def __init__(self, kernel: Kernel = Kernel("rbf", 0.1), n_components: int = 2, solver: str = "dense", random_state: int = 0):
        if n_components < 1 or solver not in ("dense", "lanczos", "power"):
            raise InvalidParameter("n_components must be positive, solver dense, lanczos or power")
        self.kernel, self.n_components, self.solver, self.random_state, self.features = kernel, n_components, solver, random_state, None

    def fit(self, df: DataFrame, features: Sequence[str], max_rows: int = 2000) -> KernelPCA:
        n = check_counts(df.agg(*finite_checks(features)).first(), features)
        if self.n_components > n:
            raise InvalidInput(f"{n} rows: n_components must be at most that")
        self.kernel = self.kernel.resolved_on(df, features)
        m = collect_matrix(df.groupBy(*features).agg(F.count("*").alias("_w")), [*features, "_w"])
        m = m[np.lexsort(m[:, :-1].T)]
        if self.n_components > len(m):  # copies fill up the components
            m = np.repeat(np.c_[m[:, :-1], np.ones(len(m))], m[:, -1].astype(int), axis=0)
        self.points, self.weights = m[:, :-1], m[:, -1]
        root, points, kernel = np.sqrt(self.weights), self.points, self.kernel
        if len(m) <= max_rows:
            k = kernel.matrix(points, points)
            self.row_mean = k @ self.weights / n
            self.all_mean = float(self.row_mean @ self.weights / n)
            centred = (k - self.row_mean[None, :] - self.row_mean[:, None] + self.all_mean) * root[:, None] * root[None, :]
            if self.solver == "dense":
                w, v = np.linalg.eigh(centred)
                w, v = w[::-1][: self.n_components], v.T[::-1][: self.n_components]
            else:
                w, v = (top_eigenpairs_lanczos if self.solver == "lanczos" else top_eigenpairs_power_iteration)(centred, self.n_components, self.random_state)
        else:

            def times(x: np.ndarray) -> np.ndarray:
                return by_rows(df.sparkSession, len(points), lambda at: kernel.times(points[at], points, x), x.shape[1])

            self.row_mean = times(self.weights[:, None])[:, 0] / n
            self.all_mean = float(self.row_mean @ self.weights / n)
            rows, mean = self.row_mean, self.all_mean

            def centred_times(x: np.ndarray) -> np.ndarray:
                y = root[:, None] * x
                total = y.sum(0)
                return root[:, None] * (times(y) - (rows @ y)[None, :] - rows[:, None] * total + mean * total)

            w, v = top_eigenpairs_of_products(centred_times, len(points), self.n_components, self.random_state)
        self.eigenvalues, self.eigenvectors, self.n_samples, self.features = np.maximum(w, 0), largest_positive(v / root[None, :]), n, list(features)
        return self

    def transform(self, df: DataFrame, out: str = "kpca") -> DataFrame:
        self._check(df)
        kernel, points, rows, mean, weights = self.kernel, self.points, self.row_mean, self.all_mean, self.weights
        share = weights / weights.sum()
        with np.errstate(divide="ignore"):
            scale = np.where(self.eigenvalues > 1e-12, 1 / np.sqrt(self.eigenvalues), 0)
        vectors = (self.eigenvectors * weights[None, :] * scale[:, None]).T
        both, total = np.c_[share, vectors], vectors.sum(0)
        shift = mean * total - rows @ vectors

        def body(x: np.ndarray):
            k = kernel.times(x, points, both)
            return [list(k[:, 1:] - k[:, :1] * total + shift)]

        return map_rows(df, self.features, {out: "array<double>"}, body)


def top_eigenpairs_of_products(times, n: int, count: int, seed: int, tol: float = 1e-10, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues and vectors (rows) of a symmetric matrix that is known by times(columns): block Krylov, Rayleigh-Ritz over the whole space."""
    q = np.linalg.qr(make_rng(seed).normal(size=(n, min(n, count + 6))))[0]
    basis, images = np.zeros((n, 0)), np.zeros((n, 0))
    for _ in range(most):
        image = times(q)
        basis, images = np.c_[basis, q], np.c_[images, image]
        t = basis.T @ images
        w, u = np.linalg.eigh((t + t.T) / 2)
        w, u = w[::-1][:count], u[:, ::-1][:, :count]
        off = np.linalg.norm(images @ u - basis @ u * w, axis=0)
        if (off <= tol * max(abs(w[0]), 1e-300)).all():
            return w, (basis @ u).T
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        left, size, _ = np.linalg.svd(image, full_matrices=False)
        q = left[:, size > 1e-12 * max(abs(w[0]), 1e-300)]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0] if q.shape[1] else q
        if not q.shape[1] or basis.shape[1] + q.shape[1] > n:
            return w, (basis @ u).T
    raise NotConverged("the greatest eigenpairs did not settle")


def sigma_for(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Neighbour probabilities of one row whose entropy has this perplexity, by bisection."""
    low, high, beta = 0.0, np.inf, 1.0
    p = np.ones(len(d2)) / max(1, len(d2))
    for _ in range(50):
        e = np.exp(-(d2 - d2.min()) * beta)
        p = e / e.sum()
        gap = -(p * np.log(np.maximum(p, 1e-300))).sum() - np.log(perplexity)
        if abs(gap) < 1e-5:
            break
        if gap > 0:
            low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
        else:
            high, beta = beta, (beta + low) / 2
    return p


def _spline(t: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the `order` nodes around places that lie t (0 to 1) after one, by B-splines, and their derivatives."""
    w = np.zeros((order, len(t)))
    w[0], w[1] = 1 - t, t
    slope = np.zeros_like(w)
    for k in range(3, order + 1):
        if k == order:
            slope[0], slope[1:] = -w[0], w[:-1] - w[1:]
        w[k - 1] = t * w[k - 2] / (k - 1)
        for i in range(1, k - 1):
            w[k - i - 1] = ((t + i) * w[k - i - 2] + (k - i - t) * w[k - i - 1]) / (k - 1)
        w[0] *= (1 - t) / (k - 1)
    return w, slope


def repulsion_by_grid(y: np.ndarray, held: dict, most: int = 1 << 22, order: int = 8, spacing: float = 0.25) -> tuple[np.ndarray, float] | None:
    """What TSNE._repulsion gives, for one or two columns: w is a potential whose slope is -2 w ** 2 (y_i - y_j), so the potential of all rows on a grid, by
    Fourier transforms, has both. Rows go to the grid and back by B-splines, which the transform takes off again. None if it needs more than `most` nodes.
    held: keeps the kernel of a grid for the next call."""
    n, dims = y.shape
    low, span = y.min(0), float(np.ptp(y, axis=0).max())
    h = min(spacing, span / 48)
    if dims > 2 or not h > 0:
        return None
    if h < spacing:  # steps of a quarter, so that the next call finds the kernel
        h = 1.25 ** np.floor(np.log(h) / np.log(1.25))
    lengths = tuple(64 * -(-(2 * (int(v / h) + order + 32)) // 64) for v in np.ptp(y, axis=0))
    if np.prod(lengths, dtype=float) > most:
        return None
    if held.get("for") != (lengths, h):
        far = [np.minimum(np.arange(m), m - np.arange(m)) * h for m in lengths]
        d2 = far[0] ** 2 if dims == 1 else far[0][:, None] ** 2 + far[1][None, :] ** 2
        at_nodes = _spline(np.zeros(1), order)[0][:, 0]
        kernel = np.fft.rfftn(-d2 / (1 + d2)).real  # w - 1: of rows that lie close, w is 1 but for little
        for axis, m in enumerate(lengths):
            k = np.arange(kernel.shape[axis]) * (2 * np.pi / m)
            b = sum(v * np.cos(k * (i - order // 2 + 1)) for i, v in enumerate(at_nodes))
            kernel /= (b * b).reshape([-1 if a == axis else 1 for a in range(dims)])
        held.update({"for": (lengths, h), "kernel": kernel})
    place = (y - low) / h
    node = np.floor(place).astype(np.int64)
    parts = [_spline(place[:, a] - node[:, a], order) for a in range(dims)]
    first = node[:, 0] * (lengths[1] if dims == 2 else 1)  # places are `order` nodes at most after the row's own, so none is negative
    if dims == 2:
        first = first + node[:, 1]
    steps = [(i, j, i * lengths[1] + j) for i in range(order) for j in range(order)] if dims == 2 else [(i, 0, i) for i in range(order)]
    one = np.ones(n)
    w, slope = zip(*parts, strict=True) if dims == 2 else ((parts[0][0], [one]), (parts[0][1], [one]))
    size = int(np.prod(lengths))
    grid = np.zeros(size)
    for i, j, step in steps:
        np.add.at(grid, first + step, w[0][i] * w[1][j])
    field = np.fft.irfftn(np.fft.rfftn(grid.reshape(lengths)) * held["kernel"], lengths, axes=range(dims)).ravel()
    value, pull = np.zeros(n), np.zeros((dims, n))
    for i, j, step in steps:
        f = field[first + step]
        value += f * w[0][i] * w[1][j]
        pull[0] += f * slope[0][i] * w[1][j]
        if dims == 2:
            pull[1] += f * w[0][i] * slope[1][j]
    return pull.T / (-2 * h), float(value.sum() + n * (n - 1.0))


class TSNE:
    """t-SNE. method: exact (all pairs), or neighbors (attraction of the nearest 3 perplexity + 1, repulsion of all). Of more than max_rows rows
    (neighbors only) neighbours are computed in tasks and the repulsion, of all pairs too, on a grid (of one or two components, `repulsion_by_grid`)
    or in tasks; the driver has a few numbers a row and its neighbours."""

    def __init__(self, n_components: int = 2, perplexity: float = 30.0, learning_rate: float = 200.0, n_iter: int = 1000, random_state: int | None = None, init: str = "pca", method: str = "neighbors", min_grad_norm: float = 1e-7):
        if n_components < 1 or not perplexity > 0 or not learning_rate > 0 or n_iter < 1 or init not in ("pca", "random") or method not in ("neighbors", "exact"):
            raise InvalidParameter("a parameter is out of range")
        self.n_components, self.perplexity, self.learning_rate, self.n_iter, self.random_state, self.init, self.method, self.min_grad_norm = n_components, perplexity, learning_rate, n_iter, random_state, init, method, min_grad_norm

    def _affinities(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        k = n - 1 if self.method == "exact" else min(n - 1, int(np.ceil(3 * self.perplexity)) + 1)
        d, at = nearest(x, x, min(n, k + 1), Metric())
        p = np.zeros((n, n))
        for i in range(n):
            mine = at[i] != i
            p[i, at[i][mine][:k]] = sigma_for(d[i][mine][:k] ** 2, self.perplexity)
        return np.maximum((p + p.T) / (2 * n), 1e-12 if self.method == "exact" else 0.0)

    def fit_transform(self, df: DataFrame, features: Sequence[str], row_id: str = "row_id", out: str = "embedding", max_rows: int = 2000) -> DataFrame:
        n = check_counts(df.agg(*finite_checks(features)).first(), features)
        if not self.perplexity < n or n > max_rows and self.method == "exact":
            raise InvalidInput(f"{n} rows: more than the perplexity are needed, and by the exact method at most {max_rows}")
        m = collect_matrix(df, [row_id, *features])
        m = m[np.argsort(m[:, 0], kind="stable")]
        y = self.embed(m[:, 1:], df.sparkSession if n > max_rows else None)
        table = df.sparkSession.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(m[:, 0], y, strict=True)], "_id long, _y array<double>")
        return df.join(F.broadcast(table), F.col(row_id).cast("long") == F.col("_id")).withColumn(out, F.col("_y")).drop("_id", "_y")

    def _sparse_affinities(self, spark: SparkSession, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nonzero affinities that _affinities gives: a row's neighbours, and values that count for both orders."""
        n = len(x)
        k, perplexity, boxes = min(n - 1, int(np.ceil(3 * self.perplexity)) + 1), self.perplexity, Boxes(x)

        def near(rows: np.ndarray) -> np.ndarray:
            d, at = nearest(x[rows], boxes, min(n, k + 1), Metric())
            out = np.zeros((len(rows), 2 * k))
            for o, i, e, j in zip(out, rows, d, at, strict=True):
                mine = j != i
                o[:k], o[k:] = j[mine][:k], sigma_for(e[mine][:k] ** 2, perplexity)
            return out

        got = by_rows(spark, n, near, 2 * k)
        return got[:, :k].astype(np.int32), got[:, k:] / (2 * n)

    @staticmethod
    def _repulsion(spark: SparkSession, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Of all pairs: sums of w ** 2 (y_i - y_j), and of w."""

        size = (y * y).sum(1)
        right = np.ascontiguousarray(np.c_[-2 * y, np.ones(len(y)), size].T)
        with_one = np.c_[y, np.ones(len(y))]

        def part(rows: np.ndarray) -> np.ndarray:
            left, sums, total = np.c_[y[rows], 1 + size[rows], np.ones(len(rows))], np.zeros((len(rows), y.shape[1] + 1)), np.zeros(len(rows))
            for a in range(0, len(y), 1024):  # as much as a core's cache holds
                w = left @ right[:, a : a + 1024]
                np.reciprocal(w, out=w)
                mine = np.flatnonzero((rows >= a) & (rows < a + w.shape[1]))
                w[mine, rows[mine] - a] = 0
                total += w.sum(1)
                w *= w
                sums += w @ with_one[a : a + 1024]
            return np.c_[sums[:, -1:] * y[rows] - sums[:, :-1], total]

        got = by_rows(spark, len(y), part, y.shape[1] + 1, 128)
        return got[:, :-1], float(got[:, -1].sum())

    def embed(self, x: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
        """With a session, squares are computed in its tasks."""
        rng = make_rng(self.random_state)
        if spark is None:
            p = self._affinities(x)
        else:
            near, like = self._sparse_affinities(spark, x)
        if self.init == "pca" and min(x.shape) >= self.n_components:
            c = x - x.mean(0)
            v = largest_positive(np.linalg.svd(c, full_matrices=False)[2][: self.n_components])
            y = c @ v.T
            y *= 1e-4 / max(y[:, 0].std(), 1e-12)
        else:
            y = rng.normal(0, 1e-4, (len(x), self.n_components))
        move, gains, held = np.zeros_like(y), np.ones_like(y), {}
        for it in range(self.n_iter):
            boost = 12.0 if it < 250 else 1.0
            if spark is None:
                w = sum((c[:, None] - c[None, :]) ** 2 for c in y.T)
                w += 1
                np.reciprocal(w, out=w)
                np.fill_diagonal(w, 0)
                q = np.maximum(w / w.sum(), 1e-12)
                f = (boost * p - q) * w
                g = 4 * (f.sum(1)[:, None] * y - f @ y)
            else:
                apart = [c[:, None] - c[near] for c in y.T]
                pull = boost * like / (1 + sum(e * e for e in apart))
                drawn = [pull * e for e in apart]
                drawn = np.stack([e.sum(1) - np.bincount(near.ravel(), e.ravel(), len(y)) for e in drawn], axis=1)
                most = min(1 << 22, max(1 << 16, len(y) ** 2 // 30))  # beyond that all pairs in tasks take less time, or less memory
                push, total = repulsion_by_grid(y, held, most) or self._repulsion(spark, y)
                g = 4 * (drawn - push / total)
            gains = np.maximum(np.where(np.sign(g) != np.sign(move), gains + 0.2, gains * 0.8), 0.01)
            move = (0.5 if it < 250 else 0.8) * move - self.learning_rate * gains * g
            y = y + move
            y -= y.mean(0)
            if it >= 250 and np.linalg.norm(g) < self.min_grad_norm:
                break
        return y
