"""Linear and logistic regression, and linear support vectors: one aggregate a step, weights on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.base import Predictor, check_counts, dot, finite_checks, partition_sums
from quillmill.errors import InvalidInput, InvalidParameter, NonFinite
from quillmill.functions.linalg import moments, pseudo_inverse
from quillmill.operators.metrics import r2_score, scalar
from quillmill.random import make_rng


@dataclass(frozen=True)
class Penalty:
    """l1 or l2 with alpha >= 0."""

    kind: str
    alpha: float

    def __post_init__(self):
        if self.kind not in ("l1", "l2") or not 0 <= self.alpha < float("inf"):
            raise InvalidParameter(f"no penalty {self.kind} with alpha {self.alpha}")


def _positive(**values) -> None:
    for k, v in values.items():
        if not 0 < v < float("inf"):
            raise InvalidParameter(f"{k} must be positive")


def soft_threshold(w: np.ndarray, t: float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - t, 0)


class LinearRegression(Predictor):
    """Least squares. normal: from centred cross products (ridge alpha * n, least norm where columns depend). gradient: descent from 0."""

    def __init__(self, fit_intercept: bool = True, solver: str = "normal", learning_rate: float = 0.01, max_iter: int = 1000, tol: float = 1e-5, penalty: Penalty | None = None):
        if solver not in ("normal", "gradient"):
            raise InvalidParameter(f"no solver {solver}")
        _positive(learning_rate=learning_rate, max_iter=max_iter, tol=tol)
        self.fit_intercept, self.solver, self.learning_rate, self.max_iter, self.tol, self.penalty = fit_intercept, solver, learning_rate, max_iter, tol, penalty
        self.features = self.coefficients = self.intercept = self.n_iter = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearRegression:
        if self.solver == "normal":
            self._normal(df, features, label)
        else:
            self._gradient(df, features, label)
        self.features, self.label = list(features), label
        return self

    def _normal(self, df: DataFrame, features: Sequence[str], label: str) -> None:
        if self.penalty and self.penalty.kind == "l1":
            raise InvalidParameter("the normal equations have no l1 penalty")
        n, mean, cross = moments(df, [*features, label])
        if not self.fit_intercept:
            cross = cross + n * np.outer(mean, mean)
        xx, xy = cross[:-1, :-1], cross[:-1, -1]
        if self.penalty:
            xx = xx + self.penalty.alpha * n * np.eye(len(xx))
        self.coefficients = pseudo_inverse(xx) @ xy
        self.intercept = float(mean[-1] - mean[:-1] @ self.coefficients) if self.fit_intercept else 0.0
        self.n_iter = 1

    def _gradient(self, df: DataFrame, features: Sequence[str], label: str) -> None:
        n = check_counts(df.agg(*finite_checks([*features, label])).first(), features)
        d = len(features)
        w, b, last, calm = np.zeros(d), 0.0, None, 0
        cols = [*features, label]
        held = df.select(*cols).persist(StorageLevel.DISK_ONLY)
        try:
            for self.n_iter in range(1, self.max_iter + 1):

                def part(m: np.ndarray, w=w, b=b) -> np.ndarray:
                    e = m[:, :-1] @ w + b - m[:, -1]
                    return np.concatenate([m[:, :-1].T @ e, [e.sum(), e @ e]])

                s = partition_sums(held, cols, part, d + 2)
                cost = s[-1] / (2 * n)
                if self.penalty:
                    cost += self.penalty.alpha * (np.abs(w).sum() if self.penalty.kind == "l1" else w @ w / 2)
                if not np.isfinite(cost):
                    raise NonFinite("the cost is not finite; a lower learning rate may help")
                g = s[:d] / n + (self.penalty.alpha * w if self.penalty and self.penalty.kind == "l2" else 0)
                w = w - self.learning_rate * g
                if self.penalty and self.penalty.kind == "l1":
                    w = soft_threshold(w, self.learning_rate * self.penalty.alpha)
                if self.fit_intercept:
                    b -= self.learning_rate * s[d] / n
                calm = calm + 1 if last is not None and abs(last - cost) < self.tol else 0
                last = cost
                if calm >= 3:
                    break
        finally:
            held.unpersist()
        self.coefficients, self.intercept = w, float(b)

    def prediction(self) -> Column:
        self._check()
        return dot(self.features, self.coefficients, self.intercept)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check(df)
        return df.withColumn(out, self.prediction())

    def score(self, df: DataFrame, label: str) -> float:
        return scalar(r2_score(self.predict(df, "_p"), label, "_p"))


class LogisticRegression(Predictor):
    """Two classes 0 and 1; full-batch gradient descent from 0. The intercept has no penalty; the cost is that before a step."""

    def __init__(self, fit_intercept: bool = True, learning_rate: float = 0.01, max_iter: int = 100, tol: float = 1e-4, penalty: Penalty | None = None):
        _positive(learning_rate=learning_rate, max_iter=max_iter, tol=tol)
        self.fit_intercept, self.learning_rate, self.max_iter, self.tol, self.penalty = fit_intercept, learning_rate, max_iter, tol, penalty
        self.features = self.weights = self.intercept = self.n_iter = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LogisticRegression:
        r = df.agg(*finite_checks([*features, label]), F.sum(F.when(F.col(label).isin(0, 1), 0).otherwise(1)).alias("_odd")).first()
        n, d = check_counts(r, features), len(features)
        if r["_odd"]:
            raise InvalidInput("labels must be 0 or 1")
        w, b, last = np.zeros(d), 0.0, None
        cols = [*features, label]
        held = df.select(*cols).persist(StorageLevel.DISK_ONLY)
        try:
            for self.n_iter in range(1, self.max_iter + 1):

                def part(m: np.ndarray, w=w, b=b) -> np.ndarray:
                    y, z = m[:, -1], m[:, :-1] @ w + b
                    e = 0.5 * (1 + np.tanh(z / 2)) - y
                    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
                    return np.concatenate([m[:, :-1].T @ e, [e.sum(), loss.sum()]])

                s = partition_sums(held, cols, part, d + 2)
                cost, g = s[-1] / n, s[:d] / n
                if self.penalty and self.penalty.kind == "l2":
                    cost, g = cost + self.penalty.alpha * (w @ w) / 2, g + self.penalty.alpha * w
                elif self.penalty:
                    cost, g = cost + self.penalty.alpha * np.abs(w).sum(), g + self.penalty.alpha * np.sign(w)
                if not np.isfinite(cost):
                    raise NonFinite("the cost is not finite; a lower learning rate may help")
                w = w - self.learning_rate * g
                if self.fit_intercept:
                    b -= self.learning_rate * s[d] / n
                if last is not None and abs(last - cost) < self.tol:
                    break
                last = cost
        finally:
            held.unpersist()
        self.weights, self.intercept, self.features = w, float(b), list(features)
        return self

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        self._check(df)
        return df.withColumn(out, 1 / (1 + F.exp(-dot(self.features, self.weights, self.intercept))))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check(df)
        return df.withColumn(out, (dot(self.features, self.weights, self.intercept) >= 0).cast("double"))


def generate_polynomial_features(df: DataFrame, features: Sequence[str], degree: int, prefix: str = "poly") -> DataFrame:
    """df with all monomials of degree 1 to `degree`, lower degrees first, factors in column order."""
    if degree < 1:
        raise InvalidParameter("degree must be at least 1")
    terms = []
    for k in range(1, degree + 1):
        for combo in combinations_with_replacement(features, k):
            x = F.col(combo[0]).cast("double")
            for c in combo[1:]:
                x = x * F.col(c)
            terms.append(x.alias(f"{prefix}{len(terms)}"))
    return df.select("*", *terms)


class LinearSVC(Predictor):
    """Linear support vectors by mini-batch descent: batches are hash ranges of row_id, dealt anew each epoch; a batch is one aggregate.

    batches: a batch holds n / batches rows; more than 64 batches are not made, so an epoch has a bounded number of jobs.
    """

    def __init__(self, max_iter: int = 1000, learning_rate: float = 0.001, penalty: Penalty = Penalty("l2", 1.0), fit_intercept: bool = True, tol: float = 1e-4, loss: str = "hinge", decay: float = 0.0, random_state: int | None = None):
        _positive(max_iter=max_iter, learning_rate=learning_rate, tol=tol)
        if loss not in ("hinge", "squared_hinge") or decay < 0:
            raise InvalidParameter("loss is hinge or squared_hinge, decay not negative")
        self.max_iter, self.learning_rate, self.penalty, self.fit_intercept, self.tol, self.loss, self.decay, self.random_state = max_iter, learning_rate, penalty, fit_intercept, tol, loss, decay, random_state
        self.features = self.weights = self.bias = self.n_iter = None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearSVC:
        r = df.agg(*finite_checks([*features, label]), F.sum(F.when(F.col(label).isin(0, 1), 0).otherwise(1)).alias("_odd")).first()
        n, d = check_counts(r, features), len(features)
        if r["_odd"]:
            raise InvalidInput("labels must be 0 or 1")
        size = min(512, max(32, n // 10))
        batches = max(1, min(64, -(-n // size)))
        rng, w, b = make_rng(self.random_state), np.zeros(d), 0.0
        cols = [*features, label]
        held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.DISK_ONLY)

        def part(m: np.ndarray) -> np.ndarray:
            y = np.where(m[:, -1] > 0, 1.0, -1.0)
            margin = y * (m[:, :-1] @ w + b)
            pull = np.where(margin < 1, y, 0.0) if self.loss == "hinge" else 2 * y * np.maximum(0, 1 - margin)
            return np.concatenate([m[:, :-1].T @ pull, [pull.sum(), len(m)]])

        try:
            for self.n_iter in range(1, self.max_iter + 1):
                rate = self.learning_rate / (1 + self.decay * (self.n_iter - 1))
                old_w, old_b = w.copy(), b
                salt = int(rng.integers(1 << 31))
                batch = F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(batches))
                for k in range(batches):
                    s = partition_sums(held.where(batch == k) if batches > 1 else held, cols, part, d + 2)
                    if not s[-1]:
                        continue
                    g = -s[:d] / s[-1]
                    if self.penalty.kind == "l2":
                        g = g + self.penalty.alpha * w / n
                    w = w - rate * g
                    if self.penalty.kind == "l1":
                        w = soft_threshold(w, rate * self.penalty.alpha / n)
                    if self.fit_intercept:
                        b += rate * s[d] / s[-1]
                if not np.isfinite(w).all():
                    raise NonFinite("the weights are not finite")
                if np.sqrt(((w - old_w) ** 2).mean() + (b - old_b) ** 2) < self.tol:
                    break
        finally:
            held.unpersist()
        self.weights, self.bias, self.features = w, float(b), list(features)
        return self

    def decision_function(self, df: DataFrame, out: str = "decision") -> DataFrame:
        self._check(df)
        return df.withColumn(out, dot(self.features, self.weights, self.bias))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check(df)
        return df.withColumn(out, (dot(self.features, self.weights, self.bias) > 0).cast("double"))

