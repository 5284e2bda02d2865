"""Linear discriminant analysis from class counts, means and pooled scatter: two aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.base import Predictor, check_counts, dot, finite_checks, partition_sums
from quillmill.errors import InvalidInput, InvalidParameter
from quillmill.functions.linalg import lsqr_solve, pseudo_inverse


class LDA(Predictor):
    """solver: svd, eigen or lsqr (how the covariance is applied); shrinkage: None, "auto" (Ledoit-Wolf) or 0 to 1."""

    def __init__(self, n_components: int | None = None, solver: str = "svd", shrinkage: str | float | None = None):
        if n_components is not None and n_components < 1:
            raise InvalidParameter("n_components must be positive")
        if solver not in ("svd", "eigen", "lsqr"):
            raise InvalidParameter(f"no solver {solver}")
        if not (shrinkage in (None, "auto") or not isinstance(shrinkage, str) and 0 <= shrinkage <= 1):
            raise InvalidParameter("shrinkage must be auto or 0 to 1")
        self.n_components, self.solver, self.shrinkage, self.features = n_components, solver, shrinkage, None

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LDA:
        n = check_counts(df.agg(*finite_checks(features)).first(), features)
        d = len(features)
        got = sorted(df.groupBy(F.col(label).cast("long").alias("_y")).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).collect(), key=lambda r: r["_y"])
        k = len(got)
        if k < 2 or min(r["_n"] for r in got) < 2 or n <= k:
            raise InvalidInput("two classes of two rows each are needed, and more rows than classes")
        self.classes = np.array([r["_y"] for r in got])
        counts = np.array([r["_n"] for r in got], float)
        self.means = np.array([[r[f"m{i}"] for i in range(d)] for r in got])
        self.priors = counts / n
        self.overall_mean = self.priors @ self.means
        classes, means = self.classes, self.means

        def part(m: np.ndarray) -> np.ndarray:
            z = m[:, :-1] - means[np.searchsorted(classes, m[:, -1].astype(np.int64))]
            q = (z * z).sum(1)
            return np.concatenate([(z.T @ z).ravel(), [(q * q).sum()]])

        rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"))
        s = partition_sums(rows, [*features, "_y"], part, d * d + 1)
        sw = s[:-1].reshape(d, d)
        cov = sw / (n - k)
        if self.shrinkage == "auto":
            emp = sw / n
            mu = np.trace(emp) / d
            spread = ((emp - mu * np.eye(d)) ** 2).sum()
            noise = (s[-1] / n - (emp * emp).sum()) / n
            a = 0.0 if spread == 0 else float(min(1.0, max(0.0, noise / spread)))
        else:
            a = float(self.shrinkage or 0.0)
        cov = (1 - a) * cov + a * np.trace(cov) / d * np.eye(d)
        cov = cov + 1e-6 * np.trace(cov) / d * np.eye(d)
        self.intensity, self.covariance = a, cov
        if self.solver == "lsqr":
            self.coef = np.array([lsqr_solve(cov, m) for m in self.means])
        elif self.solver == "eigen":
            w, v = np.linalg.eigh(cov)
            self.coef = self.means @ (v / np.maximum(w, 1e-300)) @ v.T
        else:
            self.coef = self.means @ pseudo_inverse(cov)
        self.intercept = np.log(self.priors) - 0.5 * (self.coef * self.means).sum(1)
        # axes: eigenvectors of the between scatter where the within covariance is the identity
        w, v = np.linalg.eigh(cov)
        white = v / np.sqrt(np.maximum(w, 1e-300))
        centred = (self.means - self.overall_mean) * np.sqrt(self.priors)[:, None]
        u, sv, vt = np.linalg.svd(centred @ white, full_matrices=False)
        most = min(k - 1, d)
        if self.n_components is not None and self.n_components > most:
            raise InvalidParameter(f"n_components must be at most {most}")
        axes = vt[: self.n_components or most]
        self.projection = white @ axes.T
        big = np.abs(self.projection).argmax(0)
        self.projection *= np.sign(self.projection[big, np.arange(self.projection.shape[1])])
        self.features = list(features)
        return self

    def _scores(self) -> list[Column]:
        return [dot(self.features, w, b) for w, b in zip(self.coef, self.intercept, strict=True)]

    def decision_function(self, df: DataFrame, out: str = "decision") -> DataFrame:
        self._check(df)
        return df.withColumn(out, F.array(*self._scores()))

    def predict_proba(self, df: DataFrame, out: str = "probabilities") -> DataFrame:
        z = self.decision_function(df, "_z")
        e = z.withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.array_max(F.col("_z")))))
        return e.withColumn(out, F.transform("_e", lambda x: x / F.aggregate(F.col("_e"), F.lit(0.0), lambda s, v: s + v))).drop("_z", "_e")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        z = self.decision_function(df, "_z")
        best = F.array_position("_z", F.array_max("_z")).cast("int")
        return z.withColumn(out, F.get(F.lit([int(c) for c in self.classes]), best - 1)).drop("_z")

    def transform(self, df: DataFrame, prefix: str = "ld") -> DataFrame:
        self._check(df)
        shift = self.overall_mean @ self.projection
        return df.select("*", *[dot(self.features, self.projection[:, j], -shift[j]).alias(f"{prefix}{j}") for j in range(self.projection.shape[1])])

    def fit_transform(self, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
        return self.fit(df, features, label).transform(df)
