"""k-means, density clustering and mean shift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.base import Estimator, check_counts, collect_matrix, finite_checks, map_rows, partition_sums
from quillmill.errors import InvalidInput, InvalidParameter
from quillmill.functions.distance import Metric
from quillmill.operators.neighbors import nearest, radius_join
from quillmill.plans.components import checkpointed, connected_components, numbered
from quillmill.random import make_rng


class Clusterer(Estimator):
    def fit_predict(self, df: DataFrame, features: Sequence[str], out: str = "cluster") -> DataFrame:
        return self.fit(df, features).predict(df, out)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None, :] - 2 * x @ c.T


class KMeans(Clusterer):
    """Lloyd's algorithm, k-means++ starts; a step is one sum over all partitions of counts, sums and inertia per centre."""

    def __init__(self, n_clusters: int = 8, max_iter: int = 300, tol: float = 1e-4, n_init: int = 10, random_state: int | None = None):
        if n_clusters < 1 or max_iter < 1 or tol < 0 or n_init < 1:
            raise InvalidParameter("n_clusters, max_iter and n_init must be positive, tol not negative")
        self.n_clusters, self.max_iter, self.tol, self.n_init, self.random_state, self.features = n_clusters, max_iter, tol, n_init, random_state, None

    def _start(self, held: DataFrame, cols: list[str], rng: np.random.Generator) -> np.ndarray:
        """Each next centre is drawn with odds d^2: the row of least -ln(u) / d^2, with u from a hash of the row (one pass a centre)."""
        centres: list[list[float]] = []
        for _ in range(self.n_clusters):
            salt = int(rng.integers(1 << 31))
            u = (F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(1 << 52)).cast("double") + 1) / float((1 << 52) + 1)
            if centres:
                each = []
                for c in centres:
                    d = F.lit(0.0)
                    for name, v in zip(cols, c, strict=True):
                        e = F.col(name) - F.lit(v)
                        d = d + e * e
                    each.append(d)
                d2 = F.least(*each) if len(each) > 1 else each[0]
                key = F.when(d2 > 0, -F.ln(u) / d2).otherwise(F.lit(1e300) + u)
            else:
                key = -F.ln(u)
            r = held.agg(F.min_by(F.struct(*cols), key).alias("r")).first()["r"]
            centres.append([float(r[c]) for c in cols])
        return np.array(centres)

    def fit(self, df: DataFrame, features: Sequence[str]) -> KMeans:
        cols = list(features)
        r = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)], *finite_checks(cols)).first()
        n = check_counts(r, cols)
        if n < self.n_clusters:
            raise InvalidInput(f"{self.n_clusters} rows are needed")
        tol = self.tol * float(np.mean([r[f"v{i}"] for i in range(len(cols))]))
        held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.DISK_ONLY)
        rng = make_rng(self.random_state)
        try:
            runs = [self._lloyd(held, cols, self._start(held, cols, rng), tol) for _ in range(self.n_init)]
        finally:
            held.unpersist()
        self.inertia, self.centroids, self.n_iter = min(runs, key=lambda x: x[0])
        self.features = cols
        return self

    def _lloyd(self, held: DataFrame, cols: list[str], c: np.ndarray, tol: float):
        k, d = c.shape

        def step(c: np.ndarray):
            def part(x: np.ndarray) -> np.ndarray:
                q = _squares(x, c)
                at = q.argmin(1)
                out = np.zeros((k, d + 1))
                np.add.at(out[:, :-1], at, x)
                out[:, -1] = np.bincount(at, minlength=k)
                return np.concatenate([out.ravel(), [np.maximum(q[np.arange(len(x)), at] + (x * x).sum(1), 0).sum()]])

            s = partition_sums(held, cols, part, k * (d + 1) + 1)
            return s[:-1].reshape(k, d + 1), float(s[-1])

        sums, inertia = step(c)
        for it in range(1, self.max_iter + 1):
            new = c.copy()
            full = sums[:, -1] > 0
            new[full] = sums[full, :-1] / sums[full, -1:]
            for i in np.flatnonzero(~full):  # an empty one takes the row farthest from its centre
                far = map_rows(held, cols, {"_d": "double"}, lambda x, c=new: [_squares(x, c).min(1) + (x * x).sum(1)]).orderBy(F.col("_d").desc()).first()
                new[i] = [far[f] for f in cols]
            if ((new - c) ** 2).sum() <= tol:
                break
            c = new
            sums, inertia = step(c)
        return inertia, c, it

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        self._check(df)
        c = self.centroids
        return map_rows(df, self.features, {out: "long"}, lambda x: [_squares(x, c).argmin(1)])


#: pairs within eps (estimated) above which DBSCAN of one feature goes along the line; points of a range there; a mark for no run
MOST_PAIRS, LINE_ROWS, NO_RUN = 1 << 22, 50_000, -(1 << 60)


def dense(points: DataFrame, x: str, eps: float) -> float:
    """About how many pairs of points lie within eps of each other on the line."""
    cells = points.groupBy(F.floor(F.col(x) / F.lit(float(eps)))).agg(F.count("*").cast("double").alias("n"))
    return cells.agg(F.sum(F.col("n") * F.col("n"))).first()[0] * 2 or 0.0


class DBSCAN(Clusterer):
    """Density clustering: a range self-join on a grid (of one feature and many pairs, a sweep along the line), components of core rows, border rows to the first cluster that reaches them.

    Clusters are numbered by their first core row (by row_id); noise is -1.
    """

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: Metric = Metric()):
        if not eps > 0 or min_samples < 1:
            raise InvalidParameter("eps and min_samples must be positive")
        self.eps, self.min_samples, self.metric, self.features = eps, min_samples, metric, None

    def fit(self, df: DataFrame, features: Sequence[str], row_id: str = "row_id") -> DBSCAN:
        check_counts(df.agg(*finite_checks(features)).first(), features)
        rows = df.select(F.col(row_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in features])
        points = checkpointed(rows.groupBy(*features).agg(F.min("id").alias("id"), F.count("*").alias("w")))  # equal rows are one with a weight
        if len(features) == 1 and dense(points, features[0], self.eps) > MOST_PAIRS:
            labelled = self._along_line(points, features[0])
        else:
            labelled = self._by_pairs(points, features)
        self.labels = rows.join(labelled, list(features)).select("id", "cluster", "core", *features)
        self.features, self.row_id = list(features), row_id
        return self

    def _by_pairs(self, points: DataFrame, features: Sequence[str]) -> DataFrame:
        """The features of different points with cluster and core, from all pairs within eps."""
        pairs = checkpointed(radius_join(points, "id", features, self.eps, self.metric))
        weight = points.select(F.col("id").alias("b"), "w")
        core = pairs.join(weight, "b").groupBy("a").agg(F.sum("w").alias("n")).where(F.col("n") >= self.min_samples).select(F.col("a").alias("id"))
        links = pairs.join(core, F.col("a") == F.col("id"), "left_semi").join(core, F.col("b") == F.col("id"), "left_semi")
        found = connected_components(links.select("a", "b"), keep_loops=True)
        first = found.select(F.col("node").alias("id"), F.col("component").alias("root"))
        number = numbered(first.select("root").distinct(), "root", "cluster")
        cores = first.join(number, "root").select("id", F.col("cluster").cast("long").alias("cluster"))
        border = pairs.join(cores, F.col("b") == F.col("id")).groupBy("a").agg(F.min("cluster").alias("_near"))
        labelled = points.join(border, F.col("id") == F.col("a"), "left").drop("a").join(cores.withColumnRenamed("id", "core_id"), F.col("id") == F.col("core_id"), "left")
        return labelled.select(*features, F.coalesce("cluster", "_near", F.lit(-1)).cast("long").alias("cluster"), F.col("core_id").isNotNull().alias("core"))

    def _along_line(self, points: DataFrame, x: str) -> DataFrame:
        """What _by_pairs gives for one feature, without pairs: in order of x, weights within eps are differences of running sums, a cluster is a run of core
        points with gaps of at most eps, and a border point has at most a run on either side. Ranges of x are tasks, each with 3 eps of its neighbours' points."""
        spark, eps, least = points.sparkSession, self.eps, self.min_samples
        n = points.count()
        cuts: list[float] = []
        for c in points.stat.approxQuantile(x, np.linspace(0, 1, max(2, n // LINE_ROWS + 1))[1:-1].tolist(), 1e-3) if n > 2 * LINE_ROWS else []:
            if not cuts or c - cuts[-1] > 8 * eps:  # so a point goes to three tasks at most
                cuts.append(c)
        edges = np.array(cuts)

        def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                v, i, w = (b.column(k).to_numpy() for k in range(3))
                own = np.searchsorted(edges, v, "right")
                for part, mine in ((own, np.ones(len(v), bool)), (own - 1, (own > 0) & (np.searchsorted(edges, v - 3.5 * eps, "right") < own)), (own + 1, np.searchsorted(edges, v + 3.5 * eps, "right") > own)):
                    yield pa.RecordBatch.from_arrays([pa.array(part[mine]), pa.array((part == own)[mine]), pa.array(v[mine]), pa.array(i[mine]), pa.array(w[mine])], names=["part", "own", "x", "id", "w"])

        def sweep(t: pa.Table) -> pa.Table:
            by = np.argsort(t["x"].to_numpy())
            own, v, i, w = (t[c].to_numpy()[by] for c in ("own", "x", "id", "w"))
            n, at = len(v), np.arange(len(v))
            low, high = np.searchsorted(v, v - eps, "left"), np.searchsorted(v, v + eps, "right")
            while (far := v - v[low] > eps).any():  # sums are rounded, differences decide
                low = low + far
            while (near := (low > 0) & (v - v[low - 1] <= eps)).any():
                low = low - near
            while (far := v[high - 1] - v > eps).any():
                high = high - far
            while (near := (high < n) & (v[np.minimum(high, n - 1)] - v <= eps)).any():
                high = high + near
            total = np.concatenate([[0], np.cumsum(w)])
            core = total[high] - total[low] >= least
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(core, at, -1))[:-1]])  # the last core point before each
            after = np.concatenate([np.minimum.accumulate(np.where(core, at, n)[::-1])[::-1][1:], [n]])
            starts = core & (before < low)
            runs = np.cumsum(starts & own)  # runs that start in this range, up to each
            left = np.where(core | (before >= low), runs - 1, NO_RUN)
            right = np.where(~core & (after < high), runs - 1 + starts[np.minimum(after, n - 1)], NO_RUN)
            return pa.table({"part": t["part"].to_numpy()[by][own], "x": v[own], "id": i[own], "core": core[own], "starts": starts[own], "left": left[own], "right": right[own]})

        dealt = points.select(F.col(x).alias("x"), "id", "w").mapInArrow(deal, "part long, own boolean, x double, id long, w long")
        swept = checkpointed(dealt.groupBy("part").applyInArrow(sweep, "part long, x double, id long, core boolean, starts boolean, left long, right long"))
        sums, sofar = [], 0
        for part, k in sorted((r["part"], r["k"]) for r in swept.groupBy("part").agg(F.sum(F.col("starts").cast("int")).alias("k")).collect()):  # a row for each range
            sums.append((part, sofar))
            sofar += k
        swept = swept.join(F.broadcast(spark.createDataFrame(sums, "part long, sofar long")), "part")
        swept = swept.select("x", "id", "core", *[F.when(F.col(c) != NO_RUN, F.col(c) + F.col("sofar")).alias(c) for c in ("left", "right")])
        first = swept.where("core").groupBy("left").agg(F.min("id").alias("root"))
        number = checkpointed(numbered(first, "root", "cluster").select(F.col("left").alias("run"), "cluster"))
        left, right = (number.select(F.col("run").alias(c), F.col("cluster").alias(f"{c}_cluster")) for c in ("left", "right"))
        found = swept.join(left, "left", "left").join(right, "right", "left")
        return found.select(F.col("x").alias(x), F.coalesce(F.least("left_cluster", "right_cluster"), F.lit(-1)).cast("long").alias("cluster"), "core")

    def fit_predict(self, df: DataFrame, features: Sequence[str], out: str = "cluster", row_id: str = "row_id") -> DataFrame:
        self.fit(df, features, row_id)
        return df.drop(out).join(self.labels.select(F.col("id").alias("_id"), F.col("cluster").alias(out)), F.col(row_id).cast("long") == F.col("_id")).drop("_id")

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        """The cluster of the nearest core row within eps, else -1."""
        self._check(df)
        core = self.labels.where("core").orderBy("id")
        m = collect_matrix(core, [*self.features, "cluster"])
        if not len(m):
            return df.withColumn(out, F.lit(-1).cast("long"))
        x, y, eps, metric = m[:, :-1], m[:, -1].astype(np.int64), self.eps, self.metric

        def body(q: np.ndarray):
            d, i = nearest(q, x, 1, metric)
            return [np.where(d[:, 0] <= eps, y[i[:, 0]], -1)]

        return map_rows(df, self.features, {out: "long"}, body)


class MeanShift(Clusterer):
    """Flat-kernel mean shift: all seeds move together, one sum over all partitions a step."""

    def __init__(self, bandwidth: float, max_iter: int = 300, tol: float = 1e-3, bin_seeding: bool = False, cluster_all: bool = True):
        if not bandwidth > 0 or max_iter < 1 or not tol > 0:
            raise InvalidParameter("bandwidth, max_iter and tol must be positive")
        self.bandwidth, self.max_iter, self.tol, self.bin_seeding, self.cluster_all, self.features = bandwidth, max_iter, tol, bin_seeding, cluster_all, None

    def _seeds(self, df: DataFrame, cols: list[str]) -> np.ndarray:
        if not self.bin_seeding:
            return np.unique(collect_matrix(df, cols, 64 << 20), axis=0)
        low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
        cell = [F.floor((F.col(c) - F.lit(float(low[c]))) / self.bandwidth).alias(f"_g{i}") for i, c in enumerate(cols)]
        one = df.groupBy(*cell).agg(F.min(F.struct(*cols)).alias("r")).select("r.*")
        return collect_matrix(one, cols, 64 << 20)

    def fit(self, df: DataFrame, features: Sequence[str]) -> MeanShift:
        cols = list(features)
        self.n_samples = check_counts(df.agg(*finite_checks(cols)).first(), cols)
        held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.DISK_ONLY)
        try:
            at = self._seeds(held, cols)
            m, d = at.shape
            moving, bw = np.ones(m, bool), self.bandwidth
            counts = np.zeros(m)
            for self.n_iter in range(1, self.max_iter + 1):
                here = at[moving]

                def part(x: np.ndarray, here=here) -> np.ndarray:
                    out = np.zeros((len(here), d + 1))
                    for i in range(0, len(x), 2048):
                        near = (Metric().pairs(here, x[i : i + 2048]) <= bw).astype(float)
                        out[:, :-1] += near @ x[i : i + 2048]
                        out[:, -1] += near.sum(1)
                    return out.ravel()

                s = partition_sums(held, cols, part, here.size + len(here)).reshape(len(here), d + 1)
                some = s[:, -1] > 0
                new = here.copy()
                new[some] = s[some, :-1] / s[some, -1:]
                shift = np.sqrt(((new - here) ** 2).sum(1))
                at[moving], counts[moving] = new, s[:, -1]
                moving[np.flatnonzero(moving)[(shift < self.tol) | ~some]] = False
                if not moving.any():
                    break
        finally:
            held.unpersist()
        order = sorted(range(m), key=lambda i: (-counts[i], *(-at[i])))
        centres: list[int] = []
        for i in order:
            if counts[i] and all(np.sqrt(((at[i] - at[j]) ** 2).sum()) > bw for j in centres):
                centres.append(i)
        self.cluster_centers, self.samples_per_center, self.features = at[centres], counts[centres], cols
        return self

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        self._check(df)
        c, bw, everything = self.cluster_centers, self.bandwidth, self.cluster_all

        def body(x: np.ndarray):
            d = Metric().pairs(x, c)
            at = d.argmin(1)
            return [at if everything else np.where(d[np.arange(len(x)), at] <= bw, at, -1)]

        return map_rows(df, self.features, {out: "long"}, body)


def estimate_bandwidth(df: DataFrame, features: Sequence[str], quantile: float = 0.3, n_samples: int | None = None, random_state: int | None = None) -> float:
    """Mean over rows of the distance to the floor(n q)-th nearest, the row itself counted; 0 for fewer than two."""
    if not 0 < quantile <= 1:
        raise InvalidParameter("quantile must be in (0, 1]")
    cols = list(features)
    rows = df.select(*cols)
    if n_samples is not None:
        salt = int(make_rng(random_state).integers(1 << 31))
        rows = rows.orderBy(F.xxhash64(*cols, F.lit(salt))).limit(n_samples)
    x = collect_matrix(rows, cols, 64 << 20)
    k = int(len(x) * quantile)
    if k < 2:
        return 0.0
    d, _ = nearest(x, x, k, Metric())
    return float(d[:, k - 1].mean())

